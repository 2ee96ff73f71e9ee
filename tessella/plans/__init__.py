"""Whole requests: presets, the photo-to-pattern plan, the registered queries."""
