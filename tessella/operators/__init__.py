"""Relational operators over pixels, cells, palettes and beads, all keyed by image_id."""
