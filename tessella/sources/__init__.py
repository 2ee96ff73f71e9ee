"""Where palettes and pixels come from, and the tables they are written to."""
