"""tablelab.sources."""
