"""tablelab.streaming."""
