"""tablelab.functions."""
