"""tablelab.operators."""
