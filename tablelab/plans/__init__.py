"""tablelab.plans."""
