"""tablelab: tabular data science as Spark DataFrame jobs."""

__version__ = "0.1.0"
