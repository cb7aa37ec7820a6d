"""Operators for large-scale training-data pipelines, each a Spark job of its own."""
