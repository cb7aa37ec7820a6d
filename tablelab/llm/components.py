"""Connected components by contraction, as DataFrame joins.

Every round each node takes its smallest neighbour (or itself) as parent and
edges are rewritten to parents; nodes with edges at least halve, so the number
of rounds is logarithmic.  Edges, parents and labels stay distributed; a
node in very many edges is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of the
    undirected edges (a, b); edges of a node with itself are allowed."""
    edges = written(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "cc-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    while True:
        parents = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("parent")), "cc-parents")
        if labels is None:
            labels = parents.select(F.col("a").alias("node"), F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("a").alias("component"), "parent")
            labels = written(labels.join(step, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")), "cc-labels")
        left, right = (parents.select(F.col("a").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        edges = written(edges.join(left, "a").join(right, "b").where(F.col("pa") != F.col("pb")).select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        if edges.isEmpty():
            return labels
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
