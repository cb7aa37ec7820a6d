"""Exact top-k search by inner product as a Voronoi kNN join.

1. *Pivots*: a bounded, hash-chosen sample of at most ``PIVOTS`` vectors.
2. *Grouping*: every vector belongs to the cell of its nearest pivot p.  A
   cell's summary is its number of rows and its radius r, the largest distance
   to p; cells are cut into slices of about ``SLICE_ROWS`` rows, so a vector
   that a third of all rows share is spread over many slices.  Queries of
   neighbouring cells form blocks of about ``BLOCK_QUERIES`` queries.
3. *Bounds*: each block first meets one slice of each of its own cells; the
   k-th best score found bounds what a query still looks for.  By
   Cauchy-Schwarz no row of a cell scores above  q.p + |q| r.
4. *Replication*: a slice goes only to blocks that hold a query whose bound the
   cell can reach and that haven't met it.  Each (block, slice) pair is solved
   locally with one matrix product; the partial lists of k are merged by query.

Scores are integers, exact in double products up to 2^53.

Defined results: vectors that are null or empty, hold null or non-finite
components, or differ in length from the most common length take no part, nor
do rows without id; a query never meets rows with its own id; ties go to the
smaller id; an id that repeats counts once, with its best score as a candidate
and its smallest vector as a query; fewer than k candidates give fewer rows; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.llm.common import written

K = 5
PIVOTS = 64
SLICE_ROWS = 4096
BLOCK_QUERIES = 2048
SCALE = 256
_FOUND = "query_id long, id long, score long"


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, v array<double> of integers) of the usable rows."""
    x = F.col("v")
    ok = (F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
          & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return (table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
            .where(F.coalesce(ok, F.lit(False)))
            .select("id", F.transform("v", lambda c: F.floor(c * scale).cast("double")).alias("v")))


def choose_pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    n = rows.count()
    if n == 0:
        return np.zeros((0, 0))
    share = int(min(1.0, 4.0 * pivots / n) * (1 << 30)) + 1
    drawn = (rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
             .orderBy(F.xxhash64("id"), "id").limit(pivots).collect()) or rows.limit(1).collect()
    return np.unique(np.array([r["v"] for r in drawn], float), axis=0)


def to_cells(rows: DataFrame, pivots) -> DataFrame:
    """Adds the cell (nearest pivot) and the distance to its pivot."""
    def run(batches):
        p = pivots.value
        norm = (p * p).sum(axis=1)
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                cell = (norm - 2 * (x @ p.T)).argmin(axis=1)
                yield b.assign(cell=cell.astype(np.int32), away=np.sqrt(((x - p[cell]) ** 2).sum(axis=1)))

    return rows.mapInPandas(run, "id long, v array<double>, cell int, away double")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: larger score, then smaller id."""
    keep = np.arange(len(ids))
    if len(ids) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def solver(k: int):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(data):
            data = data.sort_values("id")
            ids, start = np.unique(data["id"].to_numpy(), return_index=True)
            scores = np.stack(queries["v"].to_numpy()) @ np.stack(data["v"].to_numpy()).T
            if len(ids) < len(data):
                scores = np.maximum.reduceat(scores, start, axis=1)
            for q, row in zip(queries["id"].to_numpy(), scores):
                at = np.flatnonzero(ids != q)
                at = at[best(ids[at], row[at], k)]
                found.append(pd.DataFrame({"query_id": q, "id": ids[at], "score": row[at].astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "id", "score")})
    return run


def meet(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Solve (block, slice) pairs; both sides are replicated to their pairs."""
    q = queries.join(pairs, "block").select("block", "slice", "id", "v")
    d = data.join(pairs, "slice").select("block", "slice", "id", "v")
    return q.groupBy("block", "slice").cogroup(d.groupBy("block", "slice")).applyInPandas(solver(k), _FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, scale: int = SCALE,
          slice_rows: int = SLICE_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on ``id``."""
    spark = table.sparkSession
    rows = integer_vectors(table, scale)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (usual[0]["d"] if usual else 0))
    centers = choose_pivots(rows, pivots)
    if not len(centers):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shared = spark.sparkContext.broadcast(centers)
    cells = written(to_cells(rows, shared), "knn-cells")
    queries = cells.where(is_query).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("s")).select("id", "s.*")

    # one row per pivot reaches the driver; blocks and slices are planned there
    count = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    summary = {r["cell"]: (r["n"], r["r"]) for r in
               cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}
    slices = {c: -(-n // slice_rows) for c, (n, _) in summary.items()}
    base = dict(zip(sorted(slices), np.cumsum([0] + [slices[c] for c in sorted(slices)]).tolist()))
    first_block, parts, full, at = {}, {}, 0, 0
    for c in _by_neighbour(centers, sorted(count)):
        if full and full + count[c] > block_queries:
            at, full = at + 1, 0
        first_block[c], parts[c] = at, -(-count[c] // block_queries)
        at, full = at + parts[c] - 1, count[c] if parts[c] == 1 else block_queries
    where = lambda col, m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), col)
    h = F.xxhash64(F.col("id"), F.lit(7))
    data = cells.select("id", "v", (where(F.col("cell"), base) + F.pmod(h, where(F.col("cell"), slices))).alias("slice"))
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = written(queries.select("id", "v", "cell", (
        where(F.col("cell"), first_block) + F.pmod(h, where(F.col("cell"), parts))).alias("block")), "knn-queries")

    own = {(first_block[c] + j, base[c]) for c in count for j in range(parts[c])}
    first = spark.createDataFrame(sorted(own), "block long, slice long")
    start = written(ranked(meet(queries, data, first, k), k), "knn-start")
    least = start.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("got"))
    bound = F.when(F.col("got") >= k, F.col("least").cast("double"))
    cell_ids = np.array(sorted(summary))
    radius = np.array([summary[c][1] for c in sorted(summary)])

    def reach(batches):
        p = shared.value[cell_ids]
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                top = x @ p.T + np.sqrt((x * x).sum(axis=1))[:, None] * radius
                least = b["bound"].fillna(-np.inf).to_numpy(float)[:, None]
                q, c = np.nonzero(top + 1e-6 * (1 + np.abs(top)) >= least)
                yield pd.DataFrame({"block": b["block"].to_numpy()[q], "cell": cell_ids[c]}).drop_duplicates()

    wanted = (queries.join(least, queries["id"] == least["query_id"], "left")
              .select("v", "block", bound.alias("bound")).mapInPandas(reach, "block long, cell int").distinct())
    pairs = (wanted.select("block", F.explode(F.sequence(
        where(F.col("cell"), base), where(F.col("cell"), base) + where(F.col("cell"), slices) - 1)).alias("slice"))
        .select("block", F.col("slice").cast("long").alias("slice")).join(first, ["block", "slice"], "left_anti"))
    more = meet(queries, data, written(pairs, "knn-pairs"), k)
    return ranked(start.select("query_id", "id", "score").unionByName(more), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _by_neighbour(centers: np.ndarray, cells: list[int]) -> list[int]:
    """Cells along their direction of largest spread, so that blocks are compact."""
    if len(cells) < 3:
        return cells
    x = centers[cells] - centers[cells].mean(axis=0)
    axis = np.linalg.svd(x, full_matrices=False)[2][0]
    return [cells[i] for i in np.argsort(x @ axis, kind="stable")]
