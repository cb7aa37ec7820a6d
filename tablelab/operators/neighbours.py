"""Exact nearest neighbours as a metric partition join (M16 KNN models, T5 KNN
imputation).

1. Data rows belong to the cell of their nearest pivot; pivots are a bounded
   sample by hash.  A cell's summary is its number of rows and the smallest and
   largest distance to its pivot.
2. A query first meets its home cell.  By the triangle inequality the k-th
   distance found there, or the distance within which the summaries promise k rows,
   bounds the search: of the other cells only those whose ring around the pivot
   reaches that near are joined.
3. Cells are cut into slices of about ``SLICE_ROWS`` rows and their queries into
   blocks of about ``BLOCK_QUERIES``, so that no task gets more than one of each,
   however many rows share a value; slices and blocks meet in numpy, and the
   partial lists of k are merged by query.

Only reachable (query, cell) pairs are replicated, and k rows a query come out.
Distances are sums in the order of the columns; ties go to the smaller tie value,
then to the smaller id.  Several searches can run as one: ``g`` numbers them, and
only rows of equal ``g`` meet (vectors may differ in length between them).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.functions.stats import NUMERIC_TYPES, q
from tablelab.operators.saved import Saved
from tablelab.session import cut_lineage

PIVOTS = 256
SLICE_ROWS = 4096
BLOCK_QUERIES = 2048
REACH_QUERIES = 512   # queries whose pairs with cells are made at once
MAX_PATTERNS = 256   # patterns of missing columns of one imputation
METRICS = {"euclidean": 2, "minkowski": 2, "manhattan": 1}
_FOUND = "q long, id long, t double, d double"


def powers(x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    """(rows of x, rows of y) sums of |difference|^p, added column by column."""
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        diff = x[:, j, None] - y[None, :, j]
        total += diff * diff if p == 2 else np.abs(diff)
    return total


def smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` smallest values of every row, in their order (ties: the first)."""
    rows, width = d.shape
    if width <= k:
        return np.argsort(d, axis=1, kind="stable")
    d = np.where(np.isnan(d), np.inf, d)
    last = np.partition(d, k - 1, axis=1)[:, k - 1:k]
    below, same = d < last, d == last
    keep = below | (same & (np.cumsum(same, axis=1) <= k - below.sum(1, keepdims=True)))
    at = np.nonzero(keep)[1].reshape(rows, k)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1)


def _stack(v) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


@dataclass
class Cells:
    """Pivots of every search, numbered through, and the cells' summaries."""
    p: int
    first: dict            # g -> number of its first cell
    pivots: dict           # g -> matrix
    rows: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    digits: int | None = None   # decimals to which sums of powers count

    def away(self, g, x: np.ndarray) -> np.ndarray:
        d = powers(x, self.pivots[g], self.p)
        return np.sqrt(d) if self.p == 2 else d


def choose_pivots(data: DataFrame, p: int, pivots: int) -> Cells:
    sizes = {r["g"]: r["n"] for r in data.groupBy("g").agg(F.count("*").alias("n")).collect()}
    each = max(4, pivots // max(1, len(sizes)))
    share = F.lit(0)
    for g, n in sizes.items():
        share = F.when(F.col("g") == g, F.lit(min(1 << 30, int((1 << 30) * 4.0 * each / n) + 1))).otherwise(share)
    order = Window.partitionBy("g").orderBy(F.xxhash64("v"), "id")
    drawn = (data.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < share)
             .withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("g", "v").collect())
    points: dict = {}
    for r in drawn:
        points.setdefault(r["g"], set()).add(tuple(r["v"]))
    for r in data.where(~F.col("g").isin(list(points) or [-1])).groupBy("g").agg(F.min("v").alias("v")).collect():
        points[r["g"]] = {tuple(r["v"])}   # searches of which the sample has no row
    cells, at = Cells(p, {}, {}), 0
    for g in sorted(points):
        n = max(1, min(each, int(sizes[g] ** 0.5)))
        cells.first[g], cells.pivots[g] = at, np.array(sorted(points[g])[:: max(1, len(points[g]) // n)][:n], float)
        at += len(cells.pivots[g])
    return cells


def _meet(queries: DataFrame, data: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Partial lists of k of (q, v, cell) rows against the cells' (id, t, v) rows."""
    n_queries = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not n_queries:
        return queries.sparkSession.createDataFrame([], _FOUND)
    slices = {c: max(1, -(-int(cells.rows[c]) // SLICE_ROWS)) for c in n_queries}
    blocks = {c: -(-n // BLOCK_QUERIES) for c, n in n_queries.items()}

    def of(m):
        return F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("cell"))

    def pick(c: Column, m):
        return F.pmod(F.xxhash64(c, F.lit(11)), of(m)).cast("int")

    def spread(m):
        return F.explode(F.sequence(F.lit(0), (of(m) - 1).cast("int")))

    left = queries.withColumn("block", pick(F.col("q"), blocks)).withColumn("slice", spread(slices))
    right = (data.where(F.col("cell").isin(list(n_queries))).withColumn("slice", pick(F.col("id"), slices))
             .withColumn("block", spread(blocks)))
    p, digits = cells.p, cells.digits

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values(["t", "id"])
            y, ids, ties = _stack(b["v"]), b["id"].to_numpy(), b["t"].to_numpy()
            for lo in range(0, len(a), 256):
                some = a.iloc[lo:lo + 256]
                d = powers(_stack(some["v"]), y, p)
                d = d if digits is None else np.round(d, digits)
                at = smallest(d, k)
                out.append(pd.DataFrame({"q": np.repeat(some["q"].to_numpy(), at.shape[1]), "id": ids[at].ravel(),
                                         "t": ties[at].ravel(), "d": np.take_along_axis(d, at, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "id": [], "t": [], "d": []}).astype(
            {"q": "int64", "id": "int64", "t": "float64", "d": "float64"})

    keys = ["cell", "slice", "block"]
    return (left.select(*keys, "q", "v").groupBy(*keys).cogroup(right.select(*keys, "id", "t", "v").groupBy(*keys))
            .applyInPandas(solve, _FOUND))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("d", "t", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, data: DataFrame, k: int, metric: str = "euclidean", pivots: int = PIVOTS,
            digits: int | None = None) -> DataFrame:
    """q, id, t, d, rank: the k nearest rows of ``data`` (g, id, t, v) to each of
    ``queries`` (g, q, v).  Vectors hold no nulls; a search without data gives no rows.
    With ``digits``, sums of powers that are equal to so many decimals are ties."""
    spark, p = data.sparkSession, METRICS[metric]
    data = data.select("g", F.col("id").cast("long"), F.col("t").cast("double"), F.col("v").cast("array<double>"))
    cells = choose_pivots(data, p, pivots)
    if not cells.first:
        return spark.createDataFrame([], _FOUND + ", rank int")
    cells.digits = digits
    total = sum(map(len, cells.pivots.values()))

    def to_cells(batches):
        for b in batches:
            for g, part in b.groupby("g"):
                away = cells.away(g, _stack(part["v"]))
                at = away.argmin(axis=1)
                yield part.assign(cell=at + cells.first[g], away=away[np.arange(len(at)), at])[["id", "t", "v", "cell", "away"]]

    data = cut_lineage(data.mapInPandas(to_cells, "id long, t double, v array<double>, cell long, away double"))
    cells.rows, cells.low, cells.high = np.zeros(total), np.full(total, np.inf), np.zeros(total)
    for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("a"), F.max("away").alias("z")).collect():
        cells.rows[r["cell"]], cells.low[r["cell"]], cells.high[r["cell"]] = r["n"], r["a"], r["z"]
    have = list(cells.first)
    asked = cut_lineage(queries.where(F.col("g").isin(have)).select(
        "g", F.col("q").cast("long").alias("q"), F.col("v").cast("array<double>").alias("v")))

    def home(batches):
        for b in batches:
            for g, part in b.groupby("g"):
                away = cells.away(g, _stack(part["v"]))
                at = slice(cells.first[g], cells.first[g] + away.shape[1])
                away[:, cells.rows[at] == 0] = np.inf
                yield part.assign(cell=away.argmin(axis=1) + cells.first[g])[["q", "v", "cell"]]

    first = cut_lineage(_meet(asked.mapInPandas(home, "q long, v array<double>, cell long"), data, cells, k))
    start = cut_lineage(_best(first, k))
    slack = 0.0 if digits is None else 10.0 ** -digits   # what rounds to the farthest may lie beyond it
    reached = start.groupBy("q").agg(F.max("d").alias("far"), F.count("*").alias("got"))

    def others(batches):
        for b in batches:
            for g, part in ((g, every.iloc[lo:lo + REACH_QUERIES]) for g, every in b.groupby("g")
                            for lo in range(0, len(every), REACH_QUERIES)):
                away = cells.away(g, _stack(part["v"]))
                at = slice(cells.first[g], cells.first[g] + away.shape[1])
                rows, low, high = cells.rows[at], cells.low[at], cells.high[at]
                near = np.where(rows > 0, away, np.inf)
                own = near.argmin(axis=1)
                far = np.where(part["got"].to_numpy() >= k, part["far"].to_numpy() + slack, np.inf)
                far = np.sqrt(far) if p == 2 else far
                upper = np.where(rows > 0, away + high, np.inf)       # all rows of a cell are within
                order = np.argsort(upper, axis=1)
                enough = np.cumsum(rows[order], axis=1) >= k
                which = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
                promised = np.where(enough.any(axis=1), np.take_along_axis(upper, which, axis=1)[:, 0], np.inf)
                promised = np.sqrt(promised * promised + slack) if p == 2 else promised + slack
                bound = np.minimum(far, promised) * (1 + 1e-9) + 1e-12
                lower = np.maximum(np.maximum(away - high, low - away), 0)
                reach = (rows > 0) & (lower * (1 - 1e-9) <= bound[:, None])
                reach[np.arange(len(own)), own] = False
                i, c = np.nonzero(reach)
                yield part.iloc[i].assign(cell=c + cells.first[g])[["q", "v", "cell"]]

    wanted = (asked.join(reached, "q", "left").fillna({"got": 0, "far": 0.0})
              .mapInPandas(others, "q long, v array<double>, cell long"))
    more = _meet(cut_lineage(wanted), data, cells, k)
    return _best(start.select("q", "id", "t", "d").unionByName(more), k).withColumn(
        "d", F.sqrt("d") if p == 2 else F.col("d"))


def weight(kind: str, nearest_one: Column) -> Column:
    """Votes of a neighbour: one each, or 1 / distance (rows at distance 0, if any, alone)."""
    if kind == "uniform":
        return F.lit(1.0)
    return F.when(nearest_one == 0, (F.col("d") == 0).cast("double")).otherwise(1.0 / F.col("d"))


# ---------------------------------------------------------------------- M16 models

class KNN(Estimator):
    """Features, label -> prediction (and probability for classes).  Ties in
    distance go to the smaller label, ties in votes to the smaller class."""

    def __init__(self, kind: str, n_classes: int = 0, k: int = 5, weights: str = "uniform", metric: str = "minkowski"):
        super().__init__()
        if metric not in METRICS or weights not in ("uniform", "distance"):
            raise ValueError(f"unknown metric {metric!r} or weights {weights!r}")
        self.options = {"kind": kind, "n_classes": n_classes, "k": k, "weights": weights, "metric": metric}

    def _fit(self, dataset: DataFrame) -> "KNNStage":
        rows = cut_lineage(dataset.select(F.monotonically_increasing_id().alias("id"), F.col("label").cast("double").alias("t"),
                                          vector_to_array("features").alias("v")))
        return KNNStage(self.options, rows)


class KNNStage(Saved):
    def __init__(self, options: dict, rows: DataFrame):
        super().__init__()
        self.options, self.rows = options, rows

    def state(self) -> dict:
        return self.options

    def tables(self) -> dict:
        return {"rows": self.rows}

    @classmethod
    def restore(cls, state: dict, path: str) -> "KNNStage":
        from pyspark.sql import SparkSession
        return cls(state, SparkSession.getActiveSession().read.parquet(f"{path}/tables/rows"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        o = self.options
        asked = cut_lineage(dataset.withColumn("__q", F.monotonically_increasing_id()))
        found = nearest(asked.select(F.lit(0).alias("g"), F.col("__q").alias("q"), vector_to_array("features").alias("v")),
                        self.rows.select(F.lit(0).alias("g"), "id", "t", "v"), o["k"], o["metric"])
        found = cut_lineage(found)  # metrics and folds read predictions several times
        votes = found.withColumn("w", weight(o["weights"], F.min("d").over(Window.partitionBy("q"))))
        if o["kind"] == "regression":
            out = votes.groupBy("q").agg((F.sum(F.col("w") * F.col("t")) / F.sum("w")).alias("prediction"))
        else:
            per = votes.groupBy("q", "t").agg(F.sum("w").alias("w"))
            out = per.groupBy("q").agg(F.max(F.struct("w", (-F.col("t")).alias("t")))["t"].alias("least"),
                                       F.map_from_entries(F.collect_list(F.struct(F.col("t").cast("int"), "w"))).alias("m"),
                                       F.sum("w").alias("total"))
            share = F.transform(F.sequence(F.lit(0), F.lit(max(0, o["n_classes"] - 1))),
                                lambda c: F.coalesce(F.element_at("m", c), F.lit(0.0)) / F.col("total"))
            out = out.select("q", array_to_vector(share).alias("probability"), (-F.col("least")).alias("prediction"))
        return asked.join(out.withColumnRenamed("q", "__q"), "__q", "left").drop("__q")


# ------------------------------------------------------------------- T5 imputation

def impute_knn(df: DataFrame, key: list[str], cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """Nulls of the numeric columns become the mean over the ``k`` nearest rows that
    have the column, by Euclidean distance over the coordinates that both rows have,
    scaled up to all columns; ties (squares equal but for rounding, to about 14 digits of
    the largest value's square) go to the smaller key (a single integer column, else a
    hash of the key columns).

    Receivers and donors are grouped by which columns they have; every pair of
    groups with a common and a wanted column is one search of a joint metric join.
    Rows without any of the columns get column means; a column without values stays
    null.  At most ``MAX_PATTERNS`` patterns of missing columns."""
    names = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in key]
    n = len(names)
    single = len(key) == 1 and df.schema[key[0]].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint")
    tie = q(key[0]).cast("double") if single else F.xxhash64(*[q(c) for c in key]).cast("double")
    value = [F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")) for c in names]
    mask = sum((F.when(v.isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(value)), F.lit(0)).cast("long")
    rows = cut_lineage(df.select("*", F.monotonically_increasing_id().alias("__id"), tie.alias("__t"), mask.alias("__m"),
                                 F.array(*value).alias("__v")))
    patterns = [r["__m"] for r in rows.groupBy("__m").count().limit(MAX_PATTERNS + 1).collect()]
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of missing columns")
    full = (1 << n) - 1
    pairs = [(m, d) for m in sorted(patterns) for d in sorted(patterns) if m != full and m & d and d & ~m]
    means = rows.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)],
                     *[F.max(F.when(F.abs(v) < float("inf"), F.abs(v))).alias(f"x{i}") for i, v in enumerate(value)]).first()
    largest = max((means[f"x{i}"] or 0.0 for i in range(n)), default=0.0)
    digits = min(300, max(-300, 14 - math.floor(2 * math.log10(largest)))) if largest else 0
    filled = [F.lit(means[f"m{i}"]) for i in range(n)]
    if pairs:
        def side(which: int, as_: str):
            cases = F.array(*[F.struct(F.lit(g).alias("g"), F.array(*[F.lit(i) for i in range(n) if (m & d) >> i & 1]).alias("at"))
                              for g, (m, d) in enumerate(pairs)])
            of = F.create_map(*[x for g, pair in enumerate(pairs) for x in (F.lit(g), F.lit(pair[which]))])
            hit = rows.withColumn("c", F.explode(F.filter(cases, lambda s: F.element_at(of, s["g"]) == F.col("__m"))))
            return hit.select(F.col("c")["g"].alias("g"), F.col("__id").alias(as_), F.col("__t").alias("t"),
                              F.transform(F.col("c")["at"], lambda i: F.get("__v", i)).alias("v"))

        # a receiver takes part in one search per donor pattern: number them apart
        many = len(pairs)
        asked = side(0, "q").select("g", (F.col("q") * many + F.col("g")).alias("q"), "v")
        found = nearest(asked, side(1, "id"), k, digits=digits).withColumn("q", F.expr(f"q div {many}"))
        # distances of different pairs are comparable once scaled to all columns
        shared = F.create_map(*[x for m, d in pairs for x in (F.lit(f"{m}/{d}"), F.lit(n / (m & d).bit_count()))])
        donors = rows.select(F.col("__id").alias("id"), F.col("__m").alias("dm"), F.col("__v").alias("dv"))
        takers = rows.where(F.col("__m") != full).select(F.col("__id").alias("q"), F.col("__m").alias("qm"))
        each = (found.join(donors, "id").join(takers, "q")
                .withColumn("d", F.rint(F.col("d") * F.col("d") * F.element_at(shared, F.concat_ws("/", "qm", "dm")) * 10.0 ** digits))
                .select("q", "d", "t", "id", "qm", F.posexplode("dv").alias("i", "x"))
                .where(F.col("x").isNotNull() & (F.expr("shiftright(qm, i)").bitwiseAND(F.lit(1)) == 0)))
        order = Window.partitionBy("q", "i").orderBy("d", "t", "id")
        got = (each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
               .groupBy("q", "i").agg(F.avg("x").alias("x")).groupBy("q")
               .agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("__f")))
        rows = rows.join(got.withColumnRenamed("q", "__id"), "__id", "left")
        filled = [F.coalesce(F.element_at("__f", i), f) for i, f in enumerate(filled)]
    return rows.select(*[F.coalesce(value[names.index(c)], filled[names.index(c)]).alias(c) if c in names else q(c)
                         for c in df.columns])
