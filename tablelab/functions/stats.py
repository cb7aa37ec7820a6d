"""Shared statistics building blocks.

Everything here returns lazy DataFrames or Column expressions.  The central
piece is :func:`rank_table`: exact, distributed ranks of values per group
(column).  Exact quantiles, ECDF, Spearman ranks and rank-sum AUC all derive
from it, so no operator ever needs Spark's ``percentile`` aggregate (which
merges every distinct value of a group inside one task).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)

# Distinct values per window partition in rank_table before it splits a group
# into range buckets.
VALUES_PER_BUCKET = 2_000_000


def q(name: str) -> Column:
    """Column by (possibly odd) name."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


# --------------------------------------------------------------------------
# long (unpivoted) forms
# --------------------------------------------------------------------------

def unpivot(df: DataFrame, cols: list[str], value_type: str = "double",
            keep: list[str] | None = None, name_col: str = "column",
            value_col: str = "x") -> DataFrame:
    """(keep..., column, x) with one row per input row and column; nulls kept.
    Project narrow first: only ``keep`` and ``cols`` survive."""
    keep = keep or []
    if not cols:
        raise ValueError("unpivot needs at least one column")
    args = [x for c in cols for x in (F.lit(c), q(c).cast(value_type))]
    return df.select(*[q(k) for k in keep], F.stack(F.lit(len(cols)), *args).alias(name_col, value_col))


def value_counts(long_df: DataFrame, group: str | list[str] = "column", value: str = "x") -> DataFrame:
    """Non-null (group, value, cnt).  Partial aggregation happens map-side, so a
    value held by a third of all rows is one row per task before the shuffle."""
    groups = [group] if isinstance(group, str) else list(group)
    return (long_df.where(F.col(value).isNotNull())
            .groupBy(*groups, value).agg(F.count(F.lit(1)).alias("cnt")))


def column_value_counts(df: DataFrame, cols: list[str], value_type: str = "double",
                        value_col: str = "x") -> DataFrame:
    """(column, value, cnt) for the non-null values of each column.

    One aggregate per column, unioned: each reads only its own column from
    the columnar scan and groups on the bare value (map-side combined), which
    is cheaper than unpivoting every row into (name, value) pairs and keeps a
    hot value of one column from touching the others."""
    parts = [df.where(q(c).isNotNull()).groupBy(q(c).cast(value_type).alias(value_col))
             .agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(c).alias("column"), value_col, "cnt") for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group_totals(vc: DataFrame, group: str | list[str] = "column") -> DataFrame:
    """(group..., n, nd): values and distinct values per group."""
    groups = [group] if isinstance(group, str) else list(group)
    return vc.groupBy(*groups).agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("nd"))


def prefix_sums(vc: DataFrame, group: str | list[str] = "column", value: str = "x",
                sum_cols: tuple[str, ...] = ("cnt",), max_distinct: int | None = None,
                values_per_bucket: int | None = None, few_groups: bool = True) -> DataFrame:
    """For each row of ``vc`` (one row per distinct ``value`` within a group)
    add ``<c>_before`` = sum of ``c`` over the rows of the same group with a
    smaller value, for every c in ``sum_cols``.

    A running sum over a whole group would put every distinct value of a
    column in one window partition.  When a group has more than
    ``values_per_bucket`` distinct values it is split into range buckets
    (numbers: edges from ``approx_percentile`` of the distinct values; text: edges
    from a hash-chosen sample of the distinct values); bucket totals are
    prefix-summed on a small frame and added back, so the result stays exact
    while each window partition holds about ``values_per_bucket`` values.
    ``max_distinct`` (an estimate is enough, e.g. ``approx_count_distinct``
    from an aggregate the caller runs anyway) decides the bucket count;
    without it one small job measures it.

    ``few_groups`` says the groups are bounded by the schema (columns,
    classes, pairs): then per-group edge and offset tables are broadcast.
    Groups that grow with the data (conversations, users) pass False and
    those small tables are joined with a shuffle instead."""
    groups = [group] if isinstance(group, str) else list(group)
    values_per_bucket = values_per_bucket or VALUES_PER_BUCKET
    bc = F.broadcast if few_groups else (lambda d: d)
    if max_distinct is None:
        max_distinct = vc.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, math.ceil(max_distinct / values_per_bucket))
    if buckets == 1:
        wv = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        out = vc
        for c in sum_cols:
            out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(wv), F.lit(0)))
        return out
    if isinstance(vc.schema[value].dataType, T.StringType):
        place, edges = F.col(value), _text_edges(vc, groups, value, buckets, max_distinct)
    else:
        place = F.col(value).cast("double")
        probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        edges = vc.groupBy(*groups).agg(F.percentile_approx(place, probs, 10 * buckets).alias("_edges"))
    keyed = (vc.join(bc(edges), groups, "left")
             .withColumn("_bucket", F.coalesce(F.size(F.filter("_edges", lambda e: e < place)), F.lit(0)))
             .drop("_edges"))
    btot = keyed.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(f"_b_{c}") for c in sum_cols])
    wb = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = btot.select(*groups, "_bucket", *[F.coalesce(F.sum(f"_b_{c}").over(wb), F.lit(0)).alias(f"_o_{c}")
                                                for c in sum_cols])
    wv = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(bc(offsets), groups + ["_bucket"], "left")
    for c in sum_cols:
        out = out.withColumn(f"{c}_before", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wv), F.lit(0)))
    return out.drop("_bucket", *[f"_o_{c}" for c in sum_cols])


EDGE_SAMPLE = 64  # sampled values per text bucket


def _text_edges(vc: DataFrame, groups: list[str], value: str, buckets: int, max_distinct: int) -> DataFrame:
    """(group..., _edges): about ``buckets`` - 1 texts that cut each group's
    sorted distinct texts evenly, from about ``EDGE_SAMPLE`` sampled texts per
    bucket, whatever prefixes the texts share."""
    every = max(1, int(max_distinct // (buckets * EDGE_SAMPLE)))
    drawn = vc.where(F.pmod(F.xxhash64(value), F.lit(every)) == 0).groupBy(*groups).agg(
        F.array_sort(F.collect_list(value)).alias("_all"))   # about buckets * EDGE_SAMPLE texts
    step = F.greatest(F.lit(1), F.floor(F.size("_all") / F.lit(buckets))).cast("int")
    return drawn.select(*groups, F.filter("_all", lambda x, i: (i > 0) & (i % step == 0)).alias("_edges"))


def rank_table(vc: DataFrame, group: str | list[str] = "column", value: str = "x",
               totals: DataFrame | None = None, max_distinct: int | None = None,
               values_per_bucket: int | None = None, few_groups: bool = True) -> DataFrame:
    """Exact ranks over value counts ``(group..., value, cnt)``: adds
    ``cum_before`` (values strictly smaller in the group) and ``n`` (group
    total).  See :func:`prefix_sums` for how big groups are split."""
    groups = [group] if isinstance(group, str) else list(group)
    if totals is None:
        totals = group_totals(vc, groups).select(*groups, "n")
    ranked = prefix_sums(vc, groups, value, ("cnt",), max_distinct, values_per_bucket, few_groups).withColumnRenamed(
        "cnt_before", "cum_before")
    tot = totals.select(*groups, "n")
    return ranked.join(F.broadcast(tot) if few_groups else tot, groups, "left")


def exact_quantiles(ranked: DataFrame, probs: list[float], group: str | list[str] = "column",
                    value: str = "x", totals: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas / ``quantile_cont`` rule) from a
    :func:`rank_table`.  Output ``(group..., prob, qv)``.  The probe frame has
    ``groups × len(probs)`` rows, so it is broadcast; the rank table is only
    filtered, never collected."""
    groups = [group] if isinstance(group, str) else list(group)
    totals = totals if totals is not None else ranked.select(*groups, "n").distinct()
    probe = (totals.select(*groups, "n").withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
             .withColumn("_h", (F.col("n") - 1) * F.col("prob"))
             .withColumn("_lo", F.floor("_h"))
             .withColumn("_hi", F.ceil("_h"))
             .drop("n"))
    hit = ranked.join(F.broadcast(probe), groups, "inner").where(
        (F.col("cum_before") <= F.col("_hi")) & (F.col("cum_before") + F.col("cnt") > F.col("_lo")))
    covers_lo = (F.col("cum_before") <= F.col("_lo")) & (F.col("cum_before") + F.col("cnt") > F.col("_lo"))
    covers_hi = (F.col("cum_before") <= F.col("_hi")) & (F.col("cum_before") + F.col("cnt") > F.col("_hi"))
    agg = hit.groupBy(*groups, "prob", "_h", "_lo").agg(
        F.max(F.when(covers_lo, F.col(value).cast("double"))).alias("_vlo"),
        F.max(F.when(covers_hi, F.col(value).cast("double"))).alias("_vhi"))
    return agg.select(*groups, "prob",
                      (F.col("_vlo") + (F.col("_h") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo"))).alias("qv"))


def column_counts(df: DataFrame, cols: list[str]) -> tuple[DataFrame, int]:
    """Non-null count per column (one aggregate) as a (column, n) frame built
    on the driver (one row per column), and an upper bound of the distinct
    values per column: the count itself when that is below
    ``VALUES_PER_BUCKET`` (so no bucketing is needed), else an
    ``approx_count_distinct`` estimate from a second aggregate."""
    row = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    counts = [int(row[f"n{i}"]) for i in range(len(cols))]
    totals = df.sparkSession.createDataFrame(list(zip(cols, counts)), "column string, n long")
    bound = max(counts or [0])
    if bound > VALUES_PER_BUCKET:
        d = df.agg(*[F.approx_count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        bound = max(int(d[f"d{i}"]) for i in range(len(cols)))
    return totals, bound


MAX_BRACKETS = 64
BRACKET = 10_000  # accuracy of the first scan: a bracket holds a few ranks in so many


def _bracket(first, i: int, marks: list[float], p: float, wide: float) -> tuple[float, float]:
    """First guess of values between which the rank of ``p`` in column ``i`` lies."""
    at, n = first[f"m{i}"], first[f"n{i}"]
    # in a short column neighbouring ranks lie further apart than the margin: keep all of it
    lo = first[f"a{i}"] if p - wide <= 0 or n < 4 * BRACKET else at[marks.index(max(0.0, p - wide))]
    hi = first[f"z{i}"] if p + wide >= 1 or n < 4 * BRACKET else at[marks.index(min(1.0, p + wide))]
    return float(lo), float(hi)


def quantiles_long(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """(column, prob, qv) exact quantiles of numeric columns without sorting
    the columns.

    One aggregate (``percentile_approx``) brackets the wanted ranks of all
    columns; a second one counts the values below and up to the end of each
    bracket; one that doesn't hold its ranks is opened to the column's end on that
    side and counted again.  The returned plan scans once more and shuffles only the values inside brackets (about
    6 / ``BRACKET`` of a column per rank, map-side combined), whose exact ranks
    are picked.  More than ``MAX_BRACKETS`` ranks (Q-Q points) share the cells of
    :func:`quantiles_by_cells`."""
    spark = df.sparkSession
    schema = "column string, prob double, qv double"
    probs = [float(p) for p in probs]
    if len(cols) * len(probs) > MAX_BRACKETS:
        return quantiles_by_cells(df, cols, probs)
    if not cols or not probs:
        return spark.createDataFrame([], schema)
    xs = [q(c).cast("double") for c in cols]
    wide = 3.0 / BRACKET
    marks = sorted({m for p in probs for m in (max(0.0, p - wide), min(1.0, p + wide))})
    first = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)],
                   *[F.percentile_approx(x, F.array(*[F.lit(m) for m in marks]), BRACKET).alias(f"m{i}") for i, x in enumerate(xs)],
                   *[f(x).alias(f"{k}{i}") for i, x in enumerate(xs) for k, f in (("a", F.min), ("z", F.max))]).first()
    asked = [[i, c, p, (first[f"n{i}"] - 1) * p, *_bracket(first, i, marks, p, wide)]
             for i, c in enumerate(cols) if first[f"n{i}"] for p in probs]
    if not asked:
        return spark.createDataFrame([], schema)
    opened = False
    while True:
        brackets: dict = {}   # (column, low, high) -> number
        for i, _, _, _, lo, hi in asked:
            brackets.setdefault((i, lo, hi), len(brackets))
        row = df.agg(*[F.count_if(xs[i] < F.lit(lo)).alias(f"b{k}") for (i, lo, _), k in brackets.items()],
                     *[F.count_if(xs[i] <= F.lit(hi)).alias(f"u{k}") for (i, _, hi), k in brackets.items()]).first()
        outside = False
        for w in asked:
            i, _, _, h, lo, hi = w
            k = brackets[i, lo, hi]
            if row[f"b{k}"] > math.floor(h) and lo > first[f"a{i}"]:
                w[4], outside = float(first[f"a{i}"]), True
            if row[f"u{k}"] <= math.ceil(h) and hi < first[f"z{i}"]:
                w[5], outside = float(first[f"z{i}"]), True
        if not outside:
            break
        opened = True
    below = {f"b{k}": row[f"b{k}"] for k in brackets.values()}
    wanted = [(brackets[i, lo, hi], c, p, h) for i, c, p, h, lo, hi in asked]
    inside = {k: xs[i].between(F.lit(lo), F.lit(hi)) for (i, lo, hi), k in brackets.items()}
    any_inside = None
    for cond in inside.values():
        any_inside = cond if any_inside is None else any_inside | cond
    hits = F.array_compact(F.array(*[F.when(inside[k], F.struct(F.lit(k).alias("k"), xs[i].alias("x")))
                                     for (i, _, _), k in brackets.items()]))
    counts = (df.where(any_inside).select(F.explode(hits).alias("h")).select("h.k", "h.x")
              .groupBy("k", "x").agg(F.count(F.lit(1)).alias("cnt")))
    largest = max(first[f"n{i}"] for i in range(len(cols)))
    bound = largest if opened or largest <= VALUES_PER_BUCKET else max(1, int(largest * 4 * wide))
    ranked = prefix_sums(counts, "k", "x", ("cnt",), max_distinct=bound)
    probe = spark.createDataFrame([(k, c, p, h, int(math.floor(h)) - below[f"b{k}"], int(math.ceil(h)) - below[f"b{k}"])
                                   for k, c, p, h in wanted],
                                  "k int, column string, prob double, h double, lo long, hi long")
    at = lambda r: F.max(F.when((F.col("cnt_before") <= F.col(r)) & (F.col(r) < F.col("cnt_before") + F.col("cnt")), F.col("x")))
    part = F.col("h") - F.floor("h")
    return (ranked.join(F.broadcast(probe), "k")   # one row per (column, prob)
            .where((F.col("cnt_before") <= F.col("hi")) & (F.col("cnt_before") + F.col("cnt") > F.col("lo")))
            .groupBy("column", "prob", "h").agg(at("lo").alias("v"), at("hi").alias("w"))
            .select("column", "prob", (F.col("v") + part * (F.col("w") - F.col("v"))).alias("qv")))


CELLS, SUBCELLS = 4096, 64
RANKED_BELOW = 2_000_000   # shorter columns are ranked: one scan and a small shuffle cost less than counting cells
FEW_VALUES = 0.05   # share of a column that the wanted cells may hold without being cut again


def quantiles_by_cells(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """(column, prob, qv) exact quantiles for hundreds of ranks.

    One scan counts each column by ``CELLS`` cells of equal width; the running
    sums say which cells hold wanted ranks.  Where those hold more than
    ``FEW_VALUES`` of a column (skewed values), a second scan counts them by
    ``SUBCELLS`` cells each.  The returned plan scans once more and shuffles only the
    values inside wanted cells (map-side combined, so a hot value is one row a task).
    What reaches the driver depends on columns, cells and ranks.  Columns of at most
    ``RANKED_BELOW`` values, and those with infinite or NaN values, which have no
    cells, are ranked by :func:`rank_table`, with the same result."""
    spark = df.sparkSession
    xs = {c: q(c).cast("double") for c in cols}
    r = df.agg(*[f(xs[c]).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("n", F.count), ("a", F.min), ("z", F.max))]).first()
    n = {c: r[f"n{i}"] for i, c in enumerate(cols)}
    ends = {c: (r[f"a{i}"], r[f"z{i}"]) for i, c in enumerate(cols) if r[f"n{i}"]}
    odd = [c for c, (a, z) in ends.items() if n[c] <= RANKED_BELOW or not math.isfinite(z - a)]
    celled = [c for c in cols if c in ends and c not in odd]

    def place(c):   # rounding keeps the order of values, so cells hold neighbours
        a, z = ends[c]
        u = (xs[c] - F.lit(a)) / F.lit(z - a) * F.lit(float(CELLS)) if z > a else xs[c] * 0.0
        return F.when(u.isNotNull(), F.least(u, F.lit(CELLS - 1 / (2 * SUBCELLS))))   # least passes over nulls

    def counted(keys: dict):
        """(column, key) -> count of the rows with a key."""
        parts = [df.select(k.alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("cnt"))
                 .select(F.lit(c).alias("column"), "k", "cnt") for c, k in keys.items()]
        out: dict = {c: {} for c in keys}
        for row in _union(parts).collect() if parts else []:   # at most a row per cell
            out[row["column"]][row["k"]] = row["cnt"]
        return out

    def wanted_cells(c, counts, targets, before=0):
        """(key, values before it, targets inside) of the cells in order that hold wanted ranks."""
        out, at = [], 0
        for k in sorted(counts):
            inside = []
            while at < len(targets) and targets[at] < before + counts[k]:
                inside.append(targets[at])
                at += 1
            if inside:
                out.append((k, before, inside))
            before += counts[k]
        return out

    ranks = {c: sorted({f((n[c] - 1) * p) for p in probs for f in (math.floor, math.ceil)}) for c in celled}
    cell = {c: F.floor(place(c)).cast("int") for c in celled}
    first = counted(cell)
    held = {c: wanted_cells(c, first[c], ranks[c]) for c in celled}
    crowded = [c for c in celled if sum(first[c][k] for k, _, _ in held[c]) > FEW_VALUES * n[c]]
    key = {c: cell[c] * SUBCELLS for c in celled}
    sub = {c: cell[c] * SUBCELLS + F.floor((place(c) - cell[c]) * SUBCELLS).cast("int") for c in crowded}
    second = counted({c: F.when(cell[c].isin([k for k, _, _ in held[c]]), sub[c]) for c in crowded})
    probe, largest = [], 0
    for c in celled:
        cells = [(k * SUBCELLS, b, t, first[c][k]) for k, b, t in held[c]]
        if c in sub:
            key[c] = sub[c]
            cells = [(k, b, t, second[c][k]) for j, b0, t0 in held[c] for k, b, t in wanted_cells(
                c, {k: v for k, v in second[c].items() if k // SUBCELLS == j}, t0, b0)]
        largest = max([largest, *(m for _, _, _, m in cells)])
        probe += [(c, k, t, t - b) for k, b, inside, _ in cells for t in inside]
    out = None
    if celled:
        keys = {c: [k for d, k, _, _ in probe if d == c] for c in celled}
        counts = _union([df.select(key[c].alias("k"), xs[c].alias("x")).where(F.col("k").isin(sorted(set(keys[c]))))
                         .groupBy("k", "x").agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(c).alias("column"), "k", "x", "cnt")
                         for c in celled])
        ranked = prefix_sums(counts, ["column", "k"], "x", ("cnt",), max_distinct=largest)
        found = ranked.join(F.broadcast(spark.createDataFrame(probe, "column string, k int, rank long, inside long")), ["column", "k"]).where(
            (F.col("cnt_before") <= F.col("inside")) & (F.col("inside") < F.col("cnt_before") + F.col("cnt"))).select("column", "rank", "x")
        asked = spark.createDataFrame([(c, p, h, int(math.floor(h)), int(math.ceil(h))) for c in celled for p in probs
                                       for h in [(n[c] - 1) * p]], "column string, prob double, h double, lo long, hi long")
        at = lambda w: F.max(F.when(F.col("rank") == F.col(w), F.col("x")))
        out = (found.join(F.broadcast(asked), "column").where((F.col("rank") == F.col("lo")) | (F.col("rank") == F.col("hi")))
               .groupBy("column", "prob", "h").agg(at("lo").alias("v"), at("hi").alias("w"))
               .select("column", "prob", (F.col("v") + (F.col("h") - F.floor("h")) * (F.col("w") - F.col("v"))).alias("qv")))
    if odd:
        totals, nd = column_counts(df, odd)
        rest = exact_quantiles(rank_table(column_value_counts(df, odd), totals=totals, max_distinct=nd), probs, totals=totals)
        out = rest.select("column", "prob", "qv") if out is None else out.unionByName(rest.select("column", "prob", "qv"))
    return out if out is not None else spark.createDataFrame([], "column string, prob double, qv double")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quantiles_wide(df: DataFrame, cols: list[str], probs: list[float],
                   names: list[str] | None = None) -> DataFrame:
    """(column, <name per prob>...) exact quantiles (see :func:`quantiles_long`)."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    qs = quantiles_long(df, cols, probs)
    return qs.groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("qv"))).alias(nm) for p, nm in zip(probs, names)])


def average_ranks(ranked: DataFrame) -> DataFrame:
    """Average (tie-shared) 1-based rank per distinct value."""
    return ranked.withColumn("avg_rank", F.col("cum_before") + (F.col("cnt") + 1) / 2.0)


# --------------------------------------------------------------------------
# moment corrections (Spark gives population moments)
# --------------------------------------------------------------------------

def sample_skew(skew_pop: Column, n: Column) -> Column:
    """Bias-corrected G1 from Spark's population skewness; null below 3 rows.
    A constant column (Spark null) counts as 0, as pandas reports."""
    nn = n.cast("double")
    return F.when(n >= 3, F.coalesce(skew_pop, F.lit(0.0)) * F.sqrt(nn * (nn - 1)) / (nn - 2))


def sample_kurt(kurt_pop: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2; null below 4 rows, 0 for constants."""
    nn = n.cast("double")
    return F.when(n >= 4, F.when(kurt_pop.isNull(), F.lit(0.0)).otherwise(
        (nn - 1) / ((nn - 2) * (nn - 3)) * ((nn + 1) * kurt_pop + 6)))


# Coefficients of Acklam's rational approximation of the normal quantile
# (relative error below 1.2e-9), highest power first.
NORMAL_CENTRE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716,
                  2.506628277459239),
                 (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
NORMAL_TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968,
                2.938163982698783),
               (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
NORMAL_TAIL_BELOW = 0.02425


def normal_quantile_sql(p: str) -> str:
    """Inverse of the normal distribution function as SQL text for a probability
    expression ``p`` inside (0, 1); read alike by Spark and other engines."""
    def power_sum(coefficients, x):
        out = f"CAST({coefficients[0]!r} AS DOUBLE)"
        for c in coefficients[1:]:
            out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
        return out

    d = f"({p} - 0.5)"
    t = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    centre = f"{power_sum(NORMAL_CENTRE[0], f'({d} * {d})')} * {d} / {power_sum(NORMAL_CENTRE[1], f'({d} * {d})')}"
    tail = f"{power_sum(NORMAL_TAIL[0], t)} / {power_sum(NORMAL_TAIL[1], t)}"
    return (f"CASE WHEN least({p}, 1 - {p}) >= {NORMAL_TAIL_BELOW} THEN {centre} "
            f"WHEN {p} < 0.5 THEN {tail} ELSE -({tail}) END")


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt_col: Column | None = None, salt_buckets: int = 16) -> DataFrame:
    """Rows ranked 1..k per group by ``order`` (adds ``rank``).

    Two stages so no window partition holds a whole group: first the top k
    within (group, salt bucket), then the top k among the
    ``k * salt_buckets`` survivors of each group.  ``order`` must be a total
    order (end it with a unique key) for the result to be deterministic."""
    salt = F.pmod(F.xxhash64(salt_col if salt_col is not None else F.struct(*df.columns)), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    stage1 = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
              .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    return stage1.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)


def sample_key(cols: list[str], seed: int = 42, modulus: int = 1000003) -> Column:
    """Deterministic pseudo-random sample order on non-negative integer keys,
    replayable in any SQL engine: ``((seed + sum(k_i * (2i+7))) % m * 48271 + 11) % m``.
    Intermediate values stay far below the 64-bit range."""
    acc = F.lit(seed).cast("long")
    for i, c in enumerate(cols):
        acc = acc + F.pmod(q(c).cast("long"), F.lit(modulus)) * F.lit(2 * i + 7)
    return F.pmod(F.pmod(acc, F.lit(modulus)) * F.lit(48271) + F.lit(11), F.lit(modulus))


def sample_key_sql(cols: list[str], seed: int = 42, modulus: int = 1000003) -> str:
    """The same key as DuckDB / ANSI SQL text."""
    acc = " + ".join([str(seed)] + [f"({c} % {modulus}) * {2 * i + 7}" for i, c in enumerate(cols)])
    return f"((({acc}) % {modulus}) * 48271 + 11) % {modulus}"


def hash_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest sample key (ties broken by the key): a
    distributed top-n, replayable by SQL."""
    return df.orderBy(sample_key(key, seed), *[q(c) for c in key]).limit(n)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame (an aggregate result) to every row
    of ``df``: a join with one broadcast row."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def pairwise_sums(df: DataFrame, cols: list[str]) -> dict:
    """Pairwise-complete sufficient statistics for all column pairs in one pass.

    With A = values (0 where null) and M = presence indicators, every
    pairwise-complete sum is a Gram matrix: n_ab = M'M, sum a = A'M,
    sum a^2 = (A*A)'M, sum ab = A'A.  Each task computes them for its rows
    with numpy (values shifted by a per-column centre from a first cheap
    aggregate, for numerical stability), emits one row of p x p matrices, and
    Spark sums those rows.  Returns numpy arrays keyed n, sa, saa, sab
    (p x p each, driver-side size depends only on the number of columns) and
    the shift used."""
    import numpy as np
    p = len(cols)
    shift_row = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shift = [float(shift_row[f"m{i}"]) if shift_row[f"m{i}"] is not None else 0.0 for i in range(p)]
    names = [f"c{i}" for i in range(p)]
    data = df.select(*[q(c).cast("double").alias(n) for c, n in zip(cols, names)])

    def gram(batches):
        import pandas as pd
        acc = None
        for pdf in batches:
            x = pdf[names].to_numpy(dtype="float64")
            m = (~np.isnan(x)).astype("float64")
            a = np.where(m > 0, x - np.asarray(shift), 0.0)
            part = np.stack([m.T @ m, a.T @ m, (a * a).T @ m, a.T @ a])
            acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"g": [acc.ravel().tolist()]})

    parts = data.mapInPandas(gram, "g array<double>")
    size = 4 * p * p
    total = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(size)
    for r in total:   # 4 p^2 numbers
        flat[r["i"]] = r["v"]
    g = flat.reshape(4, p, p)
    return {"n": g[0], "sa": g[1], "saa": g[2], "sab": g[3], "shift": shift}
