"""Exploratory statistics (E1-E26): the table behind every chart.

Conventions: numeric inputs are cast to double; per-column work runs on the
unpivoted ``(column, x)`` form grouped by column (map-side combined), pairwise
work runs as one wide aggregate over the pairs.  Quantiles and ranks come from
:mod:`tablelab.functions.stats` (exact and distributed).  Column caps of the
reference ("first 6 columns") are parameters chosen by the caller.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelab.functions.stats import (VALUES_PER_BUCKET, attach, average_ranks, column_counts, column_value_counts,
                                      hash_sample, normal_quantile_sql, pairwise_sums, prefix_sums, q, quantiles_wide, rank_table,
                                      sample_kurt, sample_skew, top_k_per_group, unpivot, value_counts)
from tablelab.operators.profile import moments, string_value_counts
from tablelab.session import cut_lineage


def _round(c, d=6):
    return F.round(c, d)


# --------------------------------------------------------------------------
# E1 missing pattern
# --------------------------------------------------------------------------

def missing_pattern(df: DataFrame) -> DataFrame:
    """E1 at scale: distinct null patterns (a 0/1 string, one char per column in
    column order) with their row counts and null cells per row."""
    flags = [F.when(q(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in df.columns]
    nulls = sum((q(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return (df.select(F.concat(*flags).alias("pattern"), nulls.alias("n_null_cells"))
            .groupBy("pattern", "n_null_cells").agg(F.count(F.lit(1)).alias("n_rows")))


def missing_totals(df: DataFrame) -> DataFrame:
    """E1 insight: total missing cells and columns with any missing value."""
    m = df.agg(*[(F.count(F.lit(1)) - F.count(q(c))).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cols = [F.col(f"m{i}") for i in range(len(df.columns))]
    return m.select(sum(cols, F.lit(0)).cast("long").alias("total_missing"),
                    sum([(c > 0).cast("int") for c in cols], F.lit(0)).cast("int").alias("columns_with_missing"))


# --------------------------------------------------------------------------
# E2 histogram, E2b normality, E2c skew description, E13 skew/kurtosis
# --------------------------------------------------------------------------

def histogram(df: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """E2 / E23 diagonal: equal-width bins between min and max (last bin closed),
    density = count / (n * width).  (column, bin, lo, hi, cnt, density)."""
    long = unpivot(df, cols).where(F.col("x").isNotNull())
    rng = long.groupBy("column").agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count("x").alias("n"))
    width = (F.col("mx") - F.col("mn")) / bins
    b = F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - F.col("mn"), F.col("mx") - F.col("mn")) * bins),
                           F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = (long.join(F.broadcast(rng), "column").withColumn("bin", b)
               .groupBy("column", "bin", "mn", "mx", "n").agg(F.count(F.lit(1)).alias("cnt")))
    w = F.col("mx") - F.col("mn")
    return counted.select(
        "column", "bin",
        _round(F.col("mn") + F.col("bin") * w / bins).alias("lo"),
        _round(F.col("mn") + (F.col("bin") + 1) * w / bins).alias("hi"),
        "cnt",
        _round(F.try_divide(F.col("cnt").cast("double"), F.col("n") * w / bins)).alias("density"))


def skew_label(s):
    return (F.when(F.abs(s) > 1, "highly skewed").when(F.abs(s) > 0.5, "moderately skewed")
            .otherwise("symmetric"))


def distribution_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """E2 lines + E2c: (column, n, mean, median, std, skew, skew_desc)."""
    m = moments(df, cols, ("n", "mean", "std", "skew_pop"))
    med = quantiles_wide(df, cols, [0.5], ["median"])
    return m.join(med, "column", "left").select(
        "column", "n", _round(F.col("mean")).alias("mean"), _round(F.col("median")).alias("median"),
        _round(F.col("std")).alias("std"), _round(F.col("skew")).alias("skew"), skew_label(F.col("skew")).alias("skew_desc"))


def normality_jb(df: DataFrame, cols: list[str], min_n: int = 8, alpha: float = 0.05) -> DataFrame:
    """E2b (re-aimed): Jarque-Bera on the whole column,
    JB = n/6 * (S^2 + K^2/4) with population skew S and excess kurtosis K;
    p = exp(-JB/2) (chi-square, 2 degrees of freedom)."""
    m = moments(df, cols, ("n", "skew_pop", "kurt_pop")).where(F.col("n") >= min_n)
    s, k = F.coalesce(F.col("skew_pop"), F.lit(0.0)), F.coalesce(F.col("kurt_pop"), F.lit(0.0))
    jb = F.col("n") / 6.0 * (s * s + k * k / 4.0)
    return m.select("column", "n", _round(s).alias("skew_pop"), _round(k).alias("kurt_pop"),
                    _round(jb, 4).alias("jb"), _round(F.exp(-jb / 2.0), 6).alias("p_value"),
                    (F.exp(-jb / 2.0) > alpha).alias("is_normal"))


def normality_order(df: DataFrame, cols: list[str], min_n: int = 5, critical: float = 1.6449) -> DataFrame:
    """Shapiro and Francia's W' over all rows, the squared correlation of the
    values with the normal scores of their ranks (Blom positions; equal values share
    the score of their mean rank), and its normal deviate
    z = (ln(1 - W') - mu) / sigma by Royston's formulas for W' (made for 5 to 5,000
    rows; beyond them the trend is continued).  Normal below the upper 5 % point.

    Value counts are combined map-side and ranked by range (``prefix_sums``), so the
    order of a column is never held by one task.  Columns with fewer than ``min_n``
    values or a single value have no row."""
    totals, bound = column_counts(df, cols)
    means = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centre = df.sparkSession.createDataFrame([(c, float(means[f"m{i}"])) for i, c in enumerate(cols) if means[f"m{i}"] is not None],
                                             "column string, centre double")
    ranked = average_ranks(rank_table(column_value_counts(df, cols), totals=totals, max_distinct=bound))
    scored = (ranked.where(F.col("n") >= min_n).join(F.broadcast(centre), "column")
              .withColumn("p", (F.col("avg_rank") - 0.375) / (F.col("n") + 0.25))
              .withColumn("m", F.expr(normal_quantile_sql("p"))).withColumn("d", F.col("x") - F.col("centre")))
    c = F.col("cnt").cast("double")
    s = scored.groupBy("column", "n").agg(*[F.sum(c * v).alias(k) for k, v in {
        "d1": F.col("d"), "d2": F.col("d") * F.col("d"), "m1": F.col("m"), "m2": F.col("m") * F.col("m"),
        "dm": F.col("d") * F.col("m")}.items()])
    cov = F.col("dm") - F.col("d1") * F.col("m1") / F.col("n")
    var_d, var_m = (F.col(f"{k}2") - F.col(f"{k}1") * F.col(f"{k}1") / F.col("n") for k in "dm")
    out = s.where((var_d > 0) & (var_m > 0)).withColumn("w", cov * cov / (var_d * var_m))
    u, v = F.log(F.col("n").cast("double")), F.log(F.log(F.col("n").cast("double")))
    z = (F.log(F.greatest(1 - F.col("w"), F.lit(1e-12))) - (-1.2725 + 1.0521 * (v - u))) / (1.0308 - 0.26758 * (v + 2 / u))
    return out.select("column", "n", _round(F.col("w")).alias("w_prime"), _round(z, 4).alias("z"), (z < critical).alias("is_normal"))


def skew_kurtosis(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bias-corrected skewness (G1) and excess kurtosis (G2), n >= 3, with
    the bands of the chart (|skew| .5 / 1, |kurt| 3 / 5)."""
    m = moments(df, cols, ("n", "skew_pop", "kurt_pop")).where(F.col("n") >= 3)
    g1 = sample_skew(F.col("skew_pop"), F.col("n"))
    g2 = sample_kurt(F.col("kurt_pop"), F.col("n"))
    band = lambda v, a, b: F.when(F.abs(v) < a, "low").when(F.abs(v) < b, "medium").otherwise("high")
    return m.select("column", "n", _round(g1).alias("skewness"), _round(g2).alias("kurtosis"),
                    band(g1, 0.5, 1.0).alias("skew_band"),
                    F.when(g2.isNull(), F.lit(None)).otherwise(band(g2, 3.0, 5.0)).alias("kurt_band"))


# --------------------------------------------------------------------------
# E3 / E4 / E22 box statistics, E25 outlier share
# --------------------------------------------------------------------------

def _quartiles(df, cols):
    return quantiles_wide(df, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"]).withColumn(
        "iqr", F.col("q3") - F.col("q1")).withColumn(
        "lo_fence", F.col("q1") - 1.5 * F.col("iqr")).withColumn(
        "hi_fence", F.col("q3") + 1.5 * F.col("iqr"))


def _fence_rows(df, cols):
    """Quartiles and 1.5 IQR fences per column (one row per column, collected)."""
    return {r["column"]: r for r in _quartiles(df, cols).collect()}


def box_stats(df: DataFrame, cols: list[str], with_mean: bool = False) -> DataFrame:
    """E3 (and E22 with ``with_mean``): quartiles, whiskers = furthest data inside
    1.5 IQR, flier count.  The fences (one row per column) become literals of a
    single wide aggregate over the data: one pass, no unpivot, no join."""
    fences = _fence_rows(df, cols)
    aggs, keep = [], []
    for i, c in enumerate(cols):
        f = fences.get(c)
        if f is None or f["q1"] is None:
            continue
        x = q(c).cast("double")
        inside = (x >= F.lit(f["lo_fence"])) & (x <= F.lit(f["hi_fence"]))
        aggs += [F.min(F.when(inside, x)).alias(f"lo{i}"), F.max(F.when(inside, x)).alias(f"hi{i}"),
                 F.count_if(x.isNotNull() & ~inside).alias(f"fl{i}"), F.count(x).alias(f"n{i}")]
        if with_mean:
            aggs.append(F.avg(x).alias(f"mu{i}"))
        keep.append((i, c))
    row = df.agg(*aggs)
    parts = []
    for i, c in keep:
        f = fences[c]
        fields = [F.lit(c).alias("column"), F.col(f"n{i}").alias("n"),
                  *[F.round(F.lit(float(f[k])), 6).alias(k) for k in ("q1", "median", "q3", "iqr")],
                  F.round(F.col(f"lo{i}"), 6).alias("whisker_lo"), F.round(F.col(f"hi{i}"), 6).alias("whisker_hi"),
                  F.col(f"fl{i}").cast("long").alias("n_fliers")]
        if with_mean:
            fields.append(F.round(F.col(f"mu{i}"), 4).alias("mean"))
        parts.append(F.struct(*fields))
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def violin_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Quartiles and range per column (the density part is :func:`kde_curve`)."""
    qs = quantiles_wide(df, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    m = moments(df, cols, ("n", "min", "max"))
    return m.join(qs, "column").select("column", "n", *[_round(F.col(c)).alias(c) for c in ["min", "q1", "median", "q3", "max"]])


def outlier_share(df: DataFrame, cols: list[str], min_n: int = 4) -> DataFrame:
    """Share of values outside the 1.5 IQR fences, only columns with any,
    ordered by share (bands: > 10 high, > 5 medium, else low).  One wide
    aggregate with the fences as literals."""
    fences = _fence_rows(df, cols)
    keep = [(i, c) for i, c in enumerate(cols) if fences.get(c) is not None and fences[c]["q1"] is not None]
    if not keep:
        return df.sparkSession.createDataFrame([], "column string, n long, n_outliers long, outlier_pct double, band string")
    aggs = []
    for i, c in keep:
        x = q(c).cast("double")
        f = fences[c]
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count_if((x < F.lit(f["lo_fence"])) | (x > F.lit(f["hi_fence"]))).alias(f"o{i}")]
    row = df.agg(*aggs)
    g = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"),
                                                F.col(f"o{i}").alias("n_out")) for i, c in keep])).alias("s")).select("s.*")
    pct = F.col("n_out") * 100.0 / F.col("n")
    return (g.where((F.col("n") >= min_n) & (F.col("n_out") > 0))
            .select("column", "n", F.col("n_out").cast("long").alias("n_outliers"), _round(pct, 4).alias("outlier_pct"),
                    F.when(pct > 10, "high").when(pct > 5, "medium").otherwise("low").alias("band")))


# --------------------------------------------------------------------------
# E5 / E11 categories, E24 crosstab
# --------------------------------------------------------------------------

def top_categories(df: DataFrame, cols: list[str], k: int = 12) -> DataFrame:
    """E5: top k values per categorical column by (count desc, value asc), plus
    whether the column has more values than shown.  Two-stage top-k, so a
    column with billions of distinct values never sits in one window."""
    vc = string_value_counts(df, cols)
    nu = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    top = top_k_per_group(vc, ["column"], [F.col("cnt").desc(), F.col("s")], k, salt_col=F.col("s"))
    return top.join(F.broadcast(nu), "column").select(
        "column", F.col("rank").cast("int").alias("rank"), F.col("s").alias("value"),
        F.col("cnt").cast("long").alias("cnt"), (F.col("n_unique") > k).alias("truncated"))


def category_shares(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """Top k values per column and their share of the displayed k."""
    top = top_categories(df, cols, k)
    w = Window.partitionBy("column")  # at most k rows per column
    return top.select("column", "rank", "value", "cnt",
                      _round(F.col("cnt") / F.sum("cnt").over(w)).alias("share"))


def crosstab_shares(df: DataFrame, c1: str, c2: str, k: int = 5, other: str = "Other") -> DataFrame:
    """Values outside each column's top k (and nulls) become ``Other``;
    share of each (v1, v2) cell within its v1 row."""
    t1 = top_categories(df, [c1], k).select(F.col("value").alias("_t1"))
    t2 = top_categories(df, [c2], k).select(F.col("value").alias("_t2"))
    s1, s2 = q(c1).cast("string"), q(c2).cast("string")
    lab = (df.select(s1.alias("_v1"), s2.alias("_v2"))
           .join(F.broadcast(t1), F.col("_v1") == F.col("_t1"), "left")
           .join(F.broadcast(t2), F.col("_v2") == F.col("_t2"), "left")
           .select(F.coalesce("_t1", F.lit(other)).alias("v1"), F.coalesce("_t2", F.lit(other)).alias("v2")))
    cells = lab.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy("v1")  # at most (k+1) cells per row
    return cells.select("v1", "v2", F.col("cnt").cast("long").alias("cnt"),
                        _round(F.col("cnt") / F.sum("cnt").over(w)).alias("share"))


# --------------------------------------------------------------------------
# E6 / E6b / E16 / E16b / E21b / E23 pairwise statistics
# --------------------------------------------------------------------------

def pearson_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r for every ordered pair (a, b), diagonal
    included (1 unless the column is constant; null for a constant side).

    One pass: per-task Gram matrices of values and presence indicators
    (:func:`pairwise_sums`), summed by Spark; r for all pairs follows from
    the p x p sums."""
    import math as _m
    s = pairwise_sums(df, cols)
    n, sa, saa, sab = s["n"], s["sa"], s["saa"], s["sab"]
    rows = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            nn = n[i][j]
            r = None
            if nn >= 2:
                # sums over rows where both are present: a = column i, b = column j
                cov = sab[i][j] / nn - (sa[i][j] / nn) * (sa[j][i] / nn)
                va = saa[i][j] / nn - (sa[i][j] / nn) ** 2
                vb = saa[j][i] / nn - (sa[j][i] / nn) ** 2
                den = _m.sqrt(va * vb) if va > 0 and vb > 0 else 0.0
                if den > 0 and va > 1e-15 * max(1.0, saa[i][j] / nn) and vb > 1e-15 * max(1.0, saa[j][i] / nn):
                    r = 1.0 if i == j else round(float(max(-1.0, min(1.0, cov / den))), 6)
            rows.append((cols[i], cols[j], i, j, r))
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, i int, j int, r double")


def strong_pairs(corr_long: DataFrame, threshold: float = 0.7, top: int = 5) -> DataFrame:
    """Upper-triangle pairs with |r| > threshold, strongest first (bounded
    input: one row per column pair)."""
    up = corr_long.where((F.col("i") < F.col("j")) & (F.abs("r") > threshold))
    w = Window.orderBy(F.abs("r").desc(), "i", "j")
    return (up.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select(F.col("rank").cast("int"), "col_a", "col_b", "r"))


def top_abs_corr(corr_long: DataFrame, top: int = 10) -> DataFrame:
    """Pairs with |r| < 1 (upper triangle), top by |r|."""
    up = corr_long.where((F.col("i") < F.col("j")) & (F.abs("r") < 1) & F.col("r").isNotNull())
    w = Window.orderBy(F.abs("r").desc(), "i", "j")
    return (up.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select(F.col("rank").cast("int"), "col_a", "col_b", "r"))


def feature_distance(corr_long: DataFrame) -> DataFrame:
    """Euclidean distance between rows of the correlation matrix (nulls as
    0), the input of a hierarchical linkage.  Size is columns^3, not rows."""
    c = corr_long.select("col_a", "col_b", F.coalesce("r", F.lit(0.0)).alias("r"))
    a = c.select(F.col("col_a").alias("f1"), F.col("col_b").alias("k"), F.col("r").alias("r1"))
    b = c.select(F.col("col_a").alias("f2"), F.col("col_b").alias("k"), F.col("r").alias("r2"))
    return (a.join(b, "k").groupBy("f1", "f2")
            .agg(_round(F.sqrt(F.sum((F.col("r1") - F.col("r2")) ** 2))).alias("distance")))


def comissing_corr(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson r of the null indicators; null when a column is never (or
    always) missing."""
    cols = cols or df.columns
    ind = df.select(*[q(c).isNull().cast("double").alias(c) for c in cols])
    return pearson_matrix(ind, cols)


def trend_lines(df: DataFrame, cols: list[str], min_rows: int = 5) -> DataFrame:
    """OLS of y on x for every ordered pair (x != y) over rows where both
    are present, if more than ``min_rows`` such rows; null slope on constant x."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if i != j]
    exprs = []
    for i, j in pairs:
        y, x = q(cols[i]).cast("double"), q(cols[j]).cast("double")
        both = x.isNotNull() & y.isNotNull()
        xx, yy = F.when(both, x), F.when(both, y)
        cov = F.covar_pop(xx, yy)
        var = F.var_pop(xx)
        slope = cov / F.nullif(var, F.lit(0.0))
        exprs += [F.count(xx).alias(f"n{i}_{j}"), slope.alias(f"s{i}_{j}"),
                  (F.avg(yy) - slope * F.avg(xx)).alias(f"b{i}_{j}")]
    row = df.agg(*exprs)
    parts = [F.struct(F.lit(cols[j]).alias("x"), F.lit(cols[i]).alias("y"), F.col(f"n{i}_{j}").alias("n"),
                      F.col(f"s{i}_{j}").alias("slope"), F.col(f"b{i}_{j}").alias("intercept")) for i, j in pairs]
    long = row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    return long.where(F.col("n") > min_rows).select(
        "x", "y", F.col("n").cast("long").alias("n"), _round(F.col("slope")).alias("slope"),
        _round(F.col("intercept"), 4).alias("intercept"))


BROADCAST_RANKS = 50_000   # distinct values (by estimate) up to which a column's ranks are broadcast
HOT_SHARE, SALTS = 1_000, 1_024   # values of more than one row in so many don't meet at one task


def spearman_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Spearman rho (average ranks, then Pearson).

    Columns without missing values share their rows, so a pair's rows are those where
    its columns that have missing ones are present (its domain).  A column is counted by value
    once, with a count for each domain it is ranked in; running sums give the ranks in all
    of them, one join takes these to the rows, and one aggregate sums all pairs.  Ranks of
    few values are broadcast, so are those of values that many rows share.  Upper triangle, mirror,
    and a diagonal that is null for a constant column."""
    spark = df.sparkSession
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    xs = [q(c).cast("double") for c in cols]
    xs = [F.when(~F.isnan(x), x) for x in xs]
    st = df.agg(*[F.min(q(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                *[F.max(q(c).cast("double")).alias(f"z{i}") for i, c in enumerate(cols)],
                *[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)],
                *[F.approx_count_distinct(x).alias(f"d{i}") for i, x in enumerate(xs)], F.count(F.lit(1)).alias("n")).first()
    part = {i for i in range(len(cols)) if st[f"n{i}"] < st["n"]}   # columns with missing values
    domain = {p: tuple(sorted(part & set(p))) for p in pairs}
    ranked_in = {i: sorted({d for p, d in domain.items() if i in p}) for i in range(len(cols))}
    rows = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)])

    def present(d):
        return F.lit(True) if not d else F.expr(" AND ".join(f"x{k} IS NOT NULL" for k in d))

    def ranks(i):
        """r<i>_<k>: average rank of a value of column i in its k-th domain; cnt: its rows."""
        names = [f"c{k}" for k in range(len(ranked_in[i]))]
        counts = (rows.where(f"x{i} IS NOT NULL").groupBy(F.col(f"x{i}").alias("v"))
                  .agg(F.count(F.lit(1)).alias("cnt"), *[F.count_if(present(d)).alias(c) for c, d in zip(names, ranked_in[i])])
                  .withColumn("column", F.lit(i)))
        bound = min(st[f"n{i}"], int(1.1 * st[f"d{i}"]) + 1)
        if bound > VALUES_PER_BUCKET:   # then counts are read three times
            counts = cut_lineage(counts)
        return prefix_sums(counts, "column", "v", tuple(names), bound).select(
            F.col("v").alias(f"x{i}"), F.col("cnt").alias("__cnt"),
            *[(F.col(f"{c}_before") + (F.col(c) + 1) / 2.0).alias(f"r{i}_{k}") for k, c in enumerate(names)])

    joined = rows
    for i in sorted((i for i in ranked_in if ranked_in[i]), key=lambda i: -st[f"d{i}"]):
        table, key = ranks(i), f"x{i}"
        if st[f"d{i}"] <= BROADCAST_RANKS:
            joined = joined.join(F.broadcast(table.drop("__cnt")), key, "left")
            continue
        table = cut_lineage(table)
        is_hot = F.col("__cnt") > st["n"] // HOT_SHARE
        names = [c for c in table.columns if c not in (key, "__cnt")]
        hot = table.where(is_hot).select(key, *[F.col(c).alias(f"__hot_{c}") for c in names])   # at most HOT_SHARE values
        joined = joined.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(
            F.col(key).isNull() | F.col(f"__hot_{names[0]}").isNotNull(), F.pmod(F.xxhash64(*[f"x{k}" for k in range(len(cols))]), F.lit(SALTS)) + 1).otherwise(0))
        cold = table.where(~is_hot).select(key, *names, F.lit(0).cast("long").alias("__salt"))
        joined = joined.join(cold, [key, "__salt"], "left").select(
            *[c for c in joined.columns if not c.startswith("__")],
            *[F.coalesce(c, f"__hot_{c}").alias(c) for c in names])
    sums = []
    for n, p in enumerate(pairs):
        both = present(domain[p])
        ra, rb = (F.when(both, F.col(f"r{i}_{ranked_in[i].index(domain[p])}")) for i in p)
        sums += [F.count(ra).cast("double").alias(f"n{n}"), F.sum(ra).alias(f"sa{n}"), F.sum(rb).alias(f"sb{n}"),
                 F.sum(ra * ra).alias(f"saa{n}"), F.sum(rb * rb).alias(f"sbb{n}"), F.sum(ra * rb).alias(f"sab{n}")]
    rows_out = [(c, c, 1.0 if st[f"a{i}"] is not None and st[f"a{i}"] != st[f"z{i}"] else None) for i, c in enumerate(cols)]
    r = joined.agg(*sums).first() if sums else None
    for n, (i, j) in enumerate(pairs):
        rho = None
        if r[f"n{n}"]:
            va, vb = r[f"saa{n}"] - r[f"sa{n}"] ** 2 / r[f"n{n}"], r[f"sbb{n}"] - r[f"sb{n}"] ** 2 / r[f"n{n}"]
            if va > 0 and vb > 0:
                rho = round((r[f"sab{n}"] - r[f"sa{n}"] * r[f"sb{n}"] / r[f"n{n}"]) / math.sqrt(va * vb), 6)
        rows_out += [(cols[i], cols[j], rho), (cols[j], cols[i], rho)]
    return spark.createDataFrame(rows_out, "col_a string, col_b string, rho double")


# --------------------------------------------------------------------------
# E7 / E15 / E19 / E20 samples
# --------------------------------------------------------------------------

def pair_sample(df: DataFrame, cols: list[str], key: list[str], hue: str | None = None, n: int = 500,
                seed: int = 42) -> DataFrame:
    """Complete rows of up to four numeric columns (and a hue), the n
    with the smallest replayable sample key."""
    keep = list(dict.fromkeys(key + cols + ([hue] if hue else [])))
    clean = df.select(*[q(c) for c in keep]).dropna(subset=cols + ([hue] if hue else []))
    return hash_sample(clean, key, n, seed)


def zscore_matrix(df: DataFrame, cols: list[str], key: list[str], n: int = 200, seed: int = 42) -> DataFrame:
    """Complete rows, a replayable sample of n, standardised with the
    sample's own mean and sample std; long form (key..., column, z)."""
    s = hash_sample(df.select(*[q(c) for c in key + cols]).dropna(subset=cols), key, n, seed)
    st = s.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.stddev_samp(q(c)).alias(f"s{i}") for i, c in enumerate(cols)])
    z = attach(s, st).select(*[q(k) for k in key], *[
        _round((q(c) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(c) for i, c in enumerate(cols)])
    return unpivot(z, cols, keep=key, value_col="z")


def parallel_coordinates(df: DataFrame, cols: list[str], key: list[str], class_col: str | None,
                         n: int = 300, seed: int = 42) -> DataFrame:
    """Up to six numerics plus a class: the given categorical, else
    Low/Mid/High tertiles of the first numeric (right-closed bins, exact edges);
    complete rows; replayable sample of n."""
    if class_col is not None:
        base = df.select(*[q(c) for c in key + cols], q(class_col).cast("string").alias("class"))
    else:
        first = cols[0]
        edges = quantiles_wide(df, [first], [1 / 3, 2 / 3], ["e1", "e2"])
        x = q(first)
        lab = F.when(x <= F.col("e1"), "Low").when(x <= F.col("e2"), "Mid").when(x.isNotNull(), "High")
        base = attach(df.select(*[q(c) for c in key + cols]), edges.drop("column")).select(
            *[q(c) for c in key + cols], lab.alias("class"))
    return hash_sample(base.dropna(), key, n, seed)


# --------------------------------------------------------------------------
# E8 time series, E9 Q-Q, E10 KDE, E17 bivariate density, E18 ECDF
# --------------------------------------------------------------------------

def time_series(df: DataFrame, ts_col: str, cols: list[str], unit: str = "day") -> DataFrame:
    """E8 at scale: parse the time column (bad values dropped), bucket by
    ``unit`` and report count / mean / min / max of each numeric per bucket."""
    ts = F.try_to_timestamp(q(ts_col).cast("string")) if dict(df.dtypes)[ts_col] == "string" else q(ts_col)
    b = F.to_date(F.date_trunc(unit, ts)) if unit != "hour" else F.date_trunc(unit, ts)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [_round(F.avg(q(c))).alias(f"avg_{c}"), F.min(q(c)).alias(f"min_{c}"), F.max(q(c)).alias(f"max_{c}")]
    return df.where(ts.isNotNull()).groupBy(b.alias("bucket")).agg(*aggs)


def filliben_grid(m: int) -> list[float]:
    """Filliben order-statistic medians for m points (the Q-Q plotting positions)."""
    last = 0.5 ** (1.0 / m)
    pts = [(i - 0.3175) / (m + 0.365) for i in range(1, m + 1)]
    pts[0], pts[-1] = 1 - last, last
    return pts


def qq_points(df: DataFrame, cols: list[str], points: int = 101) -> tuple[DataFrame, DataFrame]:
    """Ordered sample quantiles against normal quantiles at ``points``
    Filliben positions (exact quantiles, so the work is one rank pass), and the
    least-squares line through them (slope, intercept, r).  Returns
    (points frame, fit frame)."""
    probs = filliben_grid(points)
    nd = NormalDist()
    theo = df.sparkSession.createDataFrame([(p, nd.inv_cdf(p)) for p in probs], "prob double, theoretical double")
    from tablelab.functions.stats import quantiles_long
    counts = df.agg(*[F.count(q(c)).alias(c) for c in cols]).first()
    keep = [c for c in cols if counts[c] >= 3]
    qs = quantiles_long(df, keep, probs)
    pts = qs.join(F.broadcast(theo), "prob").select("column", "prob", "theoretical", F.col("qv").alias("sample"))
    fit = pts.groupBy("column").agg(
        _round(F.regr_slope("sample", "theoretical")).alias("slope"),
        _round(F.regr_intercept("sample", "theoretical")).alias("intercept"),
        _round(F.covar_pop("sample", "theoretical") / F.nullif(F.stddev_pop("sample") * F.stddev_pop("theoretical"),
                                                                F.lit(0.0))).alias("r"))
    return pts.select("column", _round(F.col("prob"), 8).alias("prob"), _round(F.col("theoretical")).alias("theoretical"),
                      _round(F.col("sample")).alias("sample")), fit


def kde_curve(df: DataFrame, cols: list[str], grid: int = 100, min_n: int = 6) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth h = std * n^(-1/5) on a grid
    from min - range/2 to max + range/2.

    One aggregate gives n, std and range of all columns (one row per column on
    the driver).  Tasks then add the kernels of their own values onto the grid,
    so ``columns x grid`` sums per task are shuffled, whatever the data's size."""
    import numpy as np
    xs = [q(c).cast("double") for c in cols]
    st = df.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(xs) for k, f in (
        ("n", F.count), ("s", F.stddev_samp), ("a", F.min), ("z", F.max))]).first()
    use = [i for i in range(len(cols)) if st[f"n{i}"] >= min_n and st[f"s{i}"]]
    schema = "column string, gi int, grid double, density double"
    if not use:
        return df.sparkSession.createDataFrame([], schema)
    h = {i: st[f"s{i}"] * st[f"n{i}"] ** -0.2 for i in use}
    low = {i: st[f"a{i}"] - 0.5 * (st[f"z{i}"] - st[f"a{i}"]) for i in use}
    step = {i: 2.0 * (st[f"z{i}"] - st[f"a{i}"]) / (grid - 1) for i in use}

    def kernels(batches):
        import pandas as pd
        total = {i: np.zeros(grid) for i in use}
        seen = False
        for pdf in batches:
            for i in use:
                x, n = np.unique(pdf[f"c{i}"].dropna().to_numpy(dtype="float64"), return_counts=True)
                at = low[i] + np.arange(grid) * step[i]
                for lo in range(0, len(x), 4096):
                    z = (at[:, None] - x[None, lo:lo + 4096]) / h[i]
                    total[i] += np.exp(-0.5 * z * z) @ n[lo:lo + 4096]
                seen = True
        if seen:
            yield pd.DataFrame({"i": np.repeat(use, grid), "gi": np.tile(np.arange(grid), len(use)),
                                "s": np.concatenate([total[i] for i in use])})

    parts = df.select(*[xs[i].alias(f"c{i}") for i in use]).mapInPandas(kernels, "i int, gi int, s double")
    names = df.sparkSession.createDataFrame([(i, cols[i], st[f"n{i}"], h[i], low[i], step[i]) for i in use],
                                            "i int, column string, n long, h double, low double, step double")
    return parts.groupBy("i", "gi").agg(F.sum("s").alias("s")).join(F.broadcast(names), "i").select(
        "column", "gi", _round(F.col("low") + F.col("gi") * F.col("step")).alias("grid"),
        _round(F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi)), 9).alias("density"))


def bivariate_density(df: DataFrame, cols: list[str], bins: int = 20, min_rows: int = 5) -> DataFrame:
    """Counts on a bins x bins grid over rows where both are present, for
    all pairs of ``cols``: one scan for all ranges, one for all joint histograms, of which a
    task adds up its own (pairs x bins x bins numbers) before they are summed."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_x string, col_y string, bx int, by int, cnt long")
    x = [q(c).cast("double") for c in cols]
    # ranges by pattern of missing columns first: two numbers a column, not four a pair
    known = F.array(*[v.isNotNull() for v in x])
    ranges = df.groupBy(known.alias("known")).agg(F.count(F.lit(1)).alias("n"), *[
        f(v).alias(f"{n}{i}") for i, v in enumerate(x) for n, f in (("lo", F.min), ("hi", F.max))])
    aggs = []
    for k, (i, j) in enumerate(pairs):
        both = F.get("known", F.lit(i)) & F.get("known", F.lit(j))
        aggs += [f(F.when(both, F.col(v))).alias(f"{n}{k}") for n, f, v in (
            ("a", F.min, f"lo{i}"), ("b", F.max, f"hi{i}"), ("c", F.min, f"lo{j}"), ("d", F.max, f"hi{j}"))]
        aggs.append(F.coalesce(F.sum(F.when(both, F.col("n"))), F.lit(0)).alias(f"n{k}"))
    r = ranges.agg(*aggs).first()

    ends = [(k, i, j, *(r[f"{n}{k}"] for n in "abcd")) for k, (i, j) in enumerate(pairs) if r[f"n{k}"] >= min_rows]
    if not ends:
        return df.sparkSession.createDataFrame([], "col_x string, col_y string, bx int, by int, cnt long")

    def cell(v, low, high):
        if not high > low:
            return np.zeros(len(v), int)
        with np.errstate(invalid="ignore"):   # infinite ends
            return np.minimum(np.nan_to_num(np.floor((v - low) / (high - low) * bins)), bins - 1).astype(int)

    def count(batches):
        total = np.zeros((len(pairs), bins * bins), int)
        for batch in batches:
            known = [c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for k, i, j, *e in ends:
                at = np.flatnonzero(known[i] & known[j])
                total[k] += np.bincount(cell(values[i][at], *e[:2]) * bins + cell(values[j][at], *e[2:]), minlength=bins * bins)
        k, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(c // bins, pa.int32()), pa.array(c % bins, pa.int32()),
                                          pa.array(total[k, c], pa.int64())], names=["pair", "bx", "by", "cnt"])

    names = [F.element_at(F.create_map(*[y for k, p in enumerate(pairs) for y in (F.lit(k), F.lit(cols[p[v]]))]), F.col("pair")) for v in (0, 1)]
    return (df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)]).mapInArrow(count, "pair int, bx int, by int, cnt long")
            .groupBy("pair", "bx", "by").agg(F.sum("cnt").cast("long").alias("cnt"))
            .select(names[0].alias("col_x"), names[1].alias("col_y"), "bx", "by", "cnt"))


def density_surface(df: DataFrame, cols: list[str], bins: int = 20, levels: int = 10, min_rows: int = 5) -> DataFrame:
    """The joint histograms smoothed with a separable Gaussian, first along x,
    then along y (grid-sized tables: pairs x bins x bins rows).  The bandwidth of
    an axis is Scott's, n^(-1/6) standard deviations, in cells and half a cell at
    least; ``level`` is the tenth (of ``levels``) of the pair's highest density."""
    cells = bivariate_density(df, cols, bins, min_rows)
    keys = ["col_x", "col_y"]
    n = F.sum("cnt")

    def width(c):
        mean = F.sum(F.col(c) * F.col("cnt")) / n
        var = (F.sum(F.col(c) * F.col(c) * F.col("cnt")) - n * mean * mean) / (n - 1)
        return F.greatest(F.pow(n, F.lit(-1.0 / 6)) * F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.5))

    bands = cells.groupBy(*keys).agg(n.alias("n"), width("bx").alias("hx"), width("by").alias("hy"))

    def kernel(at, of, h):
        z = (F.col(at) - F.col(of)) / F.col(h)
        return F.exp(-0.5 * z * z) / (F.col(h) * math.sqrt(2 * math.pi))

    grid = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    along_x = (cells.join(F.broadcast(bands), keys).withColumn("gx", grid).groupBy(*keys, "by", "gx")
               .agg(F.sum(F.col("cnt") / F.col("n") * kernel("gx", "bx", "hx")).alias("s")))
    both = (along_x.join(F.broadcast(bands), keys).withColumn("gy", grid).groupBy(*keys, "gx", "gy")
            .agg(F.sum(F.col("s") * kernel("gy", "by", "hy")).alias("density")))
    top = both.groupBy(*keys).agg(F.max("density").alias("top"))
    share = F.round(F.col("density") / F.col("top"), 6)
    return both.join(F.broadcast(top), keys).select(
        *keys, F.col("gx").alias("bx"), F.col("gy").alias("by"), _round(F.col("density"), 9).alias("density"),
        F.least(F.floor(share * levels), F.lit(levels - 1)).cast("int").alias("level"))


def ecdf(df: DataFrame, cols: list[str], min_n: int = 6) -> DataFrame:
    """ECDF at each distinct value, (cum count) / n; columns with > 5 values."""
    totals, mx = column_counts(df, cols)
    ranked = rank_table(column_value_counts(df, cols), totals=totals, max_distinct=mx)
    return ranked.where(F.col("n") >= min_n).select(
        "column", "x", F.col("cnt").cast("long").alias("cnt"),
        _round((F.col("cum_before") + F.col("cnt")) / F.col("n"), 9).alias("ecdf"))


# --------------------------------------------------------------------------
# E14 PCA, E21 missing by quartile, E26 summary
# --------------------------------------------------------------------------

def pca_summary(df: DataFrame, cols: list[str], k: int = 3, min_rows: int = 10):
    """Standardise complete rows, PCA with k = min(3, p); returns
    (variance frame (component, ratio, cumulative, above_80), scores frame)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    clean = df.select(*[q(c).cast("double").alias(c) for c in cols]).dropna()
    k = min(k, len(cols))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_v"),
                            StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True),
                            PCA(k=k, inputCol="_z", outputCol="_pc")])
    model = pipe.fit(clean)
    ratios = [float(v) for v in model.stages[-1].explainedVariance.toArray()]
    cum, rows = 0.0, []
    for i, r in enumerate(ratios):
        cum += r
        rows.append((i + 1, round(r, 6), round(cum, 6), cum >= 0.8))
    var = df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double, above_80 boolean")
    scores = model.transform(clean).select(vector_to_array("_pc").alias("pc")).select(
        F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2") if k > 1 else F.lit(None).alias("pc2"))
    return var, scores


def missing_by_quartile(df: DataFrame, ref: str, min_n: int = 10) -> DataFrame:
    """Rows binned by quartile of ``ref`` (nulls filled with its median;
    right-closed bins on exact edges, duplicate edges dropped); mean number of
    nulls per row in each bin."""
    e = quantiles_wide(df, [ref], [0.0, 0.25, 0.5, 0.75, 1.0], ["e0", "e1", "e2", "e3", "e4"])
    med = quantiles_wide(df, [ref], [0.5], ["med"])
    nulls = sum((q(c).isNull().cast("int") for c in df.columns), F.lit(0))
    base = attach(attach(df.select(q(ref).cast("double").alias("_x"), nulls.alias("_m")), e.drop("column")),
                  med.drop("column"))
    x = F.coalesce(F.col("_x"), F.col("med"))
    # bin = number of distinct inner edges strictly below x (first bin includes the minimum)
    inner = [F.col("e1"), F.col("e2"), F.col("e3")]
    edges_arr = F.array_distinct(F.array(F.col("e0"), *inner, F.col("e4")))
    b = F.size(F.filter(F.slice(edges_arr, 2, 3), lambda t: (t < x) & (t != F.element_at(edges_arr, -1))))
    labelled = base.withColumn("bin", F.least(b, F.size(edges_arr) - 2))
    n_ok = df.agg(F.count(q(ref)).alias("n")).first()["n"]
    if n_ok < min_n:
        return df.sparkSession.createDataFrame([], "quartile string, n long, avg_missing double")
    return labelled.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_m").alias("avg_missing")).select(
        F.concat(F.lit("Q"), (F.col("bin") + 1).cast("string")).alias("quartile"), F.col("n").cast("long"),
        _round(F.col("avg_missing")).alias("avg_missing"))


def eda_summary(df: DataFrame, results: int | None = None) -> DataFrame:
    """Roles, shape and health in one row."""
    from tablelab.operators.profile import health_score, infer_roles
    roles = infer_roles(df)
    hs = health_score(df, roles)
    shape = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return attach(shape, hs).select(
        "n_rows", F.lit(len(df.columns)).cast("int").alias("n_cols"),
        F.lit(len(roles["numeric"])).cast("int").alias("n_numeric"),
        F.lit(len(roles["categorical"])).cast("int").alias("n_categorical"),
        F.lit(len(roles["datetime"])).cast("int").alias("n_datetime"), "health_score", "health_label")

