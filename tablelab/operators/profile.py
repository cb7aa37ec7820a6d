"""Profile, data quality and health.

Every operator is a small number of wide aggregates over the input plus, where
values must be counted, one unpivot + map-side-combined ``groupBy``.  Results are
small frames (one row per column or per issue).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions import fixed
from tablelab.functions.stats import (DATETIME_TYPES, NESTED_TYPES, NUMERIC_TYPES, column_value_counts, q,
                                      quantiles_wide, sample_skew, unpivot, value_counts)


# --------------------------------------------------------------------------
# P1 roles, P2 shape, P3 dtypes
# --------------------------------------------------------------------------

def infer_roles(df: DataFrame) -> dict[str, list[str]]:
    """Column roles.  String columns whose every non-null value parses as a
    timestamp (including all-null ones) are datetime; one aggregate decides
    all of them."""
    roles = {"numeric": [], "categorical": [], "datetime": [], "other": [], "nested": []}
    strings = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, NUMERIC_TYPES):
            roles["numeric"].append(f.name)
        elif isinstance(t, T.StringType):
            strings.append(f.name)
        elif isinstance(t, DATETIME_TYPES):
            roles["datetime"].append(f.name)
        elif isinstance(t, NESTED_TYPES):
            roles["nested"].append(f.name)
        else:
            roles["other"].append(f.name)
    parsed = set()
    if strings:
        row = df.agg(*[
            (F.count(q(c)) == F.count(F.try_to_timestamp(q(c)))).alias(f"d{i}")
            for i, c in enumerate(strings)]).first()
        parsed = {c for i, c in enumerate(strings) if row[f"d{i}"]}
    roles["categorical"] = [c for c in strings if c not in parsed]
    roles["datetime"] = [c for c in df.columns if c in set(roles["datetime"]) | parsed]
    return roles


def role_of(roles: dict[str, list[str]], column: str) -> str:
    for r, cols in roles.items():
        if column in cols:
            return r
    return "other"


def column_roles(df: DataFrame) -> DataFrame:
    """P1 as a frame: (ordinal, column, dtype, role)."""
    roles = infer_roles(df)
    rows = [(i, f.name, f.dataType.simpleString(), role_of(roles, f.name))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, dtype string, role string")


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("int").alias("n_cols"))


def dtypes(df: DataFrame) -> DataFrame:
    """(ordinal, column, dtype)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, dtype string")


# --------------------------------------------------------------------------
# P4 / P5 / P19 missing, P6 duplicates, P7 memory
# --------------------------------------------------------------------------

def _one_row_long(row_df: DataFrame, cols: list[str], fields: list[str], shared: list[str] = ()) -> DataFrame:
    """Turn a one-row frame with columns ``{field}{i}`` into (ordinal, column,
    shared..., field...)."""
    parts = []
    for i, c in enumerate(cols):
        parts.append(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), *[F.col(s) for s in shared],
                              *[F.col(f"{fld}{i}").alias(fld) for fld in fields]))
    return row_df.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def missing_counts(df: DataFrame) -> DataFrame:
    """(ordinal, column, n_rows, n_missing, missing_pct, density_pct)
    from one aggregate; nulls are counted on the wide row, never unpivoted."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[(F.count(F.lit(1)) - F.count(q(c))).alias(f"m{i}") for i, c in enumerate(cols)])
    long = _one_row_long(agg, cols, ["m"], shared=["n_rows"])
    pct = F.round(F.try_divide(F.col("m").cast("double"), F.col("n_rows").cast("double")) * 100, 2)
    return long.select(
        "ordinal", "column", "n_rows", F.col("m").cast("long").alias("n_missing"),
        pct.alias("missing_pct"),
        F.round((1 - F.try_divide(F.col("m").cast("double"), F.col("n_rows").cast("double"))) * 100, 2)
        .alias("density_pct"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (null equals null).

    First only a 64-bit hash of each row is counted (equal rows have equal
    hashes); whole rows are shuffled and compared only where a hash repeats."""
    if not df.columns:
        return df.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).cast("long").alias("n_duplicates"))
    cols = [q(c) for c in df.columns]
    hashed = df.withColumn("_row_hash", F.xxhash64(*cols))
    again = hashed.groupBy("_row_hash").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_row_hash")
    groups = hashed.join(again, "_row_hash", "left_semi").groupBy("_row_hash", *cols).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


_FIXED_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
                T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


def memory_estimate(df: DataFrame) -> DataFrame:
    """Estimated in-memory size in MiB: fixed width x rows for fixed-width
    types, UTF-8 bytes for strings, 8 bytes per row for anything else."""
    parts = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, T.StringType):
            parts.append(F.coalesce(F.sum(F.octet_length(q(f.name))), F.lit(0)))
        else:
            width = _FIXED_WIDTH.get(type(t), 8)
            parts.append(F.count(F.lit(1)) * F.lit(width))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.agg(total.cast("long").alias("bytes")).select(
        "bytes", F.round(F.col("bytes") / (1024.0 * 1024.0), 2).alias("memory_mb"))


# --------------------------------------------------------------------------
# P8 numeric summary, P9 categorical summary
# --------------------------------------------------------------------------

MOMENTS = {
    "n": lambda x: F.count(x),
    "mean": lambda x: F.avg(x),
    "std": lambda x: F.stddev_samp(x),
    "std_pop": lambda x: F.stddev_pop(x),
    "min": lambda x: F.min(x),
    "max": lambda x: F.max(x),
    "skew_pop": lambda x: F.skewness(x),
    "kurt_pop": lambda x: F.kurtosis(x),
}
BASIC = ("n", "mean", "std", "min", "max")


def moments(df: DataFrame, cols: list[str], stats=BASIC) -> DataFrame:
    """(ordinal, column, <stats>...) from one wide aggregate.  Only the asked-for
    statistics are computed (central-moment aggregates are costly to compile).
    ``skew`` (bias-corrected G1) is derived when ``skew_pop`` is asked for."""
    stats = list(stats)
    if "n" not in stats:
        stats = ["n"] + stats
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "ordinal int, column string, " + ", ".join(
                f"{s} {'long' if s == 'n' else 'double'}" for s in stats))
    exprs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        exprs += [MOMENTS[s](x).alias(f"{s}{i}") for s in stats]
    long = _one_row_long(df.agg(*exprs), cols, stats)
    out = long.withColumn("n", F.col("n").cast("long"))
    if "skew_pop" in stats:
        out = out.withColumn("skew", sample_skew(F.col("skew_pop"), F.col("n")))
    return out


def numeric_quantiles(df: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """(column, q25, q50, q75) exact, distributed (see ``rank_table``)."""
    return quantiles_wide(df, cols, list(probs))


def numeric_summary(df: DataFrame, cols: list[str] | None = None, digits: int = 6) -> DataFrame:
    """P8 (describe): count, mean, sample std, min, exact 25/50/75 %, max."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    m = moments(df, cols)
    qs = numeric_quantiles(df, cols)
    r = lambda c: F.round(F.col(c), digits).alias(c)
    return (m.join(qs, "column", "left")
            .select("ordinal", "column", F.col("n").alias("count"), r("mean"), r("std"), r("min"),
                    r("q25"), r("q50"), r("q75"), r("max")))


def string_value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, s, cnt) over the non-null values of ``cols`` cast to string, in
    one scan of all columns."""
    return value_counts(unpivot(df, cols, "string", value_col="s"), value="s")


def categorical_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_unique, top, freq).  ``top`` is the smallest of the most
    frequent values; all of it is aggregation (no per-column window)."""
    if cols is None:
        cols = infer_roles(df)["categorical"]
    vc = string_value_counts(df, cols)
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("s").alias("s")))
    return vc.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"), best.alias("b")).select(
        "column", "n_unique", F.col("b.s").alias("top"), (-F.col("b.neg")).alias("freq"))


# --------------------------------------------------------------------------
# P10 PII
# --------------------------------------------------------------------------

def pii_detection(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P10: per (column, pii_type) the number of values whose text form matches
    the pattern at its start, and whether any does.  One pass over the data."""
    cols = cols or df.columns
    exprs, keys = [], []
    for i, c in enumerate(cols):
        text = q(c).cast("string")
        for j, (kind, pat) in enumerate(fixed.PII_PATTERNS.items()):
            exprs.append(F.count_if(F.coalesce(text.rlike(f"^(?:{pat})"), F.lit(False))).alias(f"p{i}_{j}"))
            keys.append((i, c, kind, f"p{i}_{j}"))
    row = df.agg(*exprs)
    parts = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(kind).alias("pii_type"),
                      F.col(alias).cast("long").alias("n_match")) for i, c, kind, alias in keys]
    return (row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
            .withColumn("detected", F.col("n_match") > 0))


# --------------------------------------------------------------------------
# P11-P15 issues and health, P23 post-clean health
# --------------------------------------------------------------------------

def missing_severity(pct):
    return (F.when(pct > fixed.MISSING_CRITICAL, "CRITICAL")
            .when(pct > fixed.MISSING_HIGH, "HIGH")
            .when(pct > fixed.MISSING_MODERATE, "MODERATE"))


def imbalance(df: DataFrame, cols: list[str] | None = None, max_unique: int = 10,
              min_share: float = 0.9) -> DataFrame:
    """(column, n_unique, top_share) for categoricals with at most
    ``max_unique`` values whose top value holds more than ``min_share`` of the
    non-null values."""
    if cols is None:
        cols = infer_roles(df)["categorical"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_unique long, top_share double")
    vc = string_value_counts(df, cols)
    g = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"),
                                 (F.max("cnt") / F.sum("cnt")).alias("top_share"))
    return g.where((F.col("n_unique") <= max_unique) & (F.col("top_share") > min_share))


def health_issues(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """(kind, column, severity, value) one row per issue."""
    roles = roles or infer_roles(df)
    miss = missing_counts(df)
    sev = missing_severity(F.col("missing_pct"))
    m = miss.where(sev.isNotNull()).select(
        F.lit("missing").alias("kind"), "column", sev.alias("severity"), F.col("missing_pct").alias("value"))
    d = duplicate_rows(df).where(F.col("n_duplicates") > 0).select(
        F.lit("duplicates").alias("kind"), F.lit(None).cast("string").alias("column"),
        F.lit("HIGH").alias("severity"), F.col("n_duplicates").cast("double").alias("value"))
    parts = m.unionByName(d)
    if roles["categorical"]:
        im = imbalance(df, roles["categorical"]).select(
            F.lit("imbalance").alias("kind"), "column", F.lit("HIGH").alias("severity"),
            F.round("top_share", 6).alias("value"))
        parts = parts.unionByName(im)
    return parts


def health_label(score):
    e = None
    for lo, name in fixed.HEALTH_LABELS:
        e = F.when(score >= lo, name) if e is None else e.when(score >= lo, name)
    return e.otherwise(fixed.HEALTH_LABEL_ELSE)


def health_score(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """(n_issues, health_score, health_label)."""
    issues = health_issues(df, roles)
    score = F.greatest(F.lit(0), F.lit(100) - F.lit(fixed.HEALTH_PENALTY) * F.col("n_issues"))
    return (issues.agg(F.count(F.lit(1)).cast("long").alias("n_issues"))
            .select("n_issues", score.cast("int").alias("health_score"))
            .withColumn("health_label", health_label(F.col("health_score"))))


def post_clean_health(df: DataFrame) -> DataFrame:
    """Only CRITICAL/HIGH missing issues count."""
    miss = missing_counts(df)
    sev = missing_severity(F.col("missing_pct"))
    n = miss.agg(F.count_if(sev.isin("CRITICAL", "HIGH")).cast("long").alias("n_issues"))
    score = F.greatest(F.lit(0), F.lit(100) - F.lit(fixed.HEALTH_PENALTY) * F.col("n_issues"))
    return n.select("n_issues", score.cast("int").alias("health_score")).withColumn(
        "health_label", health_label(F.col("health_score")))


# --------------------------------------------------------------------------
# P16 target candidates
# --------------------------------------------------------------------------

def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_unique) for any columns, via string value counts."""
    cols = cols or df.columns
    return string_value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).cast("long").alias("n_unique"))


def target_candidates(df: DataFrame, top: int = 8) -> DataFrame:
    """(rank, column, dtype, n_unique, missing_pct, hint_score)."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)}
    meta = [(i, f.name, f.name.lower(), f.dataType.simpleString(), f.name in numeric)
            for i, f in enumerate(df.schema.fields)]
    keep = [m for m in meta if not (m[2] in fixed.ID_LIKE_NAMES or any(h in m[2] for h in fixed.ID_LIKE_SUBSTRINGS))]
    spark = df.sparkSession
    if not keep:
        return spark.createDataFrame([], "rank int, column string, dtype string, n_unique long, "
                                         "missing_pct double, hint_score int")
    info = spark.createDataFrame(
        [(i, c, d, isnum, 3 if any(h in lc for h in fixed.TARGET_NAME_HINTS) else 0) for i, c, lc, d, isnum in keep],
        "ordinal int, column string, dtype string, is_numeric boolean, name_score int")
    cols = [m[1] for m in keep]
    stats = (missing_counts(df.select(*[q(c) for c in cols])).select("column", "missing_pct", "n_missing", "n_rows")
             .join(distinct_counts(df, cols), "column", "left"))
    miss_pct = F.col("n_missing") * 100.0 / F.greatest(F.col("n_rows"), F.lit(1))
    uniq = F.coalesce(F.col("n_unique"), F.lit(0))
    score = (F.col("name_score")
             + F.when(uniq <= 20, 2).otherwise(0)
             + F.when(F.col("is_numeric") & (uniq > 20), 2).otherwise(0)
             - F.when(miss_pct > 50, 2).when(miss_pct > 20, 1).otherwise(0))
    scored = (info.join(stats, "column").withColumn("hint_score", score.cast("int"))
              .where(F.col("hint_score") > 0))
    w = Window.orderBy(F.col("hint_score").desc(), F.col("ordinal"))
    # at most one row per column of the input: a bounded window
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("rank", "column", "dtype", uniq.cast("long").alias("n_unique"),
                    F.round(miss_pct, 2).alias("missing_pct"), "hint_score"))


# --------------------------------------------------------------------------
# P17 preview, P18 column detail, P20-P22 flags, P24 null-safe output
# --------------------------------------------------------------------------

def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """First n rows by an explicit key (distributed top-k), NaN -> null."""
    return null_safe(df.orderBy(*[q(c) for c in order_by]).limit(n))


def sample_values(df: DataFrame, order_by: list[str], cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column, sample_values array<string>): the first k non-null values of each
    column in key order.  Each column is its own distributed top-k."""
    cols = cols or df.columns
    parts = []
    for c in cols:
        top = (df.where(q(c).isNotNull()).select(*[q(o) for o in order_by], q(c).cast("string").alias("v"))
               .orderBy(*order_by).limit(k))
        parts.append(top.select(F.lit(c).alias("column"), F.struct(*[q(o) for o in order_by]).alias("_k"), "v"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("_k", "v"))).alias("_a")).select(
        "column", F.transform("_a", lambda s: s["v"]).alias("sample_values"))


def column_detail(df: DataFrame, order_by: list[str], digits: int = 6) -> DataFrame:
    """(ordinal, column, dtype, n_missing, missing_pct, n_unique,
    sample_values, min, max, mean, std, skewness)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    miss = missing_counts(df).select("ordinal", "column", "n_missing", "missing_pct")
    types = dtypes(df).select("column", "dtype")
    base = (miss.join(types, "column").join(distinct_counts(df), "column", "left")
            .join(sample_values(df, order_by), "column", "left"))
    if numeric:
        m = moments(df, numeric, BASIC + ("skew_pop",)).select(
            "column", "min", "max", "mean", "std", F.col("skew").alias("skewness"))
        base = base.join(m, "column", "left")
    else:
        for c in ["min", "max", "mean", "std", "skewness"]:
            base = base.withColumn(c, F.lit(None).cast("double"))
    r = lambda c: F.round(F.col(c), digits).alias(c)
    return base.select("ordinal", "column", "dtype", "n_missing", "missing_pct",
                       F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"), "sample_values",
                       r("min"), r("max"), r("mean"), r("std"), r("skewness"))


def column_flags(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """(column, density_pct, is_constant, is_near_constant, is_high_cardinality)."""
    roles = roles or infer_roles(df)
    cats = set(roles["categorical"])
    miss = missing_counts(df)
    nu = distinct_counts(df)
    cat_flag = F.col("column").isin(*cats) if cats else F.lit(False)
    u = F.coalesce(F.col("n_unique"), F.lit(0))
    return miss.join(nu, "column", "left").select(
        "ordinal", "column", "density_pct",
        (u == 1).alias("is_constant"),
        ((u / F.col("n_rows") < 0.01) & (u > 1)).alias("is_near_constant"),
        (cat_flag & (u > 100)).alias("is_high_cardinality"))


def null_safe(df: DataFrame) -> DataFrame:
    """NaN and +-inf become null in every float column."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = q(f.name)
            out.append(F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast(f.dataType))
                       .otherwise(c).alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


def column_profile(df: DataFrame, digits: int = 6) -> DataFrame:
    """Flagship: one row per column with missing counts (P4/P5), role (P1),
    distinct counts, numeric summary (P8) and categorical top/freq (P9).

    Two scans of the input in total: one wide aggregate (row count, non-null
    counts, moments, timestamp-parse checks for text columns) whose single
    row decides roles and the rank-bucket count, then one job over the value
    counts (numeric values -> exact quartiles through the rank table and
    distinct counts; text values -> distinct counts and top value)."""
    from tablelab.functions.stats import VALUES_PER_BUCKET, exact_quantiles, rank_table
    spark = df.sparkSession
    fields = df.schema.fields
    num = [f.name for f in fields if isinstance(f.dataType, NUMERIC_TYPES)]
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(q(f.name)).alias(f"c{i}") for i, f in enumerate(fields)]
    for i, f in enumerate(fields):
        if f.name in num:
            x = q(f.name).cast("double")
            aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                     F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        elif f.name in strings:
            aggs.append(F.count(F.try_to_timestamp(q(f.name))).alias(f"ts{i}"))
    row = df.agg(*aggs).first()
    n = row["_n"]
    local, cats = [], []
    for i, f in enumerate(fields):
        c = f.name
        if c in num:
            role = "numeric"
        elif c in strings:
            role = "datetime" if row[f"ts{i}"] == row[f"c{i}"] else "categorical"
            if role == "categorical":
                cats.append(c)
        elif isinstance(f.dataType, DATETIME_TYPES):
            role = "datetime"
        elif isinstance(f.dataType, NESTED_TYPES):
            role = "nested"
        else:
            role = "other"
        stats = [row[f"{k}{i}"] if c in num else None for k in ("mean", "std", "min", "max")]
        local.append((i, c, f.dataType.simpleString(), role, n - row[f"c{i}"], n, *stats))
    base = spark.createDataFrame(local, "ordinal int, column string, dtype string, role string, n_missing long, "
                                        "_n long, mean double, std double, min double, max double")
    parts = []
    if num:
        counts = {c: row[f"c{i}"] for i, c in enumerate(df.columns) if c in num}
        totals = spark.createDataFrame(list(counts.items()), "column string, n long")
        bound = max(counts.values())
        if bound > VALUES_PER_BUCKET:
            d = df.agg(*[F.approx_count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(num)]).first()
            bound = max(d[f"d{i}"] for i in range(len(num)))
        vc = column_value_counts(df, num)
        qs = exact_quantiles(rank_table(vc, totals=totals, max_distinct=bound), [0.25, 0.5, 0.75], totals=totals)
        qw = qs.groupBy("column").agg(*[F.max(F.when(F.col("prob") == p, F.col("qv"))).alias(nm)
                                        for p, nm in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
        nu = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
        parts.append(nu.join(qw, "column", "left").select(
            "column", "n_unique", "q25", "q50", "q75", F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("long").alias("freq")))
    other = [c for c in df.columns if c not in num]
    if other:
        svc = column_value_counts(df, other, "string", "s")
        best = F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("s").alias("s")))
        g = svc.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), best.alias("b"))
        is_cat = F.col("column").isin(*cats) if cats else F.lit(False)
        parts.append(g.select("column", "n_unique", *[F.lit(None).cast("double").alias(nm) for nm in ("q25", "q50", "q75")],
                              F.when(is_cat, F.col("b.s")).alias("top"), F.when(is_cat, -F.col("b.neg")).alias("freq")))
    per = parts[0]
    for p_ in parts[1:]:
        per = per.unionByName(p_)
    r = lambda c: F.round(F.col(c), digits).alias(c)
    pct = F.round(F.col("n_missing") * 100.0 / F.col("_n"), 2)
    return (base.join(per, "column", "left")
            .select("ordinal", "column", "dtype", "role", "n_missing", pct.alias("missing_pct"),
                    F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"),
                    r("mean"), r("std"), r("min"), r("q25"), r("q50"), r("q75"), r("max"), "top",
                    F.col("freq").cast("long").alias("freq")))
