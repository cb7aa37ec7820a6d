"""Preprocessing with fit / transform separation.

Each step has a ``fit(df)`` that computes its statistics with a few
distributed aggregates (results: one value per column) and returns a small
fitted object whose ``transform(df)`` is a lazy projection, so a chain fitted
on one frame applies to any other (training split, scoring batch, stream).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.stats import NUMERIC_TYPES, attach, q, quantiles_wide, rank_table
from tablelab.operators.profile import infer_roles, string_value_counts

UNKNOWN = "Unknown"
NULL_LABEL = "nan"          # text of a missing value once cast to string
BROADCAST_CODES_BYTES = 32 << 20  # size of the values up to which a code table is broadcast
ONEHOT_MAX_VALUES = 10_000        # one-hot columns are plan metadata: more values become one sparse vector


def numeric_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def null_total(df: DataFrame) -> int:
    return df.select(sum((q(c).isNull().cast("long") for c in df.columns), F.lit(0)).alias("n")).agg(
        F.sum("n")).first()[0] or 0


def _modes(df: DataFrame, cols: list[str]) -> dict:
    """Smallest most-frequent value per column (numeric order for numeric
    columns, text order otherwise); one aggregate per kind."""
    from tablelab.functions.stats import column_value_counts
    out = {}
    nums = [c for c in cols if isinstance(df.schema[c].dataType, NUMERIC_TYPES)]
    texts = [c for c in cols if c not in nums]
    if nums:
        vc = column_value_counts(df, nums)
        best = vc.groupBy("column").agg(F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("x").alias("v"))).alias("b"))
        out.update({r["column"]: r["b"]["v"] for r in best.collect()})   # one row per column
    if texts:
        vc = string_value_counts(df, texts)
        best = vc.groupBy("column").agg(F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("s").alias("v"))).alias("b"))
        out.update({r["column"]: r["b"]["v"] for r in best.collect()})
    return out


# --------------------------------------------------------------------------
# T1-T4, T6 imputation
# --------------------------------------------------------------------------

@dataclass
class ImputeModel:
    strategy: str
    fills: dict = field(default_factory=dict)      # column -> fill value
    methods: dict = field(default_factory=dict)    # column -> method label
    skews: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.strategy == "drop":
            return df.dropna("any")
        out = []
        for f in df.schema.fields:
            c = f.name
            if c in self.fills:
                v = self.fills[c]
                if isinstance(f.dataType, NUMERIC_TYPES):
                    out.append(F.coalesce(q(c).cast("double"), F.lit(float(v))).alias(c))
                else:
                    out.append(F.coalesce(q(c).cast("string"), F.lit(str(v))).alias(c))
            else:
                out.append(q(c))
        return df.select(*out)

    def steps(self) -> list[tuple[str, str, str]]:
        if self.strategy == "drop":
            return [("*", "drop_rows", "")]
        return [(c, self.methods[c], str(self.fills[c])) for c in self.fills]


def fit_impute(df: DataFrame, strategy: str = "auto") -> ImputeModel:
    """T1 auto (median if |skew| > 1 else mean for numerics; smallest mode or
    'Unknown' for the rest), T2 drop, T3 mean / median (numerics only), T4 mode
    (all columns).  Only columns that have nulls get a fill value."""
    if strategy == "drop":
        return ImputeModel("drop")
    if strategy not in ("auto", "mean", "median", "mode"):
        raise ValueError(f"unknown impute strategy {strategy!r}")
    nums = numeric_cols(df)
    miss = df.agg(*[(F.count(F.lit(1)) - F.count(q(c))).alias(c) for c in df.columns]).first().asDict()
    with_nulls = [c for c in df.columns if miss[c] > 0]
    num_null = [c for c in with_nulls if c in nums]
    oth_null = [c for c in with_nulls if c not in nums]
    model = ImputeModel(strategy)
    if strategy == "mode":
        modes = _modes(df, with_nulls)
        for c in with_nulls:
            v = modes.get(c)
            if c in nums:
                if v is not None:
                    model.fills[c], model.methods[c] = float(v), "mode"
            else:
                model.fills[c], model.methods[c] = (v if v is not None else UNKNOWN), "mode"
        return model
    if num_null:
        st = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(num_null)],
                    *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(num_null)],
                    *[F.skewness(q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(num_null)]).first()
        choice = {}
        for i, c in enumerate(num_null):
            n, sp = st[f"n{i}"], st[f"s{i}"]
            g1 = None
            if n >= 3:
                g1 = (sp or 0.0) * (n * (n - 1)) ** 0.5 / (n - 2)
            model.skews[c] = g1
            choice[c] = (g1 is not None and abs(g1) > 1) if strategy == "auto" else strategy == "median"
        # exact medians only for the columns that use them
        need = [c for c in num_null if choice[c]]
        med = {r["column"]: r["median"] for r in quantiles_wide(df, need, [0.5], ["median"]).collect()} if need else {}
        for i, c in enumerate(num_null):
            use_median = choice[c]
            v = med.get(c) if use_median else st[f"m{i}"]
            if v is not None:
                model.fills[c], model.methods[c] = v, ("median" if use_median else "mean")
    if strategy == "auto" and oth_null:
        modes = _modes(df, oth_null)
        for c in oth_null:
            model.fills[c] = modes.get(c) if modes.get(c) is not None else UNKNOWN
            model.methods[c] = "mode"
    return model


def missing_handled(before: DataFrame, after: DataFrame) -> int:
    """Nulls removed by a step."""
    return null_total(before) - null_total(after)


# --------------------------------------------------------------------------
# T7 / T8 outlier capping
# --------------------------------------------------------------------------

@dataclass
class CapModel:
    method: str
    bounds: dict = field(default_factory=dict)    # column -> (lo, hi)
    counts: dict = field(default_factory=dict)    # column -> outliers counted at fit

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.bounds and self.bounds[c][0] is not None:
                lo, hi = self.bounds[c]
                x = q(c).cast("double")
                # greatest/least skip nulls, so keep nulls explicitly
                out.append(F.when(x.isNull(), F.lit(None).cast("double"))
                           .otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi))).alias(c))
            else:
                out.append(q(c))
        return df.select(*out)

    @property
    def total(self) -> int:
        return sum(self.counts.values())


def fit_cap(df: DataFrame, method: str = "iqr", cols: list[str] | None = None) -> CapModel:
    """T7 iqr: clip to Q1 - 1.5 IQR .. Q3 + 1.5 IQR.  T8 zscore: count |z| > 3
    with the population std, clip to mean +- 3 sample std."""
    cols = cols if cols is not None else numeric_cols(df)
    model = CapModel(method)
    if not cols:
        return model
    if method == "iqr":
        qs = {r["column"]: (r["q1"], r["q3"]) for r in quantiles_wide(df, cols, [0.25, 0.75], ["q1", "q3"]).collect()}
        for c in cols:
            q1, q3 = qs.get(c, (None, None))
            if q1 is None:
                model.bounds[c] = (None, None)
                continue
            iqr = q3 - q1
            model.bounds[c] = (q1 - 1.5 * iqr, q3 + 1.5 * iqr)
        cnt = df.agg(*[F.count_if((q(c) < model.bounds[c][0]) | (q(c) > model.bounds[c][1])).alias(c)
                       for c in cols if model.bounds[c][0] is not None]).first()
        model.counts = {c: int(cnt[c]) for c in cols if model.bounds[c][0] is not None}
    elif method == "zscore":
        st = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_samp(q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(q(c).cast("double")).alias(f"p{i}") for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            m, s = st[f"m{i}"], st[f"s{i}"]
            model.bounds[c] = (None, None) if m is None or s is None else (m - 3 * s, m + 3 * s)
        exprs = []
        for i, c in enumerate(cols):
            m, p = st[f"m{i}"], st[f"p{i}"]
            if m is not None and p:
                exprs.append(F.count_if(F.abs((q(c) - F.lit(m)) / F.lit(p)) > 3).alias(c))
        cnt = df.agg(*exprs).first().asDict() if exprs else {}
        model.counts = {c: int(v) for c, v in cnt.items()}
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return model


# --------------------------------------------------------------------------
# T9-T11 encoding
# --------------------------------------------------------------------------

@dataclass
class EncodeModel:
    mode: str
    label_codes: dict = field(default_factory=dict)   # column -> DataFrame(value, code), its rows and bytes
    vectors: dict = field(default_factory=dict)        # column -> fitted one-hot encoder of its codes
    onehot_values: dict = field(default_factory=dict)  # column -> sorted list of values
    order: list = field(default_factory=list)          # (column, kind) in fit order

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, kind in self.order:
            if kind in ("label", "vector"):
                codes, size, width = self.label_codes[c]
                key = F.coalesce(q(c).cast("string"), F.lit(NULL_LABEL))
                tmp = f"__key_{c}"
                cd = codes.withColumnRenamed("value", tmp).withColumnRenamed("code", f"__code_{c}")
                cd = F.broadcast(cd) if width <= BROADCAST_CODES_BYTES else cd
                cols = out.columns
                out = (out.withColumn(tmp, key).join(cd, tmp, "left")
                       .select(*[F.col(f"`__code_{c}`").cast("int").alias(c) if x == c else q(x) for x in cols],
                               *([(F.col(f"`{tmp}`") == NULL_LABEL).alias("__null")] if kind == "vector" else [])))
                null = F.col("__null")
            if kind == "vector":   # null and unseen values: all zeros
                code = F.when(null, F.lit(size)).otherwise(F.coalesce(q(c), F.lit(size)))
                out = self.vectors[c].transform(out.withColumn("__index", code)).select(
                    *[F.col("__vector").alias(c) if x == c else q(x) for x in cols])
        onehots = [c for c, kind in self.order if kind == "onehot"]
        if onehots:
            keep = [q(x) for x in out.columns if x not in onehots]
            dummies = []
            for c in onehots:
                for v in self.onehot_values[c]:
                    dummies.append(F.coalesce(q(c).cast("string") == F.lit(v), F.lit(False)).alias(f"{c}_{v}"))
            out = out.select(*keep, *dummies)
        return out

    def steps(self):
        rows = []
        for c, kind in self.order:
            n = len(self.onehot_values[c]) if kind == "onehot" else self.label_codes[c][1]
            kind = "onehot" if kind == "vector" else kind
            rows.append((c, f"{kind}_encode", str(n)))
        return rows


def label_codes(df: DataFrame, col: str) -> tuple[DataFrame, int, int]:
    """T10 fit: code = position of the value's text in the sorted distinct
    texts (missing -> 'nan').  Computed as a running count over the distinct
    values (no collect); returns the code frame, its rows and its text bytes."""
    vals = df.select(F.coalesce(q(col).cast("string"), F.lit(NULL_LABEL)).alias("x")).distinct()
    r = vals.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("x") + 16).alias("b")).first()
    ranked = rank_table(vals.withColumn("column", F.lit(col)).withColumn("cnt", F.lit(1)), max_distinct=r["n"])
    codes = ranked.select(F.col("x").alias("value"), F.col("cum_before").cast("int").alias("code"))
    return codes, r["n"], r["b"] or 0


def fit_encode(df: DataFrame, mode: str = "auto", cols: list[str] | None = None,
               max_onehot: int = 10) -> EncodeModel:
    """T9 auto (<= 10 distinct -> one-hot, else label), T10 label, T11 one-hot
    (``col_value`` booleans, all false on null, values sorted).  One-hot of more
    than ``ONEHOT_MAX_VALUES`` values is one column of sparse vectors (the
    position is the value's label code)."""
    cols = cols if cols is not None else infer_roles(df)["categorical"]
    model = EncodeModel(mode)
    if not cols:
        return model
    counts = string_value_counts(df, cols)
    nu = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # per column
    kinds = {}
    for c in cols:
        kind = ("onehot" if nu.get(c, 0) <= max_onehot else "label") if mode == "auto" else mode
        if kind not in ("onehot", "label"):
            raise ValueError(f"unknown encoding {mode!r}")
        kinds[c] = "vector" if kind == "onehot" and nu.get(c, 0) > max(max_onehot, ONEHOT_MAX_VALUES) else kind
    wide = [c for c in cols if kinds[c] == "onehot"]
    # only columns whose number of values was checked give their values to the driver
    for r in counts.where(F.col("column").isin(wide)).select("column", "s").collect() if wide else ():
        model.onehot_values.setdefault(r["column"], []).append(r["s"])
    for c in cols:
        if kinds[c] == "onehot":
            model.onehot_values[c] = sorted(model.onehot_values.get(c, []))
        else:
            model.label_codes[c] = label_codes(df, c)
        if kinds[c] == "vector":
            size = model.label_codes[c][1]
            ends = df.sparkSession.range(1).select(F.lit(float(size)).alias("__index"))
            model.vectors[c] = OneHotEncoder(inputCol="__index", outputCol="__vector").fit(ends)
        model.order.append((c, kinds[c]))
    return model


# --------------------------------------------------------------------------
# T12-T14 scaling
# --------------------------------------------------------------------------

@dataclass
class ScaleModel:
    method: str
    params: dict = field(default_factory=dict)   # column -> (center, scale)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.params:
                center, scale = self.params[c]
                out.append(((q(c).cast("double") - F.lit(center)) / F.lit(scale)).alias(c))
            else:
                out.append(q(c))
        return df.select(*out)


def fit_scale(df: DataFrame, method: str = "standard", exclude=()) -> ScaleModel:
    """T12 standard: (x - mean) / population std, zero std -> 1.
    T13 minmax: (x - min) / (max - min), constant -> 0.
    T14 robust: (x - median) / IQR, zero IQR -> 1.
    Every numeric column (label codes included, booleans not) except
    ``exclude`` -- pass the target there."""
    cols = numeric_cols(df, exclude)
    model = ScaleModel(method)
    if not cols:
        return model
    if method == "standard":
        st = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            m, s = st[f"m{i}"], st[f"s{i}"]
            if m is not None:
                model.params[c] = (m, s if s else 1.0)
    elif method == "minmax":
        st = df.agg(*[F.min(q(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                    *[F.max(q(c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            a, b = st[f"a{i}"], st[f"b{i}"]
            if a is not None:
                model.params[c] = (a, (b - a) if b != a else 1.0)
    elif method == "robust":
        qs = quantiles_wide(df, cols, [0.25, 0.5, 0.75], ["q1", "med", "q3"]).collect()
        for r in qs:
            if r["med"] is not None:
                iqr = r["q3"] - r["q1"]
                model.params[r["column"]] = (r["med"], iqr if iqr else 1.0)
    else:
        raise ValueError(f"unknown scaling {method!r}")
    return model


# --------------------------------------------------------------------------
# T15 class weights
# --------------------------------------------------------------------------

def class_weights(df: DataFrame, target: str, max_unique: int = 10) -> DataFrame:
    """Total / (k * count) per class, 3 dp, when the target is
    categorical or has at most ``max_unique`` values (else empty)."""
    counts = df.groupBy(q(target).alias("cls")).agg(F.count(F.lit(1)).alias("cnt"))
    tot = counts.agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("k"))
    is_cat = not isinstance(df.schema[target].dataType, NUMERIC_TYPES)
    w = attach(counts, tot)
    if not is_cat:
        w = w.where(F.col("k") <= max_unique)
    return w.select(F.col("cls").cast("string").alias("class"), F.col("cnt").cast("long").alias("count"),
                    F.round(F.col("total") / (F.col("k") * F.col("cnt")), 3).alias("weight"))


def with_weights(df: DataFrame, target: str, weights: DataFrame, weight_col: str = "weight") -> DataFrame:
    """Attach class weights as a ``weightCol`` (the weight table has one row per
    class, so it is broadcast)."""
    w = F.broadcast(weights.select(F.col("class").alias("__cls"), F.col("weight").alias(weight_col)))
    return df.join(w, q(target).cast("string") == F.col("__cls"), "left").drop("__cls")


# --------------------------------------------------------------------------
# T16 / T17 chain and report
# --------------------------------------------------------------------------

@dataclass
class PreprocessChain:
    impute: ImputeModel | None = None
    cap: CapModel | None = None
    encode: EncodeModel | None = None
    scale: ScaleModel | None = None
    weights: DataFrame | None = None
    target: str | None = None
    log: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in (self.impute, self.cap, self.encode, self.scale):
            if step is not None:
                df = step.transform(df)
        return df


def fit_chain(df: DataFrame, handle_missing: str = "auto", handle_outliers: str = "none",
              encode: str = "auto", scale: str = "none", target: str | None = None,
              handle_imbalance: bool = False) -> tuple[PreprocessChain, DataFrame]:
    """Missing -> outliers -> encode -> scale -> class weights, each step
    fitted on the output of the previous one.  Returns the fitted chain and the
    processed frame (lazy)."""
    chain = PreprocessChain(target=target)
    cur = df
    if handle_missing != "none":
        chain.impute = fit_impute(cur, handle_missing)
        cur = chain.impute.transform(cur)
        chain.log += [("missing", *s) for s in chain.impute.steps()]
    if handle_outliers != "none":
        chain.cap = fit_cap(cur, handle_outliers, [c for c in numeric_cols(cur) if c != target])
        cur = chain.cap.transform(cur)
        chain.log.append(("outliers", "*", f"cap_{handle_outliers}", str(chain.cap.total)))
    if encode != "none":
        cats = [c for c in infer_roles(cur)["categorical"] if c != target]
        chain.encode = fit_encode(cur, encode, cats)
        cur = chain.encode.transform(cur)
        chain.log += [("encode", *s) for s in chain.encode.steps()]
    if scale != "none":
        chain.scale = fit_scale(cur, scale, exclude=[target] if target else [])
        cur = chain.scale.transform(cur)
        chain.log.append(("scale", "*", scale, str(len(chain.scale.params))))
    if handle_imbalance and target and target in cur.columns:
        chain.weights = class_weights(cur, target)
        chain.log.append(("imbalance", target, "class_weights", ""))
    return chain, cur


def preprocess_report(spark, chain: PreprocessChain, before: DataFrame, after: DataFrame) -> DataFrame:
    """Ordered steps (seq, stage, column, action, value) plus shape rows."""
    rows = [(i + 1, *s) for i, s in enumerate(chain.log)]
    nb, na = before.count(), after.count()
    rows.append((len(rows) + 1, "shape", "*", "before", f"{nb}x{len(before.columns)}"))
    rows.append((len(rows) + 1, "shape", "*", "after", f"{na}x{len(after.columns)}"))
    return spark.createDataFrame(rows, "seq int, stage string, column string, action string, value string")

