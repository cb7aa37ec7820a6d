"""Registered queries: preprocessing (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.operators import neighbours as NB
from tablelab.operators import preprocess as PP
from tablelab.plans.fixtures import fixture, with_fixtures
from tablelab.plans.q_profile import LI_NULLS_COLS
from tablelab.plans.registry import register

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
LI_OUT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice"]


def rounded(df: DataFrame, d: int = 6) -> DataFrame:
    """Round every floating column (results of fitted statistics) to d places."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), d).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _mode_sql(c, src):
    return (f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


def _auto_fill(c, src):
    return (f"(SELECT CASE WHEN abs(coalesce(skewness({c}), 0)) > 1 THEN quantile_cont({c}, 0.5) ELSE avg({c}) END "
            f"FROM {src})")


def _select_fill(cols, src, fills: dict, dbl=()):
    out = []
    for c in cols:
        if c in fills:
            out.append(f"{fills[c]} AS {c}")
        elif c in dbl:
            out.append(f"round(CAST({c} AS DOUBLE), 6) AS {c}")
        else:
            out.append(c)
    return f"SELECT {', '.join(out)} FROM {src}"


LI_DBL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ------------------------------------------------------------------ T1-T4, T6

@register("impute_auto", with_fixtures(_select_fill(LI_NULLS_COLS, "li_nulls", {
    "l_discount": f"round(coalesce(l_discount, {_auto_fill('l_discount', 'li_nulls')}), 6)",
    "l_tax": f"round(coalesce(l_tax, {_auto_fill('l_tax', 'li_nulls')}), 6)",
    "l_returnflag": f"coalesce(l_returnflag, {_mode_sql('l_returnflag', 'li_nulls')})"}, LI_DBL), "li_nulls"), "T1")
def impute_auto(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    return rounded(PP.fit_impute(df, "auto").transform(df))


SKEW_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "skewed", "l_discount", "l_tax"]


@register("impute_skewed", with_fixtures(_select_fill(SKEW_COLS, "li_skewed", {
    "skewed": f"round(coalesce(skewed, {_auto_fill('skewed', 'li_skewed')}), 6)",
    "l_discount": f"round(coalesce(l_discount, {_auto_fill('l_discount', 'li_skewed')}), 6)"},
    ["l_tax"]), "li_skewed"), "T1")
def impute_skewed(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_skewed")
    return rounded(PP.fit_impute(df, "auto").transform(df))


@register("impute_drop", with_fixtures(
    "SELECT * FROM li_nulls WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in LI_NULLS_COLS), "li_nulls"), "T2")
def impute_drop(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    return PP.fit_impute(df, "drop").transform(df)


@register("impute_mean", with_fixtures(_select_fill(LI_NULLS_COLS, "li_nulls", {
    "l_discount": "round(coalesce(l_discount, (SELECT avg(l_discount) FROM li_nulls)), 6)",
    "l_tax": "round(coalesce(l_tax, (SELECT avg(l_tax) FROM li_nulls)), 6)"}, LI_DBL), "li_nulls"), "T3")
def impute_mean(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    return rounded(PP.fit_impute(df, "mean").transform(df))


@register("impute_median", with_fixtures(_select_fill(LI_NULLS_COLS, "li_nulls", {
    "l_discount": "round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM li_nulls)), 6)",
    "l_tax": "round(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM li_nulls)), 6)"}, LI_DBL), "li_nulls"), "T3")
def impute_median(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    return rounded(PP.fit_impute(df, "median").transform(df))


@register("impute_mode", with_fixtures(_select_fill(LI_NULLS_COLS, "li_nulls", {
    "l_discount": f"round(coalesce(l_discount, {_mode_sql('l_discount', 'li_nulls')}), 6)",
    "l_tax": f"round(coalesce(l_tax, {_mode_sql('l_tax', 'li_nulls')}), 6)",
    "l_returnflag": f"coalesce(l_returnflag, {_mode_sql('l_returnflag', 'li_nulls')})"}, LI_DBL), "li_nulls"), "T4")
def impute_mode(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    return rounded(PP.fit_impute(df, "mode").transform(df))

# ------------------------------------------------------------------ T5

_KNN_COLS = ["p_size", "p_retailprice", "p_mod"]


def _knn_fill(c: str) -> str:
    ss = " + ".join(f"coalesce((a.{x} - b.{x}) * (a.{x} - b.{x}), 0)" for x in _KNN_COLS)
    both = " + ".join(f"CAST(a.{x} IS NOT NULL AND b.{x} IS NOT NULL AS INTEGER)" for x in _KNN_COLS)
    return f"""{c}_d AS (SELECT a.p_partkey, b.{c} AS x, row_number() OVER (
            PARTITION BY a.p_partkey ORDER BY round(sqrt({ss}) * sqrt({ss}) * (3.0 / ({both})), 9), b.p_partkey) AS r
          FROM part_nulls a JOIN part_nulls b ON a.{c} IS NULL AND b.{c} IS NOT NULL AND {both} > 0),
        {c}_f AS (SELECT p_partkey, avg(x) AS x FROM {c}_d WHERE r <= 5 GROUP BY 1)"""


@register("impute_knn", with_fixtures(
    "WITH " + ",\n".join(map(_knn_fill, _KNN_COLS)) + " SELECT p_partkey, "
    + ", ".join(f"round(coalesce(n.{c}, {c}_f.x, (SELECT avg({c}) FROM part_nulls)), 6) AS {c}" for c in _KNN_COLS)
    + " FROM part_nulls n " + " ".join(f"LEFT JOIN {c}_f USING (p_partkey)" for c in _KNN_COLS), "part_nulls"), "T5")
def impute_knn(spark, sf_dir):
    """Mean of the five nearest rows that have the column (all patterns of missing columns at once)."""
    return rounded(NB.impute_knn(fixture(spark, sf_dir, "part_nulls"), ["p_partkey"]))


@register("missing_handled", with_fixtures(
    "SELECT CAST(" + " + ".join(f"(count(*) - count({c}))" for c in LI_NULLS_COLS) + " AS BIGINT) AS missing_before, "
    "CAST(0 AS BIGINT) AS missing_after, CAST(" + " + ".join(f"(count(*) - count({c}))" for c in LI_NULLS_COLS)
    + " AS BIGINT) AS missing_handled FROM li_nulls", "li_nulls"), "T6")
def missing_handled(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    after = PP.fit_impute(df, "auto").transform(df)
    b, a = PP.null_total(df), PP.null_total(after)
    return spark.createDataFrame([(b, a, b - a)], "missing_before long, missing_after long, missing_handled long")


# ------------------------------------------------------------------ T7, T8

def _iqr_bounds(cols, src):
    return ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)


def _clip(c, lo, hi):
    return f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), {lo}), {hi}) END, 6) AS {c}"


@register("cap_iqr", with_fixtures(
    f"WITH b AS (SELECT {_iqr_bounds(LI_OUT, 'li_outliers')} FROM li_outliers)\n"
    "SELECT " + ", ".join(_clip(c, f"q1_{c} - 1.5 * (q3_{c} - q1_{c})", f"q3_{c} + 1.5 * (q3_{c} - q1_{c})") for c in LI_OUT)
    + " FROM li_outliers, b", "li_outliers"), "T7")
def cap_iqr(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_outliers")
    return rounded(PP.fit_cap(df, "iqr").transform(df))


@register("cap_iqr_counts", with_fixtures(
    f"WITH b AS (SELECT {_iqr_bounds(LI_OUT, 'li_outliers')} FROM li_outliers)\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR "
        f"{c} > q3_{c} + 1.5 * (q3_{c} - q1_{c})) AS BIGINT) AS n_outliers, "
        f"round(any_value(q1_{c} - 1.5 * (q3_{c} - q1_{c})), 6) AS lo, round(any_value(q3_{c} + 1.5 * (q3_{c} - q1_{c})), 6) AS hi "
        f"FROM li_outliers, b" for c in LI_OUT), "li_outliers"), "T7")
def cap_iqr_counts(spark, sf_dir):
    m = PP.fit_cap(fixture(spark, sf_dir, "li_outliers"), "iqr")
    return spark.createDataFrame([(c, m.counts[c], round(m.bounds[c][0], 6), round(m.bounds[c][1], 6)) for c in m.counts],
                                 "column string, n_outliers long, lo double, hi double")


@register("cap_zscore", with_fixtures(
    "WITH b AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in LI_OUT) + " FROM li_outliers)\n"
    "SELECT " + ", ".join(_clip(c, f"m_{c} - 3 * s_{c}", f"m_{c} + 3 * s_{c}") for c in LI_OUT)
    + " FROM li_outliers, b", "li_outliers"), "T8")
def cap_zscore(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_outliers")
    return rounded(PP.fit_cap(df, "zscore").transform(df))


@register("cap_zscore_counts", with_fixtures(
    "WITH b AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS p_{c}" for c in LI_OUT) + " FROM li_outliers)\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE abs(({c} - m_{c}) / p_{c}) > 3) AS BIGINT) AS n_outliers "
        f"FROM li_outliers, b" for c in LI_OUT), "li_outliers"), "T8")
def cap_zscore_counts(spark, sf_dir):
    m = PP.fit_cap(fixture(spark, sf_dir, "li_outliers"), "zscore")
    return spark.createDataFrame([(c, m.counts.get(c, 0)) for c in LI_OUT], "column string, n_outliers long")


# ------------------------------------------------------------------ T9-T11

LI_NONCAT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_shipdate"]


@register("encode_auto", with_fixtures(
    "SELECT " + ", ".join(LI_NONCAT) + ", "
    + ", ".join(f"coalesce(l_returnflag = '{v}', false) AS l_returnflag_{v}" for v in ["A", "N", "R"]) + ", "
    + ", ".join(f"coalesce(l_linestatus = '{v}', false) AS l_linestatus_{v}" for v in ["F", "O"])
    + " FROM li_nulls", "li_nulls"), "T9", "T11")
def encode_auto(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    return PP.fit_encode(df, "auto").transform(df)


def _label_sql(cols, src, rest):
    joins, sel = [], list(rest)
    for c in cols:
        joins.append(f"""LEFT JOIN (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
                                    FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS v FROM {src}) d) k_{c}
                         ON coalesce(CAST(t.{c} AS VARCHAR), 'nan') = k_{c}.v""")
        sel.append(f"k_{c}.code AS {c}")
    return f"SELECT {', '.join(sel)} FROM {src} t " + " ".join(joins)


@register("label_encode", with_fixtures(_label_sql(
    ["l_returnflag", "l_linestatus"], "li_nulls", [f"t.{c}" for c in LI_NONCAT]), "li_nulls"), "T10")
def label_encode(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    return PP.fit_encode(df, "label").transform(df)


@register("label_encode_part", _label_sql(["p_name", "p_brand"], "part",
                                          ["t.p_partkey", "t.p_size", "t.p_retailprice"]), "T9", "T10")
def label_encode_part(spark, sf_dir):
    df = fixture(spark, sf_dir, "part").drop("p_type")
    return PP.fit_encode(df, "auto").transform(df)


def _onehot_sql():
    types = "(SELECT list(DISTINCT p_type ORDER BY p_type) FROM part)"
    return f"""SELECT p_partkey, p_name, p_brand, p_size, p_retailprice,
                      list_transform({types}, t -> p_type = t) AS flags FROM part"""


@register("one_hot", """
    SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, list(p_type = t ORDER BY t) AS flags,
           list('p_type_' || t ORDER BY t) AS names
    FROM part, (SELECT DISTINCT p_type AS t FROM part) v
    GROUP BY p_partkey, p_name, p_brand, p_size, p_retailprice""", "T11")
def one_hot(spark, sf_dir):
    df = fixture(spark, sf_dir, "part")
    out = PP.fit_encode(df, "onehot", ["p_type"]).transform(df)
    dummies = [c for c in out.columns if c.startswith("p_type_")]
    return out.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice",
                      F.array(*[F.col(c) for c in dummies]).alias("flags"),
                      F.array(*[F.lit(c) for c in dummies]).alias("names"))


# ------------------------------------------------------------------ T12-T14

def _scale_sql(method):
    if method == "standard":
        st = ", ".join(f"avg({c}) AS a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS b_{c}" for c in LI_NUM)
    elif method == "minmax":
        st = ", ".join(f"min({c}) AS a_{c}, coalesce(nullif(max({c}) - min({c}), 0), 1) AS b_{c}" for c in LI_NUM)
    else:
        st = ", ".join(f"quantile_cont({c}, 0.5) AS a_{c}, coalesce(nullif(quantile_cont({c}, 0.75) - "
                       f"quantile_cont({c}, 0.25), 0), 1) AS b_{c}" for c in LI_NUM)
    return with_fixtures(f"WITH s AS (SELECT {st} FROM li_num)\nSELECT "
                         + ", ".join(f"round((CAST({c} AS DOUBLE) - a_{c}) / b_{c}, 6) AS {c}" for c in LI_NUM)
                         + " FROM li_num, s", "li_num")


@register("scale_standard", _scale_sql("standard"), "T12")
def scale_standard(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_num")
    return rounded(PP.fit_scale(df, "standard").transform(df))


@register("scale_minmax", _scale_sql("minmax"), "T13")
def scale_minmax(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_num")
    return rounded(PP.fit_scale(df, "minmax").transform(df))


@register("scale_robust", _scale_sql("robust"), "T14")
def scale_robust(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_num")
    return rounded(PP.fit_scale(df, "robust").transform(df))


# ------------------------------------------------------------------ T15-T17

@register("class_weights", with_fixtures("""
    SELECT grade AS class, CAST(count(*) AS BIGINT) AS count,
           round((SELECT count(*) FROM li_imbalanced) * 1.0 / ((SELECT count(DISTINCT grade) FROM li_imbalanced) * count(*)), 3) AS weight
    FROM li_imbalanced GROUP BY grade""", "li_imbalanced"), "T15")
def class_weights(spark, sf_dir):
    return PP.class_weights(fixture(spark, sf_dir, "li_imbalanced"), "grade")


@register("class_weights_numeric", """
    SELECT CAST(l_linenumber AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS count,
           round((SELECT count(*) FROM lineitem) * 1.0 / ((SELECT count(DISTINCT l_linenumber) FROM lineitem) * count(*)), 3) AS weight
    FROM lineitem GROUP BY l_linenumber""", "T15")
def class_weights_numeric(spark, sf_dir):
    return PP.class_weights(fixture(spark, sf_dir, "lineitem"), "l_linenumber")


@register("preprocess_report", None, "T16")
def preprocess_report(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    chain, out = PP.fit_chain(df, "auto", "iqr", "auto", "standard")
    return PP.preprocess_report(spark, chain, df, out)


def _chain_sql():
    num = LI_NUM
    fills = {
        "l_discount": f"coalesce(l_discount, {_auto_fill('l_discount', 'li_nulls')})",
        "l_tax": f"coalesce(l_tax, {_auto_fill('l_tax', 'li_nulls')})",
        "l_returnflag": f"coalesce(l_returnflag, {_mode_sql('l_returnflag', 'li_nulls')})"}
    imp = "SELECT " + ", ".join(f"{fills.get(c, c)} AS {c}" for c in LI_NULLS_COLS) + " FROM li_nulls"
    b = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in num)
    cap = ("SELECT " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), q1_{c} - 1.5 * (q3_{c} - q1_{c})), "
        f"q3_{c} + 1.5 * (q3_{c} - q1_{c})) END AS {c}" for c in num)
        + ", l_returnflag, l_linestatus, l_shipdate FROM imp, bq")
    enc = ("SELECT " + ", ".join(num) + ", l_shipdate, "
           + ", ".join(f"coalesce(l_returnflag = '{v}', false) AS l_returnflag_{v}" for v in ["A", "N", "R"]) + ", "
           + ", ".join(f"coalesce(l_linestatus = '{v}', false) AS l_linestatus_{v}" for v in ["F", "O"]) + " FROM cap")
    st = ", ".join(f"avg({c}) AS a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS b_{c}" for c in num)
    fin = ("SELECT " + ", ".join(f"round(({c} - a_{c}) / b_{c}, 6) AS {c}" for c in num) + ", l_shipdate, "
           + ", ".join(f"l_returnflag_{v}" for v in ["A", "N", "R"]) + ", "
           + ", ".join(f"l_linestatus_{v}" for v in ["F", "O"]) + " FROM enc, st")
    return with_fixtures(f"WITH imp AS ({imp}), bq AS (SELECT {b} FROM imp), cap AS ({cap}), enc AS ({enc}), "
                         f"st AS (SELECT {st} FROM enc)\n{fin}", "li_nulls")


@register("preprocess_chain", _chain_sql(), "T17")
def preprocess_chain(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    _, out = PP.fit_chain(df, "auto", "iqr", "auto", "standard")
    return rounded(out)
