"""Registered queries: exploratory statistics (E)."""

from __future__ import annotations

import uuid
from statistics import NormalDist

from tablelab.functions.stats import normal_quantile_sql, sample_key_sql
from tablelab.operators import eda as E
from tablelab.plans.fixtures import fixture, with_fixtures
from tablelab.plans.q_profile import LI_KEY, LI_NULLS_COLS
from tablelab.plans.registry import register, union_all
from tablelab.session import ensure_checkpoint_dir
from tablelab.sources import ledger

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
LI_OUT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_CATS = ["p_name", "p_brand", "p_type"]
SCORE_NUM = ["score", "label", "actual", "predicted"]


def _r(x: str, d: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {d})"


def _each(cols, template, source):
    return union_all([f"SELECT {template.format(c=c, i=i)} FROM {source}" for i, c in enumerate(cols)])


# ------------------------------------------------------------------ E1

@register("missing_pattern", with_fixtures(
    "SELECT concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in LI_NULLS_COLS)
    + ") AS pattern, " + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in LI_NULLS_COLS)
    + " AS n_null_cells, count(*) AS n_rows FROM li_nulls GROUP BY ALL", "li_nulls"), "E1")
def missing_pattern(spark, sf_dir):
    return E.missing_pattern(fixture(spark, sf_dir, "li_nulls"))


@register("missing_totals", with_fixtures(
    "SELECT CAST(" + " + ".join(f"(count(*) - count({c}))" for c in LI_NULLS_COLS) + " AS BIGINT) AS total_missing, "
    "CAST(" + " + ".join(f"CAST(count(*) > count({c}) AS INTEGER)" for c in LI_NULLS_COLS)
    + " AS INTEGER) AS columns_with_missing FROM li_nulls", "li_nulls"), "E1")
def missing_totals(spark, sf_dir):
    return E.missing_totals(fixture(spark, sf_dir, "li_nulls"))


# ------------------------------------------------------------------ E2, E2b, E2c, E13

def _hist_sql(cols, source, bins):
    parts = []
    for c in cols:
        parts.append(f"""
        SELECT '{c}' AS "column", bin, round(mn + bin * (mx - mn) / {bins}, 6) AS lo,
               round(mn + (bin + 1) * (mx - mn) / {bins}, 6) AS hi, count(*) AS cnt,
               round(count(*) / (n * (mx - mn) / {bins}), 6) AS density
        FROM (SELECT r.mn, r.mx, r.n,
                     CAST(coalesce(least(floor((x - r.mn) / nullif(r.mx - r.mn, 0) * {bins}), {bins - 1}), 0) AS INTEGER) AS bin
              FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source} WHERE {c} IS NOT NULL) v,
                   (SELECT min(CAST({c} AS DOUBLE)) AS mn, max(CAST({c} AS DOUBLE)) AS mx, count({c}) AS n FROM {source}) r) t
        GROUP BY bin, mn, mx, n""")
    return union_all(parts)


@register("histogram", with_fixtures(_hist_sql(LI_NUM, "li_num", 20), "li_num"), "E2")
def histogram(spark, sf_dir):
    return E.histogram(fixture(spark, sf_dir, "li_num"), LI_NUM, 20)


SKEW_DESC = "CASE WHEN abs(s) > 1 THEN 'highly skewed' WHEN abs(s) > 0.5 THEN 'moderately skewed' ELSE 'symmetric' END"


@register("distribution_summary", with_fixtures(
    f"SELECT \"column\", n, mean, median, std, round(s, 6) AS skew, {SKEW_DESC} AS skew_desc FROM ("
    + _each(LI_NUM, "'{c}' AS \"column\", count({c}) AS n, " + _r("avg({c})") + " AS mean, "
            + _r("quantile_cont({c}, 0.5)") + " AS median, " + _r("stddev_samp({c})") + " AS std, "
            "CAST(skewness({c}) AS DOUBLE) AS s", "li_num") + ") t", "li_num"), "E2", "E2c")
def distribution_summary(spark, sf_dir):
    return E.distribution_summary(fixture(spark, sf_dir, "li_num"), LI_NUM)


@register("distribution_skewed", with_fixtures(
    f"SELECT \"column\", n, mean, median, std, round(s, 6) AS skew, {SKEW_DESC} AS skew_desc FROM ("
    + _each(["skewed", "l_discount", "l_tax"], "'{c}' AS \"column\", count({c}) AS n, " + _r("avg({c})") + " AS mean, "
            + _r("quantile_cont({c}, 0.5)") + " AS median, " + _r("stddev_samp({c})") + " AS std, "
            "CAST(skewness({c}) AS DOUBLE) AS s", "li_skewed") + ") t", "li_skewed"), "E2", "E2c")
def distribution_skewed(spark, sf_dir):
    return E.distribution_summary(fixture(spark, sf_dir, "li_skewed"), ["skewed", "l_discount", "l_tax"])


@register("normality_jb", with_fixtures(
    "SELECT \"column\", n, round(sp, 6) AS skew_pop, round(kp, 6) AS kurt_pop, round(n / 6.0 * (sp * sp + kp * kp / 4.0), 4) AS jb, "
    "round(exp(-(n / 6.0 * (sp * sp + kp * kp / 4.0)) / 2.0), 6) AS p_value, "
    "exp(-(n / 6.0 * (sp * sp + kp * kp / 4.0)) / 2.0) > 0.05 AS is_normal FROM ("
    + _each(LI_NUM, "'{c}' AS \"column\", count({c}) AS n, "
            "coalesce(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)), 0) AS sp, "
            "coalesce(kurtosis_pop({c}), 0) AS kp", "li_num") + ") t WHERE n >= 8", "li_num"), "E2b")
def normality_jb(spark, sf_dir):
    return E.normality_jb(fixture(spark, sf_dir, "li_num"), LI_NUM)


def _w_prime_sql(cols, source):
    parts = [f"""
        SELECT '{c}' AS "column", count(*) AS n, pow(corr(x, m), 2) AS w FROM (
            SELECT x, {normal_quantile_sql('p')} AS m FROM (
                SELECT CAST({c} AS DOUBLE) AS x,
                       (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 - 0.375)
                       / (count(*) OVER () + 0.25) AS p
                FROM {source} WHERE {c} IS NOT NULL) r) t HAVING count(*) >= 5 AND min(x) < max(x)""" for c in cols]
    return f"""
        SELECT "column", n, round(w, 6) AS w_prime, round(z, 4) AS z, z < 1.6449 AS is_normal FROM (
            SELECT *, (ln(greatest(1 - w, 1e-12)) - (-1.2725 + 1.0521 * (ln(ln(n)) - ln(n))))
                      / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))) AS z FROM ({union_all(parts)}) a) b"""


@register("normality_order", with_fixtures(_w_prime_sql(LI_NUM, "li_num"), "li_num"), "E2b")
def normality_order(spark, sf_dir):
    return E.normality_order(fixture(spark, sf_dir, "li_num"), LI_NUM)


def _band(v, a, b):
    return f"CASE WHEN abs({v}) < {a} THEN 'low' WHEN abs({v}) < {b} THEN 'medium' ELSE 'high' END"


@register("skew_kurtosis", with_fixtures(
    f"SELECT \"column\", n, round(g1, 6) AS skewness, round(g2, 6) AS kurtosis, {_band('g1', 0.5, 1.0)} AS skew_band, "
    f"{_band('g2', 3.0, 5.0)} AS kurt_band FROM ("
    + _each(LI_NUM, "'{c}' AS \"column\", count({c}) AS n, CAST(skewness({c}) AS DOUBLE) AS g1, "
            "CAST(kurtosis({c}) AS DOUBLE) AS g2", "li_num") + ") t WHERE n >= 3", "li_num"), "E13")
def skew_kurtosis(spark, sf_dir):
    return E.skew_kurtosis(fixture(spark, sf_dir, "li_num"), LI_NUM)


# ------------------------------------------------------------------ E3, E4, E22, E25

def _box_sql(cols, source, with_mean=False):
    parts = []
    for c in cols:
        mean = ", round(avg(x), 4) AS mean" if with_mean else ""
        parts.append(f"""
        SELECT '{c}' AS "column", count(x) AS n, {_r('q1')} AS q1, {_r('med')} AS median, {_r('q3')} AS q3,
               {_r('q3 - q1')} AS iqr,
               {_r('min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))')} AS whisker_lo,
               {_r('max(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))')} AS whisker_hi,
               CAST(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_fliers{mean}
        FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source} WHERE {c} IS NOT NULL) v,
             (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3
              FROM {source}) qq
        GROUP BY q1, med, q3""")
    return union_all(parts)


@register("box_stats", with_fixtures(_box_sql(LI_NUM, "li_num"), "li_num"), "E3")
def box_stats(spark, sf_dir):
    return E.box_stats(fixture(spark, sf_dir, "li_num"), LI_NUM)


@register("box_means", with_fixtures(_box_sql(LI_OUT, "li_outliers", True), "li_outliers"), "E22")
def box_means(spark, sf_dir):
    return E.box_stats(fixture(spark, sf_dir, "li_outliers"), LI_OUT, with_mean=True)


@register("violin_stats", with_fixtures(_each(
    LI_NUM, "'{c}' AS \"column\", count({c}) AS n, " + ", ".join([
        _r("min({c})") + " AS min", _r("quantile_cont({c}, 0.25)") + " AS q1", _r("quantile_cont({c}, 0.5)") + " AS median",
        _r("quantile_cont({c}, 0.75)") + " AS q3", _r("max({c})") + " AS max"]), "li_num"), "li_num"), "E4")
def violin_stats(spark, sf_dir):
    return E.violin_stats(fixture(spark, sf_dir, "li_num"), LI_NUM)


def _outlier_sql(cols, source):
    parts = [f"""
        SELECT '{c}' AS "column", count(x) AS n,
               count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_out
        FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source} WHERE {c} IS NOT NULL) v,
             (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}) qq""" for c in cols]
    return f"""SELECT "column", n, CAST(n_out AS BIGINT) AS n_outliers, round(n_out * 100.0 / n, 4) AS outlier_pct,
                      CASE WHEN n_out * 100.0 / n > 10 THEN 'high' WHEN n_out * 100.0 / n > 5 THEN 'medium' ELSE 'low' END AS band
               FROM ({union_all(parts)}) t WHERE n >= 4 AND n_out > 0"""


@register("outlier_share", with_fixtures(_outlier_sql(LI_OUT, "li_outliers"), "li_outliers"), "E25")
def outlier_share(spark, sf_dir):
    return E.outlier_share(fixture(spark, sf_dir, "li_outliers"), LI_OUT)


# ------------------------------------------------------------------ E5, E11, E24

def _topcat_sql(cols, source, k):
    long = union_all([f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS s FROM {source}" for c in cols])
    return f"""
        WITH vc AS (SELECT "column", s, count(*) AS cnt FROM ({long}) x WHERE s IS NOT NULL GROUP BY "column", s),
             rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, s) AS rnk,
                           count(*) OVER (PARTITION BY "column") AS nu FROM vc)
        SELECT "column", CAST(rnk AS INTEGER) AS rank, s AS value, CAST(cnt AS BIGINT) AS cnt, nu > {k} AS truncated
        FROM rk WHERE rnk <= {k}"""


@register("top_categories", _topcat_sql(PART_CATS, "part", 12), "E5")
def top_categories(spark, sf_dir):
    return E.top_categories(fixture(spark, sf_dir, "part"), PART_CATS, 12)


@register("category_shares", f"""
    SELECT "column", rank, value, cnt, round(cnt * 1.0 / sum(cnt) OVER (PARTITION BY "column"), 6) AS share
    FROM ({_topcat_sql(PART_CATS, 'part', 10)}) t""", "E11")
def category_shares(spark, sf_dir):
    return E.category_shares(fixture(spark, sf_dir, "part"), PART_CATS, 10)


def _crosstab_sql(c1, c2, source, k=5):
    def top(c):
        return (f"SELECT s FROM (SELECT CAST({c} AS VARCHAR) AS s, count(*) AS cnt FROM {source} WHERE {c} IS NOT NULL "
                f"GROUP BY 1) v ORDER BY cnt DESC, s LIMIT {k}")
    return f"""
        WITH lab AS (SELECT CASE WHEN CAST({c1} AS VARCHAR) IN ({top(c1)}) THEN CAST({c1} AS VARCHAR) ELSE 'Other' END AS v1,
                            CASE WHEN CAST({c2} AS VARCHAR) IN ({top(c2)}) THEN CAST({c2} AS VARCHAR) ELSE 'Other' END AS v2
                     FROM {source}),
             cells AS (SELECT v1, v2, count(*) AS cnt FROM lab GROUP BY v1, v2)
        SELECT v1, v2, CAST(cnt AS BIGINT) AS cnt, round(cnt * 1.0 / sum(cnt) OVER (PARTITION BY v1), 6) AS share FROM cells"""


@register("crosstab_shares", _crosstab_sql("p_name", "p_brand", "part"), "E24")
def crosstab_shares(spark, sf_dir):
    return E.crosstab_shares(fixture(spark, sf_dir, "part"), "p_name", "p_brand")


@register("crosstab_nulls", with_fixtures(_crosstab_sql("l_returnflag", "l_linestatus", "li_nulls"), "li_nulls"), "E24")
def crosstab_nulls(spark, sf_dir):
    return E.crosstab_shares(fixture(spark, sf_dir, "li_nulls"), "l_returnflag", "l_linestatus")


# ------------------------------------------------------------------ E6, E6b, E16, E16b, E21b, E23, E12

def _corr_expr(a, b):
    return (f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) * "
            f"stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL), 0)")


def _corr_long_sql(cols, source):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            lo, hi = (a, b) if i <= j else (b, a)
            aa = f"CAST({lo} AS DOUBLE)"
            bb = f"CAST({hi} AS DOUBLE)"
            r = _corr_expr(aa, bb)
            val = f"CASE WHEN ({r}) IS NOT NULL THEN 1.0 END" if i == j else f"round({r}, 6)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS i, {j} AS j, CAST({val} AS DOUBLE) AS r FROM {source}")
    return union_all(parts)


@register("pearson_matrix", with_fixtures(_corr_long_sql(LI_NUM, "li_num"), "li_num"), "E6")
def pearson_matrix(spark, sf_dir):
    return E.pearson_matrix(fixture(spark, sf_dir, "li_num"), LI_NUM)


@register("strong_pairs", with_fixtures(f"""
    SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC, i, j) AS INTEGER) AS rank, col_a, col_b, r
    FROM ({_corr_long_sql(SCORE_NUM, 'det_score')}) c WHERE i < j AND abs(r) > 0.7
    ORDER BY abs(r) DESC, i, j LIMIT 5""", "det_score"), "E6b")
def strong_pairs(spark, sf_dir):
    return E.strong_pairs(E.pearson_matrix(fixture(spark, sf_dir, "det_score"), SCORE_NUM))


@register("top_abs_corr", with_fixtures(f"""
    SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC, i, j) AS INTEGER) AS rank, col_a, col_b, r
    FROM ({_corr_long_sql(LI_NUM, 'li_num')}) c WHERE i < j AND abs(r) < 1 AND r IS NOT NULL
    ORDER BY abs(r) DESC, i, j LIMIT 10""", "li_num"), "E16b")
def top_abs_corr(spark, sf_dir):
    return E.top_abs_corr(E.pearson_matrix(fixture(spark, sf_dir, "li_num"), LI_NUM))


@register("feature_distance", with_fixtures(f"""
    WITH c AS (SELECT col_a, col_b, coalesce(r, 0.0) AS r FROM ({_corr_long_sql(LI_NUM, 'li_num')}) x)
    SELECT a.col_a AS f1, b.col_a AS f2, round(sqrt(sum((a.r - b.r) * (a.r - b.r))), 6) AS distance
    FROM c a JOIN c b ON a.col_b = b.col_b GROUP BY a.col_a, b.col_a""", "li_num"), "E16")
def feature_distance(spark, sf_dir):
    return E.feature_distance(E.pearson_matrix(fixture(spark, sf_dir, "li_num"), LI_NUM))


@register("comissing_corr", with_fixtures(
    "WITH ind AS (SELECT " + ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS {c}" for c in LI_NULLS_COLS) + " FROM li_nulls)\n"
    + _corr_long_sql(LI_NULLS_COLS, "ind"), "li_nulls"), "E21b")
def comissing_corr(spark, sf_dir):
    return E.comissing_corr(fixture(spark, sf_dir, "li_nulls"))


def _trend_sql(cols, source):
    parts = []
    for i, yc in enumerate(cols):
        for j, xc in enumerate(cols):
            if i == j:
                continue
            x, y = f"CAST({xc} AS DOUBLE)", f"CAST({yc} AS DOUBLE)"
            slope = f"covar_pop({x}, {y}) / nullif(var_pop({x}) FILTER (WHERE {y} IS NOT NULL), 0)"
            icpt = (f"avg({y}) FILTER (WHERE {x} IS NOT NULL) - ({slope}) * avg({x}) FILTER (WHERE {y} IS NOT NULL)")
            parts.append(f"SELECT '{xc}' AS x, '{yc}' AS y, count({x}) FILTER (WHERE {y} IS NOT NULL) AS n, "
                         f"round({slope}, 6) AS slope, round({icpt}, 4) AS intercept FROM {source}")
    return f"SELECT x, y, CAST(n AS BIGINT) AS n, slope, intercept FROM ({union_all(parts)}) t WHERE n > 5"


@register("trend_lines", with_fixtures(_trend_sql(LI_NUM, "li_num"), "li_num"), "E23")
def trend_lines(spark, sf_dir):
    return E.trend_lines(fixture(spark, sf_dir, "li_num"), LI_NUM)


@register("trend_histograms", with_fixtures(_hist_sql(LI_NUM, "li_num", 25), "li_num"), "E23")
def trend_histograms(spark, sf_dir):
    return E.histogram(fixture(spark, sf_dir, "li_num"), LI_NUM, 25)


def _spearman_sql(cols, source):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j <= i:
                continue
            parts.append(f"""
            SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS rho
            FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
                         rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb
                  FROM (SELECT CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM {source}
                        WHERE {a} IS NOT NULL AND {b} IS NOT NULL) p) r""")
    up = union_all(parts)
    diag = union_all([f"SELECT '{c}', '{c}', CASE WHEN count(DISTINCT {c}) > 1 THEN 1.0 END FROM {source}" for c in cols])
    return f"WITH up AS ({up}) SELECT * FROM up UNION ALL SELECT col_b, col_a, rho FROM up UNION ALL {diag}"


SPEAR_COLS = LI_NUM


@register("spearman_matrix", with_fixtures(_spearman_sql(SPEAR_COLS, "li_num"), "li_num"), "E12")
def spearman_matrix(spark, sf_dir):
    return E.spearman_matrix(fixture(spark, sf_dir, "li_num"), SPEAR_COLS)


# ------------------------------------------------------------------ E7, E15, E19, E20

def _sample_sql(select, source, key, n, where="TRUE"):
    k = sample_key_sql(key)
    return f"SELECT {select} FROM {source} WHERE {where} ORDER BY {k}, {', '.join(key)} LIMIT {n}"


@register("pair_sample", with_fixtures(_sample_sql(
    ", ".join(LI_KEY + MEASURES), "li_num", LI_KEY, 500,
    " AND ".join(f"{c} IS NOT NULL" for c in MEASURES)), "li_num"), "E7")
def pair_sample(spark, sf_dir):
    return E.pair_sample(fixture(spark, sf_dir, "li_num"), MEASURES, LI_KEY, None, 500)


@register("scatter_sample", with_fixtures(_sample_sql(
    ", ".join(LI_KEY + ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]), "li_nulls", LI_KEY, 500,
    " AND ".join(f"{c} IS NOT NULL" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"])),
    "li_nulls"), "E15")
def scatter_sample(spark, sf_dir):
    return E.pair_sample(fixture(spark, sf_dir, "li_nulls"), ["l_quantity", "l_extendedprice", "l_discount"],
                         LI_KEY, "l_returnflag", 500)


ZCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("zscore_matrix", with_fixtures(f"""
    WITH s AS ({_sample_sql(', '.join(LI_KEY + ZCOLS), 'li_num', LI_KEY, 200,
                            ' AND '.join(f'{c} IS NOT NULL' for c in ZCOLS))}),
         st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in ZCOLS)} FROM s)
    {union_all([f"SELECT {', '.join(LI_KEY)}, '{c}' AS \"column\", round(({c} - m_{c}) / s_{c}, 6) AS z FROM s, st" for c in ZCOLS])}
    """, "li_num"), "E19")
def zscore_matrix(spark, sf_dir):
    return E.zscore_matrix(fixture(spark, sf_dir, "li_num"), ZCOLS, LI_KEY, 200)


PC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("parallel_coordinates", with_fixtures(f"""
    WITH e AS (SELECT quantile_cont(l_quantity, {1 / 3!r}) AS e1, quantile_cont(l_quantity, {2 / 3!r}) AS e2 FROM li_num),
         b AS (SELECT {', '.join(LI_KEY)}, {', '.join(c for c in PC_COLS if c not in LI_KEY)},
                      CASE WHEN l_quantity <= e1 THEN 'Low' WHEN l_quantity <= e2 THEN 'Mid'
                           WHEN l_quantity IS NOT NULL THEN 'High' END AS class
               FROM li_num, e)
    {_sample_sql('*', 'b', LI_KEY, 300, ' AND '.join(f'{c} IS NOT NULL' for c in PC_COLS + ['class']))}""", "li_num"),
    "E20")
def parallel_coordinates(spark, sf_dir):
    return E.parallel_coordinates(fixture(spark, sf_dir, "li_num"), PC_COLS, LI_KEY, None, 300)


@register("parallel_coordinates_class", f"""
    {_sample_sql('o_orderkey, o_custkey, o_totalprice, o_orderstatus AS class', 'orders', ['o_orderkey', 'o_custkey'], 300)}""",
          "E20")
def parallel_coordinates_class(spark, sf_dir):
    return E.parallel_coordinates(fixture(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderkey", "o_custkey"],
                                  "o_orderstatus", 300)


# ------------------------------------------------------------------ E8, E9, E10, E17, E18

@register("time_series", """
    SELECT CAST(date_trunc('day', ts) AS DATE) AS bucket, count(*) AS n, round(avg(value), 6) AS avg_value,
           min(value) AS min_value, max(value) AS max_value
    FROM events WHERE ts IS NOT NULL GROUP BY 1""", "E8")
def time_series(spark, sf_dir):
    return E.time_series(fixture(spark, sf_dir, "events"), "ts", ["value"], "day")


@register("time_series_text", with_fixtures("""
    SELECT CAST(date_trunc('day', try_cast(day_dirty AS TIMESTAMP)) AS DATE) AS bucket, count(*) AS n,
           round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value
    FROM ev_datestr WHERE try_cast(day_dirty AS TIMESTAMP) IS NOT NULL GROUP BY 1""", "ev_datestr"), "E8")
def time_series_text(spark, sf_dir):
    return E.time_series(fixture(spark, sf_dir, "ev_datestr"), "day_dirty", ["value"], "day")


QQ_POINTS = 101


def _qq_sql(cols, source, points):
    probs = E.filliben_grid(points)
    nd = NormalDist()
    plist = "[" + ", ".join(repr(p) for p in probs) + "]"
    tlist = "[" + ", ".join(repr(nd.inv_cdf(p)) for p in probs) + "]"
    parts = [f"""SELECT '{c}' AS "column", unnest({plist}) AS prob, unnest({tlist}) AS theoretical,
                        unnest(quantile_cont({c}, {plist})) AS sample FROM {source} HAVING count({c}) >= 3""" for c in cols]
    return union_all(parts)


@register("qq_points", with_fixtures(f"""
    SELECT "column", round(prob, 8) AS prob, round(theoretical, 6) AS theoretical, round(sample, 6) AS sample
    FROM ({_qq_sql(LI_NUM, 'li_num', QQ_POINTS)}) t""", "li_num"), "E9")
def qq_points(spark, sf_dir):
    return E.qq_points(fixture(spark, sf_dir, "li_num"), LI_NUM, QQ_POINTS)[0]


@register("qq_fit", with_fixtures(f"""
    SELECT "column", round(regr_slope(sample, theoretical), 6) AS slope, round(regr_intercept(sample, theoretical), 6) AS intercept,
           round(covar_pop(sample, theoretical) / nullif(stddev_pop(sample) * stddev_pop(theoretical), 0), 6) AS r
    FROM ({_qq_sql(LI_NUM, 'li_num', QQ_POINTS)}) t GROUP BY "column" """, "li_num"), "E9")
def qq_fit(spark, sf_dir):
    return E.qq_points(fixture(spark, sf_dir, "li_num"), LI_NUM, QQ_POINTS)[1]


KDE_COLS = LI_NUM
KDE_GRID = 100


def _kde_sql(cols, source, grid):
    parts = []
    for c in cols:
        parts.append(f"""
        SELECT '{c}' AS "column", gi, st.g0 + gi * st.gstep AS g, st.n, st.h,
               sum(v.cnt * exp(-0.5 * ((st.g0 + gi * st.gstep - v.x) / st.h) * ((st.g0 + gi * st.gstep - v.x) / st.h))) AS s
        FROM (SELECT CAST({c} AS DOUBLE) AS x, count(*) AS cnt FROM {source} WHERE {c} IS NOT NULL GROUP BY 1) v,
             (SELECT count({c}) AS n, stddev_samp({c}) * pow(count({c}), -0.2) AS h,
                     min({c}) - 0.5 * (max({c}) - min({c})) AS g0, 2.0 * (max({c}) - min({c})) / {grid - 1} AS gstep
              FROM {source}) st,
             range(0, {grid}) r(gi)
        WHERE st.n >= 6
        GROUP BY gi, st.g0, st.gstep, st.n, st.h""")
    return f"""SELECT "column", CAST(gi AS INTEGER) AS gi, round(g, 6) AS grid,
                      round(s / (n * h * sqrt(2 * pi())), 9) AS density FROM ({union_all(parts)}) t WHERE h > 0"""


@register("kde_curve", with_fixtures(_kde_sql(KDE_COLS, "li_num", KDE_GRID), "li_num"), "E10", "E4")
def kde_curve(spark, sf_dir):
    return E.kde_curve(fixture(spark, sf_dir, "li_num"), KDE_COLS, KDE_GRID)


def _bivar_sql(cols, source, bins=20):
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    parts = []
    for a, b in pairs:
        bx = f"CAST(coalesce(least(floor((x - x0) / nullif(x1 - x0, 0) * {bins}), {bins - 1}), 0) AS INTEGER)"
        by = f"CAST(coalesce(least(floor((y - y0) / nullif(y1 - y0, 0) * {bins}), {bins - 1}), 0) AS INTEGER)"
        parts.append(f"""
        SELECT '{a}' AS col_x, '{b}' AS col_y, {bx} AS bx, {by} AS by, CAST(count(*) AS BIGINT) AS cnt
        FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) v,
             (SELECT min(CAST({a} AS DOUBLE)) AS x0, max(CAST({a} AS DOUBLE)) AS x1, min(CAST({b} AS DOUBLE)) AS y0,
                     max(CAST({b} AS DOUBLE)) AS y1, count(*) AS n
              FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) r
        WHERE n >= 5 GROUP BY 3, 4""")
    return union_all(parts)


BIVAR_COLS = LI_NUM


@register("bivariate_density", with_fixtures(_bivar_sql(BIVAR_COLS, "li_num"), "li_num"), "E17")
def bivariate_density(spark, sf_dir):
    return E.bivariate_density(fixture(spark, sf_dir, "li_num"), BIVAR_COLS)


SURFACE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _surface_sql(cols, source, bins=20):
    """Kernel sums over all occupied cells, straight from the definition."""
    h = "greatest(pow(n, -1.0 / 6) * sqrt(greatest((s2 - n * (s1 / n) * (s1 / n)) / (n - 1), 0)), 0.5)"
    k = "exp(-0.5 * ((g - {u}) / {h}) * ((g - {u}) / {h})) / ({h} * sqrt(2 * pi()))"
    return f"""
    WITH c AS ({_bivar_sql(cols, source, bins)}),
         m AS (SELECT col_x, col_y, CAST(sum(cnt) AS DOUBLE) AS n, sum(bx * cnt) AS x1, sum(bx * bx * cnt) AS x2,
                      sum("by" * cnt) AS y1, sum("by" * "by" * cnt) AS y2 FROM c GROUP BY 1, 2),
         b AS (SELECT col_x, col_y, n, {h.replace('s2', 'x2').replace('s1', 'x1')} AS hx, {h.replace('s2', 'y2').replace('s1', 'y1')} AS hy FROM m),
         g AS (SELECT unnest(range({bins})) AS g),
         d AS (SELECT c.col_x, c.col_y, gx.g AS bx, gy.g AS "by",
                      sum(cnt / n * {k.format(u='bx', h='hx').replace('(g -', '(gx.g -')} * {k.format(u='"by"', h='hy').replace('(g -', '(gy.g -')}) AS density
               FROM c JOIN b ON c.col_x = b.col_x AND c.col_y = b.col_y, g gx, g gy GROUP BY 1, 2, 3, 4)
    SELECT col_x, col_y, CAST(bx AS INTEGER) AS bx, CAST("by" AS INTEGER) AS "by", round(density, 9) AS density,
           CAST(least(floor(round(density / max(density) OVER (PARTITION BY col_x, col_y), 6) * 10), 9) AS INTEGER) AS level FROM d"""


@register("density_surface", with_fixtures(_surface_sql(SURFACE_COLS, "li_num"), "li_num"), "E17")
def density_surface(spark, sf_dir):
    return E.density_surface(fixture(spark, sf_dir, "li_num"), SURFACE_COLS)


@register("ecdf", with_fixtures(union_all([f"""
    SELECT '{c}' AS "column", x, CAST(cnt AS BIGINT) AS cnt,
           round(sum(cnt) OVER (ORDER BY x) * 1.0 / sum(cnt) OVER (), 9) AS ecdf
    FROM (SELECT CAST({c} AS DOUBLE) AS x, count(*) AS cnt FROM li_num WHERE {c} IS NOT NULL GROUP BY 1) v""" for c in LI_NUM]),
    "li_num"), "E18")
def ecdf(spark, sf_dir):
    return E.ecdf(fixture(spark, sf_dir, "li_num"), LI_NUM)


# ------------------------------------------------------------------ E14, E21, E26

@register("pca_summary", None, "E14")
def pca_summary(spark, sf_dir):
    return E.pca_summary(fixture(spark, sf_dir, "li_num"), MEASURES)[0]


@register("missing_by_quartile", with_fixtures("""
    WITH e AS (SELECT quantile_cont(l_orderkey, 0.25) AS e1, quantile_cont(l_orderkey, 0.5) AS e2,
                      quantile_cont(l_orderkey, 0.75) AS e3, quantile_cont(l_orderkey, 0.5) AS med FROM li_nulls),
         r AS (SELECT coalesce(CAST(l_orderkey AS DOUBLE), med) AS x, e1, e2, e3, """
    + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in LI_NULLS_COLS) + """ AS m FROM li_nulls, e)
    SELECT concat('Q', CAST(CASE WHEN x <= e1 THEN 1 WHEN x <= e2 THEN 2 WHEN x <= e3 THEN 3 ELSE 4 END AS VARCHAR)) AS quartile,
           CAST(count(*) AS BIGINT) AS n, round(avg(m), 6) AS avg_missing FROM r GROUP BY 1""", "li_nulls"), "E21")
def missing_by_quartile(spark, sf_dir):
    return E.missing_by_quartile(fixture(spark, sf_dir, "li_nulls"), "l_orderkey")


def _eda_summary_sql():
    from tablelab.plans.q_profile import LI_NULLS_CAT, _issues_sql
    iss = _issues_sql("li_nulls", LI_NULLS_COLS, LI_NULLS_CAT)
    return with_fixtures(f"""
        SELECT (SELECT count(*) FROM li_nulls) AS n_rows, 11 AS n_cols, 8 AS n_numeric, 2 AS n_categorical,
               1 AS n_datetime, CAST(greatest(0, 100 - 8 * count(*)) AS INTEGER) AS health_score,
               CASE WHEN greatest(0, 100 - 8 * count(*)) >= 80 THEN 'Excellent' WHEN greatest(0, 100 - 8 * count(*)) >= 60
                    THEN 'Good' WHEN greatest(0, 100 - 8 * count(*)) >= 40 THEN 'Fair' ELSE 'Critical' END AS health_label
        FROM ({iss}) i""", "li_nulls")


@register("eda_summary", _eda_summary_sql(), "E26")
def eda_summary(spark, sf_dir):
    return E.eda_summary(fixture(spark, sf_dir, "li_nulls"))



@register("history_append", _eda_summary_sql().replace("SELECT (SELECT count(*) FROM li_nulls)", "SELECT r.run_id, (SELECT count(*) FROM li_nulls)")
          .replace(") i", ") i, (SELECT unnest(['first', 'second']) AS run_id) r GROUP BY r.run_id") , "E26", "M33")
def history_append(spark, sf_dir):
    """Two runs appended to the history, the first given twice: one entry each."""
    summary = E.eda_summary(fixture(spark, sf_dir, "li_nulls"))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    for run_id in ("first", "second", "first"):
        ledger.append(summary, root, run_id)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in summary.schema)
    return ledger.read(spark, root, fields)
