"""Registered queries: report sections (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelab.operators import eda as E
from tablelab.operators import report as RP
from tablelab.plans.fixtures import fixture, with_fixtures
from tablelab.plans.q_profile import LI_NULLS_CAT, LI_NULLS_COLS, LI_NULLS_NUM, _issues_sql, _pii_sql
from tablelab.plans.registry import register, union_all

FILE = "lineitem.parquet"
RUN_AT = "2024-01-31 12:00:00"  # the queries pass a fixed time so that results repeat


def _summary_sql():
    iss = _issues_sql("li_nulls", LI_NULLS_COLS, LI_NULLS_CAT)
    miss = " + ".join(f"(count(*) - count({c}))" for c in LI_NULLS_COLS)
    return with_fixtures(f"""
        WITH s AS (SELECT count(*) AS n, {miss} AS missing FROM li_nulls),
             h AS (SELECT CAST(greatest(0, 100 - 8 * count(*)) AS INTEGER) AS sc FROM ({iss}) i),
             d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM li_nulls)) AS dup FROM li_nulls),
             l AS (SELECT [
                '# Profile of {FILE}', '| measure | value |', '|---|---|',
                '| rows | ' || CAST(n AS VARCHAR) || ' |', '| columns | {len(LI_NULLS_COLS)} |',
                '| numeric columns | {len(LI_NULLS_NUM)} |', '| categorical columns | {len(LI_NULLS_CAT)} |',
                '| empty cells | ' || CAST(missing AS VARCHAR) || ' |', '| repeated rows | ' || CAST(dup AS VARCHAR) || ' |',
                '| health | ' || CAST(sc AS VARCHAR) || ' of 100 (' ||
                    CASE WHEN sc >= 80 THEN 'Excellent' WHEN sc >= 60 THEN 'Good' WHEN sc >= 40 THEN 'Fair' ELSE 'Critical' END || ') |'] AS ls
               FROM s, h, d)
        SELECT 1 AS section, CAST(unnest(range(len(ls))) AS INTEGER) AS seq, unnest(ls) AS line FROM l""", "li_nulls")


@register("report_summary", _summary_sql(), "R1")
def report_summary(spark, sf_dir):
    return RP.summary_section(fixture(spark, sf_dir, "li_nulls"), FILE)


def _issues_lines_sql():
    iss = _issues_sql("li_nulls", LI_NULLS_COLS, LI_NULLS_CAT)
    pii = _pii_sql("li_nulls", LI_NULLS_COLS)
    return with_fixtures(f"""
        WITH i AS (SELECT coalesce(list(x ORDER BY x), []) AS i FROM (
                     SELECT '- ' || kind || ' ' || coalesce("column", '*') || ': ' || CAST(value AS VARCHAR) || ' (' || severity || ')' AS x
                     FROM ({iss}) t) a),
             p AS (SELECT coalesce(list(x ORDER BY x), []) AS p FROM (
                     SELECT '- ' || "column" || ': possible ' || upper(pii_type) AS x FROM ({pii}) t WHERE detected) b),
             l AS (SELECT list_concat(['# Findings'],
                          CASE WHEN len(i) > 0 THEN i ELSE ['- none'] END,
                          CASE WHEN len(p) > 0 THEN list_concat(['# Personal data'], p) ELSE [] END) AS ls FROM i, p)
        SELECT 2 AS section, CAST(unnest(range(len(ls))) AS INTEGER) AS seq, unnest(ls) AS line FROM l""", "li_nulls")


@register("report_issues", _issues_lines_sql(), "R2")
def report_issues(spark, sf_dir):
    return RP.issues_section(fixture(spark, sf_dir, "li_nulls"))


def _columns_sql():
    dtypes = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
              "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
              "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
    rows = []
    for i, c in enumerate(LI_NULLS_COLS):
        if c in LI_NULLS_NUM:
            summ = f"printf('mean=%.2f, std=%.2f', avg({c}), stddev_samp({c}))"
        elif c in LI_NULLS_CAT:
            summ = (f"'Top: ' || coalesce((SELECT CAST({c} AS VARCHAR) FROM li_nulls WHERE {c} IS NOT NULL GROUP BY 1 "
                    f"ORDER BY count(*) DESC, 1 LIMIT 1), 'N/A')")
        else:
            summ = "'Top: N/A'"
        rows.append(f"SELECT {i + 2} AS seq, printf('| %s | %s | %d | %d | %s |', '{c}', '{dtypes[c]}', "
                    f"count(*) - count({c}), count(DISTINCT {c}), {summ}) AS line FROM li_nulls")
    head = ("SELECT 0 AS seq, '# Columns' AS line UNION ALL SELECT 1, '| column | type | empty | distinct | center or most frequent |' "
            "UNION ALL SELECT 2, '|---|---|---|---|---|'")
    return with_fixtures(f"SELECT 3 AS section, CAST(seq AS INTEGER) AS seq, line FROM ({head} UNION ALL "
                         f"SELECT seq + 1, line FROM ({union_all(rows)}) r) x", "li_nulls")


@register("report_columns", _columns_sql(), "R3")
def report_columns(spark, sf_dir):
    return RP.columns_section(fixture(spark, sf_dir, "li_nulls"))


def _history(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_num")
    d = E.distribution_summary(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    ins = d.select(F.format_string("%s: mean=%.2f, std=%.2f, skew=%.2f (%s)", "column", "mean", "std", "skew",
                                   "skew_desc").alias("s"))
    out = E.outlier_share(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select(
        F.format_string("%s: %.2f%% outliers", "column", "outlier_pct").alias("s"))
    h1 = ins.agg(F.array_sort(F.collect_list("s")).alias("insights")).select(   # one line per column
        F.lit(1).alias("run"), F.lit(RUN_AT).cast("timestamp").alias("at"), F.lit("eda").alias("type"), F.size("insights").cast("long").alias("n_results"), "insights")
    h2 = out.agg(F.array_sort(F.collect_list("s")).alias("insights")).select(
        F.lit(2).alias("run"), F.lit(RUN_AT).cast("timestamp").alias("at"), F.lit("outliers").alias("type"), F.size("insights").cast("long").alias("n_results"), "insights")
    return h1.unionByName(h2)


HIST = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _history_sql():
    shares = union_all([f"""
        SELECT '{c}' AS c, count(x) AS n, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS o
        FROM (SELECT CAST({c} AS DOUBLE) AS x FROM li_num WHERE {c} IS NOT NULL) v,
             (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM li_num) qq""" for c in HIST])
    return with_fixtures(f"""
        WITH o AS (SELECT c || ': ' || printf('%.2f', o * 100.0 / n) || '% outliers' AS s FROM ({shares}) t WHERE n >= 4 AND o > 0),
             l AS (SELECT list_concat(['## Run 2 (outliers), {RUN_AT}', '- results: ' || CAST(count(*) AS VARCHAR)],
                          list_transform(coalesce(list(s ORDER BY s), [])[1:5], lambda x: '  - ' || x)) AS ls FROM o)
        SELECT 4 AS section, 0 AS seq, '# Runs' AS line
        UNION ALL SELECT 4, CAST(200 + 1 + unnest(range(len(ls))) AS INTEGER), unnest(ls) FROM l""", "li_num")


@register("report_history_outliers", _history_sql(), "R4")
def report_history_outliers(spark, sf_dir):
    return RP.history_section(_history(spark, sf_dir).where("run = 2"))


@register("report_history", None, "R4", "E26")
def report_history(spark, sf_dir):
    return RP.history_section(_history(spark, sf_dir))


@register("report_document", None, "R5", "R6", "S9")
def report_document(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_nulls")
    from tablelab.operators import ml as ML
    r = ML.train_models(fixture(spark, sf_dir, "li_ml"), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey",
                        "l_suppkey"], ["l_quantity", "l_extendedprice", "l_tax"], "auto", "naive_bayes", 0.2, 2)
    cv = ML.cv_summary(r.cv).select(F.col("model").alias("name"), F.col("mean").alias("cv_mean"), F.col("std").alias("cv_std"))
    reg = r.scores.select(F.col("model").alias("name"), F.lit(r.problem).alias("type"), F.lit("spark.ml").alias("framework"),
                          "scores").join(cv, "name", "left")
    doc = RP.assemble(RP.summary_section(df, FILE), RP.issues_section(df), RP.columns_section(df),
                      RP.history_section(_history(spark, sf_dir)), RP.models_section(reg),
                      RP.next_steps_section(df, registry=reg))
    return RP.to_markdown_lines(doc)
