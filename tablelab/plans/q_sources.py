"""Registered queries: file sources and sinks (S)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablelab.plans.fixtures import fixture
from tablelab.plans.registry import register
from tablelab.session import ensure_checkpoint_dir
from tablelab.sources import io

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _scratch(spark, name):
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex}"


@register("source_csv_roundtrip", """
    SELECT count(*) AS n_rows, count(l_discount) AS n_discount, round(sum(l_quantity), 4) AS sum_qty,
           count(l_returnflag) AS n_flag FROM (
      SELECT l_orderkey, l_quantity, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
             CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem) t""",
          "S1", "S4", "S6", "S10")
def source_csv_roundtrip(spark, sf_dir):
    """Write the effective frame as CSV (nulls as empty fields), read it back
    with NA tokens and inferred types, and aggregate."""
    df = fixture(spark, sf_dir, "li_nulls").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
    io.snapshot(df, "tablelab_raw")
    df = spark.table("tablelab_raw")
    path = _scratch(spark, "csv") + "/data.csv"
    io.write_csv(io.effective_frame(df, None), path)
    back = io.load_table(spark, path)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.count("l_discount").alias("n_discount"),
                    F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.count("l_returnflag").alias("n_flag"))


@register("source_json_roundtrip", """
    SELECT count(*) AS n_rows, count(DISTINCT event_type) AS n_types, round(sum(value), 4) AS sum_value FROM events""",
          "S3", "S4")
def source_json_roundtrip(spark, sf_dir):
    """JSON lines written by Spark and read back (``.jsonl``: splittable)."""
    path = _scratch(spark, "json") + "/events.jsonl"
    fixture(spark, sf_dir, "events").write.mode("overwrite").json(path)
    back = io.load_table(spark, path)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_type").alias("n_types"),
                    F.round(F.sum("value"), 4).alias("sum_value"))


@register("source_rows_literal", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5""", "S5")
def source_rows_literal(spark, sf_dir):
    """A scoring request: five records (as dicts) turned back into a frame."""
    recs = [r.asDict() for r in fixture(spark, sf_dir, "lineitem").orderBy(*LI_KEY)
            .select("l_orderkey", "l_linenumber", "l_quantity", "l_discount").limit(5).collect()]
    return io.rows_frame(spark, recs, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double")


@register("export_report_text", None, "S9")
def export_report_text(spark, sf_dir):
    """Write the column profile as a text document and read the lines back."""
    from tablelab.operators import report as RP
    df = fixture(spark, sf_dir, "li_nulls")
    lines = RP.to_markdown_lines(RP.columns_section(df)).withColumnRenamed("n", "seq")
    path = _scratch(spark, "report") + "/report.md"
    io.write_text_lines(lines, path)
    return spark.read.text(path)



@register("export_csv", """
    SELECT count(*) AS n_rows, round(sum(l_discount), 4) AS sum_discount, count(l_discount) AS n_discount,
           round(sum(qty2), 4) AS sum_qty2 FROM (
      SELECT l_quantity * 2 AS qty2, coalesce(CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END, 0.0) AS l_discount FROM lineitem) t""",
          "S7", "S10")
def export_csv(spark, sf_dir):
    """The processed frame is exported where there is one, the raw one kept beside it."""
    raw = fixture(spark, sf_dir, "li_nulls").select("l_quantity", "l_discount")
    io.snapshot(raw, "tablelab_raw")
    processed = spark.table("tablelab_raw").select((F.col("l_quantity") * 2).alias("qty2"),
                                                   F.coalesce("l_discount", F.lit(0.0)).alias("l_discount"))
    path = _scratch(spark, "export") + "/processed.csv"
    io.write_csv(io.effective_frame(raw, processed), path)
    return io.load_table(spark, path).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_discount"), 4).alias("sum_discount"),
        F.count("l_discount").alias("n_discount"), F.round(F.sum("qty2"), 4).alias("sum_qty2"))
