"""Registered queries: clustering (C) and scoring (D)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablelab.operators import cluster as CL
from tablelab.operators import ml as ML
from tablelab.operators import score as SC
from tablelab.plans.fixtures import fixture, table, with_fixtures
from tablelab.plans.registry import register

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# FIXED VALUES: the deterministic stand-in centroids on (l_quantity, l_extendedprice).
CENTROIDS = [[10.0, 10000.0], [25.0, 35000.0], [45.0, 70000.0]]
CL_COLS = ["l_quantity", "l_extendedprice"]


def _assign_sql(src="lineitem"):
    ds = [" + ".join(f"({c} - {v!r}) * ({c} - {v!r})" for c, v in zip(CL_COLS, cen)) for cen in CENTROIDS]
    return f"""SELECT {', '.join(LI_KEY)}, {', '.join(CL_COLS)},
                      CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster
               FROM (SELECT *, {ds[0]} AS d0, {ds[1]} AS d1, {ds[2]} AS d2 FROM {src}) t"""


def _assigned(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*LI_KEY, *CL_COLS)
    return CL.assign_nearest(li, CL_COLS, CENTROIDS)


@register("cluster_assign_fixed", _assign_sql(), "C4")
def cluster_assign_fixed(spark, sf_dir):
    return _assigned(spark, sf_dir)


@register("cluster_profile", f"""
    SELECT cluster, round(avg(l_quantity), 2) AS l_quantity, round(avg(l_extendedprice), 2) AS l_extendedprice
    FROM ({_assign_sql()}) a GROUP BY cluster""", "C6")
def cluster_profile(spark, sf_dir):
    return CL.profile(_assigned(spark, sf_dir), CL_COLS)


@register("cluster_sizes", f"""
    SELECT cluster, CAST(count(*) AS BIGINT) AS size, round(count(*) * 1.0 / sum(count(*)) OVER (), 4) AS share
    FROM ({_assign_sql()}) a GROUP BY cluster""", "C7")
def cluster_sizes(spark, sf_dir):
    return CL.sizes(_assigned(spark, sf_dir))


@register("calinski_harabasz", f"""
    WITH a AS ({_assign_sql()}),
         m AS (SELECT cluster, count(*) AS nk, avg(l_quantity) AS m0, avg(l_extendedprice) AS m1 FROM a GROUP BY cluster),
         g AS (SELECT avg(l_quantity) AS g0, avg(l_extendedprice) AS g1 FROM a),
         w AS (SELECT sum((l_quantity - m0) * (l_quantity - m0) + (l_extendedprice - m1) * (l_extendedprice - m1)) AS ssw,
                      count(*) AS n FROM a JOIN m USING (cluster)),
         b AS (SELECT sum(nk * ((m0 - g0) * (m0 - g0) + (m1 - g1) * (m1 - g1))) AS ssb, count(*) AS k FROM m, g)
    SELECT CAST(k AS INTEGER) AS k, CAST(n AS BIGINT) AS n,
           round(CASE WHEN k > 1 THEN (ssb / (k - 1)) / (ssw / (n - k)) END, 2) AS calinski_harabasz
    FROM w, b""", "C8")
def calinski_harabasz(spark, sf_dir):
    return CL.calinski_harabasz(_assigned(spark, sf_dir), CL_COLS)


@register("cluster_sweep", None, "C1", "C2", "C3")
def cluster_sweep(spark, sf_dir):
    feat, _ = CL.prepare(fixture(spark, sf_dir, "li_num"), ["l_quantity", "l_extendedprice", "l_discount"])
    return CL.k_sweep(feat, 10)[0]


@register("cluster_projection", None, "C4", "C5", "C6", "C7")
def cluster_projection(spark, sf_dir):
    r = CL.run(fixture(spark, sf_dir, "li_num"), ["l_quantity", "l_extendedprice", "l_discount"], LI_KEY)
    return r.projection


# ------------------------------------------------------------------ scoring

ALIGN = ["l_quantity", "l_discount", "not_in_data"]


@register("align_features", with_fixtures(
    f"SELECT {', '.join(LI_KEY)}, coalesce(CAST(l_quantity AS DOUBLE), 0.0) AS __f_l_quantity, "
    "coalesce(CAST(l_discount AS DOUBLE), 0.0) AS __f_l_discount, 0.0 AS __f_not_in_data FROM li_nulls", "li_nulls"), "D2")
def align_features(spark, sf_dir):
    return SC.align_features(fixture(spark, sf_dir, "li_nulls"), ALIGN, LI_KEY)


def _quick_model(spark, sf_dir, target="l_returnflag", model_type="naive_bayes"):
    df = fixture(spark, sf_dir, "li_ml")
    r = ML.train_models(df, target, LI_KEY, ["l_quantity", "l_extendedprice", "l_tax"], "auto", model_type, 0.2, 2)
    return r


@register("batch_scoring", None, "D1", "D3", "D4", "D5", "D6", "S8", "M33")
def batch_scoring(spark, sf_dir):
    r = _quick_model(spark, sf_dir)
    root = ML.models_dir(spark)
    run_id = f"run-{uuid.uuid4().hex}"
    ML.register_run(r, root, run_id)
    reg = ML.registry(spark, root).where(F.col("run_id") == run_id).join(r.scores.select(F.col("model").alias("name"), "main_metric"), "name")
    row = SC.resolve_model(reg, "best")
    model = ML.load_model(row["path"])
    head, total = SC.score_batch(model, fixture(spark, sf_dir, "lineitem"), row["features"], LI_KEY, row["classes"], 100)
    return head.crossJoin(F.broadcast(total))   # one row: the number of all predictions


@register("stream_scoring", None, "D7")
def stream_scoring(spark, sf_dir):
    from tablelab.session import ensure_checkpoint_dir
    from tablelab.streaming.scoring import run_to_completion
    r = _quick_model(spark, sf_dir)
    model = r.models[r.best]
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"   # a run of its own
    li = table(spark, sf_dir, "lineitem")
    return run_to_completion(spark, model, sf_dir, li.schema, r.features, LI_KEY, sink_dir=f"{base}/out",
                             checkpoint_dir=f"{base}/ckpt", glob="lineitem.parquet", classes=r.classes)
