"""Scoring with saved pipelines (D1-D6); streaming scoring (D7) lives in
:mod:`tablelab.streaming.scoring`."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelab.functions.stats import q


def resolve_model(registry: DataFrame, which: str = "best", metric: str = "main_metric") -> dict:
    """A registry row by name, or the best one by its main metric (the
    registry holds one row per saved model)."""
    if which != "best":
        rows = registry.where(F.col("name") == which).collect()
        if not rows:
            raise KeyError(f"no model named {which!r}")
        return rows[0].asDict()
    w = Window.orderBy(F.col(metric).desc_nulls_last(), "name")
    return registry.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").first().asDict()


def align_features(df: DataFrame, features: list[str], keep: list[str] | None = None, fill_null: bool = True) -> DataFrame:
    """Exactly the training features in training order; missing columns
    become 0, extra columns are dropped, nulls become 0 (batch scoring)."""
    cols = []
    for c in features:
        x = q(c).cast("double") if c in df.columns else F.lit(0.0)
        cols.append((F.coalesce(x, F.lit(0.0)) if fill_null else x).alias(f"__f_{c}"))
    return df.select(*[q(k) for k in (keep or [])], *cols)


def predict(model: PipelineModel, aligned: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """D3 + D4: transform; classification adds the class label and the
    confidence (largest class probability, 4 dp)."""
    out = model.transform(aligned)
    if "probability" in out.columns:
        out = out.withColumn("confidence", F.round(F.array_max(vector_to_array("probability")), 4))
        if classes:
            m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(float(i)), F.lit(c))])
            out = out.withColumn("predicted_class", F.element_at(m, F.col("prediction")))
    return out


def score_batch(model: PipelineModel, df: DataFrame, features: list[str], key: list[str],
                classes: list[str] | None = None, first: int = 100) -> tuple[DataFrame, DataFrame]:
    """(first ``first`` predictions by key, total count frame)."""
    scored = predict(model, align_features(df, features, key), classes)
    cols = [*key, "prediction"] + (["confidence"] if "confidence" in scored.columns else []) + (
        ["predicted_class"] if "predicted_class" in scored.columns else [])
    head = scored.select(*cols).orderBy(*[q(k) for k in key]).limit(first)
    total = scored.agg(F.count(F.lit(1)).alias("total_predictions"))
    return head, total
