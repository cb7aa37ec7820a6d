"""Linear models from shared sums against the plain pipeline."""

import math
import random

import pytest
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from tablelab.operators import least_squares as LS
from tablelab.operators import ml as ML


def table(spark, n=240):
    rnd = random.Random(3)
    rows = [(i, None if i % 7 == 0 else rnd.random() * 10, math.nan if i % 5 == 0 else 50 + rnd.gauss(0, 3), 4.0) for i in range(n)]
    return spark.createDataFrame([(*r, 3 * (r[1] or 2.0) + rnd.gauss(0, 1) + 100) for r in rows],
                                 "k long, a double, b double, c double, y double")


def test_linear_models_of_all_folds_share_the_scans(spark, monkeypatch):
    sizes, fit = [], R.LinearRegression._fit
    monkeypatch.setattr(R.LinearRegression, "_fit", lambda self, data: (sizes.append(data.count()), fit(self, data))[1])
    r = ML.train_models(table(spark), "y", ["k"], ["a", "b", "c"], "regression", "linear", 0.2, 3)
    assert len(sizes) == 4 * 4 and max(sizes) <= 2 * 4
    assert r.cv.count() == 4 * 3 and set(r.models) == set(r.test_predictions) == {x["model"] for x in r.scores.collect()}


@pytest.mark.parametrize("scaled", [True, False])
@pytest.mark.parametrize("penalty", [{}, {"regParam": 0.1, "elasticNetParam": 0.5, "standardization": False}])
def test_models_and_folds_equal_the_plain_pipeline(spark, scaled, penalty):
    cols = ["__f_a", "__f_b", "__f_c"]
    rows = ML.with_feature_inputs(table(spark), ["a", "b", "c"]).withColumn("label", F.col("y")).withColumn(
        "fold", (F.col("k") % 3).cast("int")).cache()
    est = R.LinearRegression(**penalty)
    model, scores = LS.fit_all(rows, cols, {"m": (est, scaled)}, 3)["m"]
    plain = ML.feature_pipeline(["a", "b", "c"], est, scaled)
    whole = plain.fit(rows).stages[-1]
    assert model.coefficients.toArray() == pytest.approx(whole.coefficients.toArray(), abs=1e-4)
    assert model.intercept == pytest.approx(whole.intercept, abs=1e-3)
    for f in range(3):
        held = plain.fit(rows.where(F.col("fold") != f)).transform(rows.where(F.col("fold") == f))
        assert scores[f] == pytest.approx(ML.MT.regression_metrics(held, "label", "prediction", 12).first()["r2"], abs=1e-6)


def test_rows_without_sums_are_left_to_the_plain_pipeline(spark):
    rows = table(spark).select("k", (F.col("a") * math.inf).alias("__f_a"), F.col("y").alias("label"), F.lit(0).alias("fold"))
    est = {"m": (R.LinearRegression(), True)}
    assert LS.fit_all(rows, ["__f_a"], est, 2) == {}
    assert LS.fit_all(rows.withColumn("__f_a", F.lit(None).cast("double")), ["__f_a"], est, 2) == {}
    assert LS.fit_all(rows.withColumn("__f_a", F.lit(1.0)), ["__f_a"], est, 2) == {}   # a fold without training rows


def counted(spark, column):
    """The column through a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(v):
        calls.add(1)
        return v

    return calls, F.udf(same, "double")(column)


def test_multiclass_auc_makes_its_scores_once(spark):
    df = spark.createDataFrame([(float(i % 3), (i * 7 % 11) / 11, (i * 5 % 13) / 13) for i in range(60)], "y double, a double, b double")
    calls, a = counted(spark, F.col("a"))
    want = [ML.MT.roc_auc(df, "y", c, cls, 12).first() for cls, c in ((0.0, "a"), (1.0, "b"))]
    got = ML.MT.roc_auc_ovr(df.withColumn("a", a), "y", {0.0: "a", 1.0: "b"}, 12).first()["roc_auc"]
    assert got == pytest.approx(sum(w["roc_auc"] * w["n_pos"] for w in want) / sum(w["n_pos"] for w in want), abs=1e-11)
    assert calls.value == 60


def test_split_counts_its_keys_once(spark):
    df = spark.range(200).withColumn("y", F.lit(1.0))
    calls, key = counted(spark, F.col("id").cast("double"))
    out = ML.train_test_split(df.withColumn("k", key), ["k"])
    assert out.where("is_test").count() == 40
    assert calls.value == 400   # once for the counts, once for the rows
