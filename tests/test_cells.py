"""Spark's trees on weighted cells: the same trees as on single rows, from far fewer rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablelab.operators import cells as CE
from tablelab.operators import grown_trees as GT
from tablelab.operators import ml as ML
from tablelab.operators import stages as ST


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(2)
    a, b = rng.randint(0, 12, 4000), rng.randint(0, 9, 4000)
    y = (a > 4) * 5.0 + (b > 3) * (a < 8) * 3.0 + rng.randint(0, 4, 4000)
    df = spark.createDataFrame([(float(i), float(j), float(v), float(v > 4)) for i, j, v in zip(a, b, y)], "a double, b double, y double, c double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).repartition(4).cache()


LEARNERS = {   # made in the test, as they need a session
    "tree": (lambda: R.DecisionTreeRegressor(maxDepth=12, seed=1), 0, "y"),
    "classes": (lambda: C.DecisionTreeClassifier(maxDepth=6, seed=1), 2, "c"),
    "boosted classes": (lambda: C.GBTClassifier(maxIter=4, maxDepth=3, seed=1), 2, "c"),
    "boosted": (lambda: R.GBTRegressor(maxIter=4, maxDepth=3, seed=1), 0, "y"),
    "AdaBoost": (lambda: ST.AdaBoost("classification", 6, n_classes=2), 2, "c")}


@pytest.mark.parametrize("name", LEARNERS)
def test_trees_of_weighted_cells_are_those_of_single_rows(rows, monkeypatch, tmp_path, name):
    make, classes, label = LEARNERS[name]
    learner = make()
    data = rows.select("features", F.col(label).alias("label"))
    plain = learner.fit(data).transform(data).select("features", "prediction")
    assert type(CE.CellTrees(learner, classes).fit(data)) is not CE.CellStage       # few rows: row by row
    monkeypatch.setattr(CE, "PLAIN_ROWS", 100)
    read = []
    real = CE.grouped
    monkeypatch.setattr(CE, "grouped", lambda *a: (read.append(real(*a)), read[-1])[1])
    model = CE.CellTrees(learner, classes).fit(data)
    assert read[0].count() <= 12 * 9 * 2 and read[0].agg(F.sum(CE.WEIGHT)).first()[0] == 4000
    got = model.transform(data)
    assert set(data.columns) < set(got.columns) and "__plain" not in got.columns
    a = sorted((tuple(r[0]), r[1]) for r in got.select("features", "prediction").collect())
    b = sorted((tuple(r[0]), r[1]) for r in plain.collect())
    assert np.allclose([x[1] for x in a], [x[1] for x in b]) and [x[0] for x in a] == [x[0] for x in b]
    PipelineModel([model]).save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(data)
    assert again.select("features", "prediction").exceptAll(got.select("features", "prediction")).count() == 0


def test_values_take_the_upper_edge_of_their_cell(spark, monkeypatch):
    grid = [np.array([1.0, 2.0, 5.0]), np.array([0.0])]
    x = np.array([[0.5, 3], [1, -1], [1.5, 0], [9, 9]])
    assert CE.edges_of(CE.codes(x, grid), grid).tolist() == [[1, 0], [1, 0], [2, 0], [5, 0]]
    rng = np.random.RandomState(0)
    df = spark.createDataFrame([(float(v), float(v > 0)) for v in rng.randn(3000)], "a double, label double")
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    monkeypatch.setattr(CE, "GRID", 50)
    grid = CE.fit_grid(df, 3000)
    counts = CE.grouped(df, grid, False)
    assert len(grid[0]) == 50 and counts.count() == 50 and 20 < counts.agg(F.min(CE.WEIGHT), F.max(CE.WEIGHT)).first()[1] < 120


def test_fewest_rows_of_a_leaf_count_rows_not_cells(rows, monkeypatch):
    monkeypatch.setattr(CE, "PLAIN_ROWS", 100)
    data = rows.select("features", F.col("y").alias("label"))
    learner = R.DecisionTreeRegressor(maxDepth=12, seed=1, minInstancesPerNode=600)
    plain, model = learner.fit(data), CE.CellTrees(learner, 0).fit(data)
    assert model.model.numNodes == plain.numNodes > 1
    assert np.allclose(model.featureImportances.toArray(), plain.featureImportances.toArray())


def test_large_tables_of_alike_rows_are_grouped_and_subsampled_learners_are_not(spark):
    assert isinstance(ML.regressors({}, 10, 2)["Decision Tree"], CE.CellTrees)
    two = ML.classifiers({}, 10, 2, 2)
    assert isinstance(two["Gradient Boosting"], CE.CellTrees) and isinstance(two["AdaBoost"], CE.CellTrees)
    assert isinstance(two["XGBoost"], C.GBTClassifier) and isinstance(ML.classifiers({}, 10, 3, 2)["CatBoost"], C.OneVsRest)


@pytest.mark.parametrize("classes, label", [(0, "y"), (2, "c")])
def test_extra_trees_of_weighted_cells_are_those_of_single_rows(rows, monkeypatch, tmp_path, classes, label):
    data = rows.select("features", F.col(label).alias("label"))
    learner = GT.ExtraTrees(classes, 8, 5, 2, 3, 2)
    plain = learner.fit(data)
    monkeypatch.setattr(CE, "PLAIN_ROWS", 100)
    passes, real = [], GT.one_pass
    monkeypatch.setattr(GT, "one_pass", lambda blocks, *a, **k: (passes.append(blocks.agg(F.sum("n")).first()[0]), real(blocks, *a, **k))[1])
    model = learner.fit(data)
    assert max(passes) <= 12 * 9 * 2                  # a pass reads cells, not 4,000 rows
    for t, p in zip(model.model.trees, plain.trees):
        assert [x.split(" value")[0] for x in t.toDebugString.split("\n")] == [x.split(" value")[0] for x in p.toDebugString.split("\n")]
    a, b = (sorted((tuple(r[0]), r[1]) for r in m.transform(data).select("features", "prediction").collect()) for m in (model, plain))
    assert np.allclose([x[1] for x in a], [x[1] for x in b])
    PipelineModel([model]).save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(data)
    assert np.allclose([x[1] for x in a], [x[1] for x in sorted((tuple(r[0]), r[1]) for r in again.select("features", "prediction").collect())])
