"""Trees grown from aggregates: extra trees and leaf-wise boosting."""

from __future__ import annotations

import heapq

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tablelab.operators import grown_trees as GT
from tablelab.operators import ml as ML


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.RandomState(3)
    a, b, c = rng.random_sample((3, 900)).round(3)
    y = np.where(a > 0.6, 5 + b, np.where(b > 0.3, c, -4.0)) + rng.normal(0, 0.05, 900)
    k = np.where(a > 0.6, "x", np.where(b > 0.3, "y", "z"))
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), float(y[i]), str(k[i])) for i in range(900)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k string").repartition(5).cache()


def vectors(table, label="y"):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(table).withColumnRenamed(label, "label")


def matrix(table):
    rows = sorted(table.collect(), key=lambda r: r["id"])
    return np.array([[r["a"], r["b"], r["c"]] for r in rows]), np.array([r["y"] for r in rows])


def test_extra_trees_draw_their_cuts_per_node_and_tree(table):
    model = GT.ExtraTrees(0, 6, 6, 2, 1, 3).fit(vectors(table))
    t = model.rounds[0]
    inner = t.feature >= 0
    assert len(set(t.cut[inner].tolist())) == inner.sum() > 100   # no cut is shared
    x, y = matrix(table)
    for root in range(6):   # every cut lies inside the range of its node's rows, leaves hold the mean of theirs
        at, nodes = t.walk(x, root), {root: np.arange(len(x))}
        for k in sorted(range(len(t.feature))):
            if k in nodes and t.feature[k] >= 0:
                rows = nodes[k]
                v = x[rows, t.feature[k]]
                assert v.min() <= t.cut[k] < v.max()
                nodes[int(t.left[k])], nodes[int(t.left[k]) + 1] = rows[v <= t.cut[k]], rows[v > t.cut[k]]
        for k in set(at.tolist()):
            assert sorted(nodes[k]) == np.flatnonzero(at == k).tolist()
            assert t.value[k, 0] == pytest.approx(y[at == k].mean(), abs=1e-9)
    again = GT.ExtraTrees(0, 6, 6, 2, 1, 3).fit(vectors(table.coalesce(1))).rounds[0]   # whatever the partitions
    assert again.feature.tolist() == t.feature.tolist() and np.allclose(again.cut, t.cut)


def test_extra_trees_limits(table, monkeypatch):
    t = GT.ExtraTrees(0, 3, 30, 2, 40, 3).fit(vectors(table)).rounds[0]
    x, _ = matrix(table)
    assert min(np.bincount(t.walk(x, r), minlength=3)[np.unique(t.walk(x, r))].min() for r in range(3)) >= 40
    whole = GT.ExtraTrees(0, 3, 5, 2, 1, 2).fit(vectors(table)).rounds[0]
    assert whole.feature.size <= 3 * 63
    monkeypatch.setattr(GT, "MAX_NODES", 21)
    assert GT.ExtraTrees(0, 3, 30, 2, 1, 3).fit(vectors(table)).rounds[0].feature.size <= 21


def test_passes_of_few_numbers_grow_as_good_trees(table, monkeypatch):
    monkeypatch.setattr(GT, "PASS_NUMBERS", 100)
    model = GT.ExtraTrees(0, 5, 5, 2, 1, 3).fit(vectors(table))
    got = model.transform(vectors(table)).select("label", "prediction").toPandas()
    assert 1 - ((got.label - got.prediction) ** 2).mean() / got.label.var() > 0.85


def leaf_wise(codes, g, h, num_leaves, rate):
    """One tree, a leaf at a time: leaf value by row, and leaves."""
    def best(rows):
        top = (0.0, 0, 0)
        for f in range(codes.shape[1]):
            for b in range(int(codes[rows, f].max(initial=0))):
                left = codes[rows, f] <= b
                parts = [rows[left], rows[~left]]
                if min(len(p) for p in parts) < GT.MIN_CHILD_ROWS or min(h[p].sum() for p in parts) < GT.MIN_CHILD_CURVATURE:
                    continue
                gain = sum(g[p].sum() ** 2 / h[p].sum() for p in parts) - g[rows].sum() ** 2 / h[rows].sum()
                if gain > top[0] + 1e-9:
                    top = (gain, f, b)
        return top
    n, number = len(g), 0
    heap = [(-best(np.arange(n))[0], 0, np.arange(n))]
    leaves = []
    while heap and len(heap) + len(leaves) < num_leaves:
        gain, _, rows = heapq.heappop(heap)
        if gain == 0:
            leaves.append(rows)
            continue
        _, f, b = best(rows)
        for part in (rows[codes[rows, f] <= b], rows[codes[rows, f] > b]):
            number += 1
            heapq.heappush(heap, (-best(part)[0], number, part))
    leaves += [r for _, _, r in heap]
    out = np.zeros(n)
    for rows in leaves:
        out[rows] = -rate * g[rows].sum() / h[rows].sum()
    return out, len(leaves)


def test_leaf_wise_rounds_equal_splitting_leaf_by_leaf(table):
    x, y = matrix(table)
    model = GT.LeafWiseBoosting(0, 12, 0.3, 7).fit(vectors(table))   # 12: scores are written once on the way
    codes = GT._coder([np.array(e) for e in model.options["edges"]])(x)
    s = np.full(len(y), y.mean())
    for t in model.rounds:
        step, leaves = leaf_wise(codes, s - y, np.ones(len(y)), 7, 0.3)
        assert (t.feature < 0).sum() == leaves == 7
        assert np.allclose(t.total(codes, 1)[:, 0], step, atol=1e-8)
        s = s + step
    got = {r["id"]: r["prediction"] for r in model.transform(vectors(table)).collect()}
    assert np.allclose([got[i] for i in range(len(y))], s, atol=1e-8)
    assert model.options["passes"] < 12 * 6   # a leaf at a time would take six more passes a round


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosting_passes_read_a_weighted_row_per_cell(spark, monkeypatch, classes):
    """rows of equal bins (and class) are one row of a pass, and trees are those of all rows."""
    rng = np.random.RandomState(5)
    x = np.stack([rng.randint(0, 9, 4000), rng.randint(0, 6, 4000)], 1)
    y = (x[:, 0] + rng.randint(0, 5, 4000)) % classes if classes else x[:, 0] * x[:, 1] + rng.randint(0, 8, 4000) / 4
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(
        [(float(a), float(b), float(v)) for (a, b), v in zip(x, y)], "a double, b double, label double").repartition(3))
    read, plain = [], GT.grow_round

    def spied(blocks, *args):
        read.append(blocks.agg(F.sum("n")).first()[0])
        return plain(blocks, *args)

    monkeypatch.setattr(GT, "grow_round", spied)
    model = GT.LeafWiseBoosting(classes, 2, 0.3, 6).fit(df)
    assert max(read) <= 9 * 6 * max(1, classes)
    codes = GT._coder([np.array(e) for e in model.options["edges"]])(x.astype(float))
    s = np.tile(np.array(model.options["start"]), (4000, 1))
    for t in model.rounds:
        g, h = GT.gradients(s, y, classes)
        for o in range(s.shape[1]):
            step, _ = leaf_wise(codes, g[:, o], h[:, o], 6, 0.3)
            assert np.allclose(t.value[t.walk(codes, o), o], step, atol=1e-8)
        s = GT.scores(codes, s, [t])


@pytest.mark.parametrize("key, problem, target", [("extra_trees", "classification", "k"), ("extra_trees", "regression", "y"),
                                                   ("lightgbm", "classification", "k"), ("lightgbm", "regression", "y")])
def test_models_by_key_learn_and_are_saved(table, tmp_path, key, problem, target):
    r = ML.train_models(table, target, ["id"], ["a", "b", "c"], problem, key, 0.2, 2, hp={"n_estimators": 8, "max_depth": 6, "lgb_learning_rate": 0.4, "lgb_num_leaves": 8})
    assert r.scores.first()["main_metric"] > 0.93
    name, model = next(iter(r.models.items()))
    assert ML.feature_importance(r).first()["feature"] in ("a", "b")
    model.write().overwrite().save(str(tmp_path / key))
    test = r.test_predictions[name].select("id", "__f_a", "__f_b", "__f_c")
    again = PipelineModel.load(str(tmp_path / key)).transform(test)
    assert sorted(again.select("id", "prediction").collect()) == sorted(model.transform(test).select("id", "prediction").collect())


def test_two_classes_and_constant_features(spark):
    rows = [(i, float(i % 9), 1.0, "ab"[i % 9 > 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, k string")
    for key in ("extra_trees", "lightgbm"):
        r = ML.train_models(df, "k", ["id"], ["a", "b"], "classification", key, 0.2, 2, hp={"n_estimators": 3, "lgb_num_leaves": 4})
        assert r.scores.first()["main_metric"] == 1.0
        p = next(iter(r.test_predictions.values())).select("probability").first()[0]
        assert sum(p) == pytest.approx(1)
    same = spark.createDataFrame([(float(i), 1.0) for i in range(50)], "id double, a double")
    from pyspark.ml.feature import VectorAssembler
    flat = VectorAssembler(inputCols=["a"], outputCol="features").transform(same).withColumnRenamed("id", "label")
    for est in (GT.ExtraTrees(0, 3, 5, 2, 1, 1), GT.LeafWiseBoosting(0, 3, 0.1, 7)):
        assert est.fit(flat).transform(flat).select("prediction").distinct().first()[0] == pytest.approx(24.5)


def test_extra_trees_pass_costs_a_tree_its_own_nodes_only(monkeypatch):
    """per tree and block, sums are as long as the tree's open nodes, not the forest's."""
    rng, trees = np.random.RandomState(0), 20
    forest, nodes = GT.Trees(trees, 1), np.arange(trees)
    for _ in range(4):
        at = forest.split(nodes, rng.randint(0, 3, len(nodes)), rng.random_sample(len(nodes)), *np.zeros((2, len(nodes), 1)))
        nodes = np.stack([at, at + 1], 1).ravel()
    x, y, lengths, plain = rng.random_sample((500, 3)), rng.random_sample(500), [], GT._label_sums

    def sums(classes, slots, label, n):
        lengths.append(n)
        return plain(classes, slots, label, n)

    def one_pass(blocks, size, put, kind=np.float64, merge=np.add, zero=0.0):
        total = np.full(size, zero)
        put(total, x, y, None)
        return total

    monkeypatch.setattr(GT, "_label_sums", sums)
    monkeypatch.setattr(GT, "one_pass", one_pass)
    tree = np.repeat(np.arange(trees), 16)
    at = np.concatenate([forest.walk(x, t) for t in range(trees)])
    number = np.full(len(forest.feature), -1)
    number[nodes] = np.arange(len(nodes))
    of = plain(0, number[at], np.tile(y, trees), len(nodes))
    new, _, split = GT._split_level(None, forest, nodes, tree, of, 3, 0, 1, 3, np.random.RandomState(1), np.zeros(3),
                                    lambda s: s[:, 1:2] / np.maximum(s[:, :1], 1))
    assert set(lengths) == {16}
    after = plain(0, np.concatenate([forest.walk(x, t) for t in range(trees)]), np.tile(y, trees), len(forest.feature))
    assert np.allclose(after[new], split)   # children hold the sums of the rows that walk to them
