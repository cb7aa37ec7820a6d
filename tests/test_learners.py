"""Learners of our own: kernel machines, neighbours, the network and k-means,
against closed forms, brute force and planted data."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablelab.operators import kernel as KM
from tablelab.operators import ml as ML


def vectors(spark, rows, names):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in (*names, "label")))
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df).select("features", "label")


# ------------------------------------------------------------------ kernel machines

def test_residuals_inside_the_tube_have_no_gradient():
    y = np.array([1.0, 2.0, 3.0, 4.0])
    value, slope = KM.tube(0.1, 0.05)(np.array([[1.0], [2.09], [2.95], [4.5]]), y)
    assert slope[:3].ravel().tolist() == [0, 0, 0] and slope[3, 0] == 1.0
    assert value == pytest.approx(0.4 - 0.025)


@pytest.mark.parametrize("loss", [KM.hinge, KM.tube(0.1, 0.2), KM.cross_entropy])
def test_gradients_match_differences(loss):
    rng = np.random.default_rng(0)
    s, y = rng.normal(size=(20, 1 if loss not in (KM.hinge, KM.cross_entropy) else 3)), rng.integers(0, 3, 20).astype(float)
    _, slope = loss(s, y)
    for i, j in ((0, 0), (7, s.shape[1] - 1), (19, 0)):
        d = np.zeros_like(s)
        d[i, j] = 1e-6
        assert slope[i, j] == pytest.approx((loss(s + d, y)[0] - loss(s - d, y)[0]) / 2e-6, abs=1e-4)


def test_kernel_map_reproduces_the_kernel_on_its_landmarks():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(30, 3))
    for kernel in ("rbf", "poly"):
        m = KM.KernelMap(kernel, 0.4, z)
        assert np.allclose(m(z) @ m(z).T, KM.kernel_values(z, z, kernel, 0.4), atol=1e-5)
    assert KM.gamma_value("scale", 4, 0.5) == 0.5 and KM.gamma_value("auto", 4, 9.0) == 0.25 and KM.gamma_value("0.3", 4, 1) == 0.3
    with pytest.raises(ValueError):
        KM.KernelMap("cosine", 1.0, z)


def test_svm_learns_rings_with_all_classes_in_one_solver(spark, tmp_path):
    rnd = random.Random(0)
    rows = []
    for _ in range(600):
        k, a = rnd.randrange(3), rnd.uniform(0, 2 * math.pi)
        r = 0.5 + k + rnd.uniform(-0.3, 0.3)
        rows.append((r * math.cos(a), r * math.sin(a), k))
    df = vectors(spark, rows, ("a", "b"))
    stage = KM.KernelSVM(3, c=10.0).fit(df)
    assert stage.w.shape[0] == 3
    out = stage.transform(df).select("label", "prediction", "probability").collect()
    assert sum(r.label == r.prediction for r in out) > 570
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in out)
    again = PipelineModel(stages=[stage])
    again.write().overwrite().save(str(tmp_path / "svm"))
    assert [r.prediction for r in PipelineModel.load(str(tmp_path / "svm")).transform(df).collect()] == [r.prediction for r in out]


def test_kernel_choice_and_gamma_reach_the_regression(spark):
    rows = [(x / 20, math.sin(x / 10)) for x in range(-60, 61)]
    df = vectors(spark, rows, ("x",))
    left = {}
    for kernel, gamma in (("rbf", "scale"), ("rbf", 0.0001), ("linear", "auto"), ("poly", "auto"), ("sigmoid", 0.5)):
        out = KM.KernelSVR(c=100.0, kernel=kernel, gamma=gamma).fit(df).transform(df).collect()
        left[kernel, gamma] = max(abs(r.label - r.prediction) for r in out)
    assert left["rbf", "scale"] < 0.2 < min(v for k, v in left.items() if k not in (("rbf", "scale"), ("sigmoid", 0.5), ("poly", "auto")))


# ------------------------------------------------------------------ nearest neighbours

def brute_nearest(queries, data, k, p):
    out = []
    for g, qid, v in queries:
        near = sorted((sum(abs(a - b) ** p for a, b in zip(v, w)), t, i) for h, i, t, w in data if h == g)[:k]
        out += [(qid, i, r + 1) for r, (_, _, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_nearest_matches_brute_force_with_hot_values(spark, metric, monkeypatch):
    from tablelab.operators import neighbours as NB
    monkeypatch.setattr(NB, "SLICE_ROWS", 20)
    monkeypatch.setattr(NB, "BLOCK_QUERIES", 7)
    rnd = random.Random(3)
    point = lambda n: [1.0] * n if rnd.random() < 0.35 else [float(rnd.randrange(-20, 20)) for _ in range(n)]
    data = [(g, 1000 * g + i, float(rnd.randrange(3)), point(2 + g)) for g in (0, 1, 3) for i in range(200 if g < 3 else 2)]
    asked = [(g, 100 * g + i, point(2 + g)) for g in (0, 1, 2, 3) for i in range(40)]
    d = spark.createDataFrame(data, "g int, id long, t double, v array<double>")
    a = spark.createDataFrame(asked, "g int, q long, v array<double>")
    got = sorted(tuple(r) for r in NB.nearest(a, d, 4, metric).select("q", "id", "rank").collect())
    assert got == brute_nearest(asked, data, 4, NB.METRICS[metric])
    assert NB.nearest(a, d.limit(0), 4).count() == 0 and NB.nearest(a.limit(0), d, 4).count() == 0


def test_nearest_joins_reachable_cells_only(spark, monkeypatch):
    from tablelab.operators import neighbours as NB
    rng = np.random.default_rng(0)
    at = rng.uniform(0, 1000, size=(4000, 2))
    d = spark.createDataFrame([(0, i, 0.0, list(map(float, x))) for i, x in enumerate(at)], "g int, id long, t double, v array<double>")
    met = []
    real = NB._meet
    monkeypatch.setattr(NB, "_meet", lambda queries, data, cells, k: (met.append((queries.count(), cells)), real(queries, data, cells, k))[1])
    found = NB.nearest(d.where("id < 500").select("g", F.col("id").alias("q"), "v"), d, 3).where("rank = 1").collect()
    assert len(found) == 500 and all(r.q == r.id for r in found)
    cells = met[0][1]
    assert met[0][0] == 500 and met[1][0] < 500 * len(cells.rows) * 0.15


def test_knn_models_vote_and_save(spark, tmp_path):
    from tablelab.operators import neighbours as NB
    df = vectors(spark, [(0, 1), (0, 1), (1, 0), (2, 0), (2.5, 2), (9, 2)], ("x",))
    asked = vectors(spark, [(0, 0), (1.4, 0), (8, 0)], ("x",))
    stage = NB.KNN("classification", 3, k=3).fit(df)
    rows = stage.transform(asked).orderBy("features").collect()
    assert [r.prediction for r in rows] == [1, 0, 2] and rows[2].probability.toArray().tolist() == pytest.approx([1 / 3, 0, 2 / 3])
    near = NB.KNN("regression", 0, k=3, weights="distance").fit(df).transform(asked).orderBy("features").collect()
    assert near[0].prediction == 1.0  # rows at distance 0 alone
    assert near[1].prediction == pytest.approx((2 / 1.1) / (1 / 0.4 + 1 / 0.6 + 1 / 1.1))
    PipelineModel(stages=[stage]).write().overwrite().save(str(tmp_path / "knn"))
    again = PipelineModel.load(str(tmp_path / "knn")).transform(asked).orderBy("features").collect()
    assert [r.prediction for r in again] == [r.prediction for r in rows]
    with pytest.raises(ValueError):
        NB.KNN("regression", metric="cosine")


def test_knn_imputation_of_odd_rows(spark):
    from tablelab.operators import neighbours as NB
    rows = [(1, 1.0, 10.0, None), (2, 2.0, None, None), (3, None, None, None), (4, None, 30.0, None), (5, 3.0, 30.0, None), (6, float("nan"), 11.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id: (r.a, r.b, r.c) for r in NB.impute_knn(df, ["id"], k=1).collect()}
    assert got == {1: (1, 10, None), 2: (2, 10, None), 3: (2, 20.25, None), 4: (3, 30, None), 5: (3, 30, None), 6: (1, 11, None)}
    assert NB.impute_knn(df.limit(0), ["id"]).count() == 0
    full = df.where("id in (1, 5)").drop("c")
    assert sorted(map(tuple, NB.impute_knn(full, ["id"]).collect())) == [(1, 1.0, 10.0), (5, 3.0, 30.0)]


# ------------------------------------------------------------------------- network

def test_callbacks_on_planted_loss_curves():
    from tablelab.operators.network import Callbacks
    c = Callbacks(0.1, patience=3, lr_patience=2, min_lr=0.04)
    seen = [(c.epoch(loss), c.improved, c.lr) for loss in (5.0, 4.0, 4.0, 4.5, 3.0, 3.1, 3.2, 3.3)]
    assert [s[1] for s in seen] == [True, True, False, False, True, False, False, False]
    assert [s[2] for s in seen] == [0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.04, 0.04]  # halved, and held at the least
    assert [s[0] for s in seen] == [True] * 7 + [False] and c.best == 3.0
    small = Callbacks(0.1, lr_patience=2)
    for loss in (1.0, 0.99995, 0.9999):   # below the plateau's threshold, yet better weights
        small.epoch(loss)
    assert small.lr == 0.05 and small.waited == 0


def test_batch_and_head_rules():
    from tablelab.operators import network as NW
    assert [NW.batch_rule(n) for n in (10, 800, 100_000)] == [16, 25, 64]
    assert [NW.head_of(*x) for x in (("regression", 0), ("classification", 2), ("classification", 3))] == ["linear", "sigmoid", "softmax"]
    assert ML.nn_dropout([64, 32], 5, None) == [0.2, 0.1] and ML.nn_dropout([256, 128, 64, 32], 80, None) == [0.4, 0.3, 0.2, 0.1]


@pytest.mark.parametrize("head", ["linear", "sigmoid", "softmax"])
@pytest.mark.parametrize("activation", ["relu", "tanh", "elu", "selu", "sigmoid"])
def test_network_gradient_matches_differences(head, activation):
    from tablelab.operators import network as NW
    o = NW.Options([5, 4], [0.0, 0.0], activation=activation, l2=0.01)
    net = NW.Net([3, 5, 4, 3 if head == "softmax" else 1], head, o)
    rng = np.random.default_rng(0)
    net.theta += rng.normal(scale=0.1, size=len(net.theta)) * net.trained
    x, y = rng.normal(size=(12, 3)), rng.integers(0, 3 if head == "softmax" else 2, 12).astype(float)
    hidden = net.decayed.copy()
    hidden[-(net.parts[-1]["w"].size + net.parts[-1]["b"].size):] = False

    def value(theta):
        other = NW.Net(net.sizes, head, o, theta)
        return other.loss(other.forward(x, np.random.RandomState(0))[0], y)[0] / len(x) + o.l2 * (hidden * theta ** 2).sum()
    start = net.theta.copy()
    _, g = NW.Net(net.sizes, head, o, start).gradient(x, y, np.random.RandomState(0))
    for i in np.flatnonzero(net.trained)[::7]:
        d = np.zeros(len(start))
        d[i] = 1e-6
        assert g[i] == pytest.approx((value(start + d) - value(start - d)) / 2e-6, abs=2e-5)


def test_network_learns_stops_and_keeps_the_best_weights(spark, tmp_path):
    from tablelab.operators import network as NW
    rnd = random.Random(1)
    rows = [(x, y, float(x * y > 0)) for x, y in ((rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for _ in range(1500))]
    df = vectors(spark, rows, ("a", "b")).repartition(3)
    o = NW.Options([32, 16], [0.0, 0.0], learning_rate=0.02, epochs=40, patience=6, lr_patience=3)
    stage = NW.Network("classification", 2, o).fit(df)
    out = stage.transform(df).select("label", "prediction", "probability").collect()
    assert sum(r.label == r.prediction for r in out) > 1350 and all(abs(sum(r.probability) - 1) < 1e-9 for r in out)
    losses = [h[2] for h in stage.history]
    assert len(losses) <= 40 and (len(losses) == 40 or len(losses) - 1 - int(np.argmin(losses)) == 6)
    net = NW.Net(stage.sizes, stage.head, o, stage.theta)
    held = NW.network_blocks(df, o.validation).where("held").collect()
    got = sum(net.loss(net.forward(np.frombuffer(r.x).reshape(r.n, -1))[0], np.frombuffer(r.y))[0] for r in held) / sum(r.n for r in held)
    assert got == pytest.approx(min(losses))
    PipelineModel(stages=[stage]).write().overwrite().save(str(tmp_path / "net"))
    again = PipelineModel.load(str(tmp_path / "net")).transform(df)
    pick = lambda rows: sorted((tuple(r.features), r.prediction) for r in rows)
    assert pick(again.collect()) == pick(stage.transform(df).collect())


def test_three_class_and_linear_networks(spark):
    from tablelab.operators import network as NW
    rows = [(i % 30 / 10, float(i % 30 // 10)) for i in range(600)]
    df = vectors(spark, rows, ("a",))
    o = NW.Options([16], [0.0], learning_rate=0.02, epochs=25, batch_norm=False, l2=0.0)
    out = NW.Network("classification", 3, o).fit(df).transform(df).collect()
    assert sum(r.label == r.prediction for r in out) > 540 and len(out[0].probability) == 3
    for optimizer in ("sgd", "rmsprop"):
        o.optimizer = optimizer
        stage = NW.Network("regression", 0, o).fit(df)
        assert stage.history[-1][1] < stage.history[0][1]


# ------------------------------------------------------------------------- k-means

def test_ten_starts_are_never_worse_than_one_and_share_their_scans(spark, monkeypatch):
    from tablelab.operators import lloyd
    rng = np.random.default_rng(2)
    spots = rng.uniform(-10, 10, size=(7, 2))
    x = np.vstack([s + rng.normal(scale=0.4, size=(60, 2)) for s in spots])
    df = vectors(spark, [(*r, 0) for r in x], ("a", "b"))
    passes = []
    real = lloyd.step
    monkeypatch.setattr(lloyd, "step", lambda blocks, models: (passes.append(len(models)), real(blocks, models))[1])
    many = lloyd.fit_all(df, [2, 7], 10)
    assert passes[0] == 20 and len(passes) < 60   # all models in one pass
    one = lloyd.fit_all(df, [2, 7], 1)
    for k in (2, 7):
        centers, inertia = many[k]
        assert inertia <= one[k][1] + 1e-9
        away = ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum()
        assert inertia == pytest.approx(away)
    assert many[7][1] < 2 * 420 * 0.4 ** 2 * 1.2   # all seven spots are found


def test_kmeans_on_repeated_and_missing_rows(spark):
    from tablelab.operators import lloyd
    df = vectors(spark, [(1, 1, 0)] * 50 + [(2, 2, 0)], ("a", "b"))
    got = lloyd.fit_all(df, [2, 3], 3)
    assert got[2][1] == pytest.approx(0) and got[3][1] == pytest.approx(0)
    assert lloyd.fit_all(df.limit(0), [2], 2) == {}


# ------------------------------------------------------------------ appended tables

def test_a_run_is_appended_once_and_broken_attempts_are_not_seen(spark, tmp_path):
    from tablelab.sources import ledger
    root, fields = str(tmp_path / "runs"), "a long, b string"
    one = spark.createDataFrame([(1, "x"), (2, None)], fields)
    assert ledger.read(spark, root, fields).count() == 0
    assert ledger.append(one, root, "r1") and not ledger.append(one, root, "r1")   # a retry changes nothing
    one.write.parquet(f"{root}/r2/data-lost")                                       # an attempt without its marker
    (tmp_path / "runs" / "r3").mkdir()
    (tmp_path / "runs" / "r3" / ledger.MARKER).touch()                              # a writer lost while committing
    assert set(ledger.runs(spark, root)) == {"r1"}
    assert ledger.append(one.limit(1), root, "r2") and ledger.append(one.limit(0), root, "r3")
    got = sorted((r.run_id, r.a) for r in ledger.read(spark, root, fields).collect())
    assert got == [("r1", 1), ("r1", 2), ("r2", 1)] and set(ledger.runs(spark, root)) == {"r1", "r2", "r3"}
    with pytest.raises(ValueError):
        ledger.append(one, root, "../r4")


def test_registry_holds_each_run_once(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 7 > 3)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, a double, y double")
    r = ML.train_models(df, "y", ["id"], ["a"], "classification", "naive_bayes", 0.25, 2)
    root = str(tmp_path / "models")
    assert ML.register_run(r, root, "run-1") and ML.register_run(r, root, "run-2") and not ML.register_run(r, root, "run-1")
    got = ML.registry(spark, root).collect()
    assert sorted(g.run_id for g in got) == ["run-1", "run-2"]
    assert all(PipelineModel.load(g.path).transform(r.test_predictions["Naive Bayes"].select("id", "__f_a")).count() > 0 for g in got)


def test_knn_imputation_ties_do_not_hang_on_rounding(spark):
    from tablelab.operators import neighbours as NB
    # squared distances of 0.09 and 0.09 over (a, b): 0.3 + 0 and 0 + 0.3, unequal in floating point
    rows = [(1, 1.1, 2.2, None), (2, 1.4, 2.2, 10.0), (3, 1.1, 2.5, 20.0), (4, 0.8, 2.2, 30.0), (5, 1.1, 1.9, 40.0)]
    for order in (rows, [(6 - i, *r) for i, *r in rows]):
        df = spark.createDataFrame(order, "id long, a double, b double, c double")
        got = {r.id: r.c for r in NB.impute_knn(df, ["id"], k=2).collect()}
        donors = sorted((i, c) for i, _, _, c in order if c is not None)[:2]
        assert got[next(i for i, _, _, c in order if c is None)] == sum(c for _, c in donors) / 2


def test_smallest_keeps_the_first_of_equals():
    from tablelab.operators.neighbours import smallest
    d = np.array([[3.0, 1, 1, 2, 1, 0], [5, 5, 5, 5, 5, 5], [9, 8, 7, 6, 5, 4]])
    assert smallest(d, 3).tolist() == [[5, 1, 2], [0, 1, 2], [5, 4, 3]]
    assert smallest(d, 9).tolist() == np.argsort(d, axis=1, kind="stable").tolist()


def test_class_index_beyond_the_bound_of_learners(spark, monkeypatch):
    from tablelab.operators import ml as ML
    monkeypatch.setattr(ML, "MAX_CLASSES", 300)
    for kind, n in (("string", 301), ("int", 250)):
        df = spark.range(n).select(F.col("id").cast(kind).alias("y")).union(spark.sql(f"SELECT CAST(NULL AS {kind})"))
        out, classes = ML.label_index(df, "y")
        want = {v: float(i) for i, v in enumerate(sorted(str(i) if kind == "string" else i for i in range(n)))} | {None: None}
        assert {r["y"]: r["label"] for r in out.collect()} == want
        assert classes == (None if n > 300 else [str(i) for i in range(n)])
    with pytest.raises(ValueError, match="more than 300 classes"):
        ML.class_list(None, "y")


def test_rows_of_one_partition_are_dealt_evenly(spark, monkeypatch):
    from tablelab import session
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    df = session.cut_lineage(spark.range(0, 1000, 1, 1))
    sizes = [r["count"] for r in session.even_out(df).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 2 * 1000 / spark.sparkContext.defaultParallelism
    even = session.cut_lineage(spark.range(0, 1000, 1, 8))
    assert session.even_out(even) is even


def test_kernel_blocks_hold_the_features_only(spark):
    rng = np.random.RandomState(1)
    rows = vectors(spark, np.column_stack([rng.randn(300, 3), rng.randint(0, 2, 300)]), ["a", "b", "c"])
    blocks = KM.feature_blocks(rows)
    assert blocks.agg(F.sum(F.length("x")), F.sum("n")).first() == (300 * 3 * 8, 300)   # no kernel values on disk
    x = np.vstack([np.frombuffer(r["x"]).reshape(-1, 3) for r in blocks.collect()])
    y = np.concatenate([np.frombuffer(r["y"]) for r in blocks.collect()])
    for mapped in (KM.fit_map(rows, "rbf", "scale"), KM.fit_map(rows, "linear", "scale")):
        w = rng.randn(1, mapped.width + 1)
        full = np.hstack([mapped(x), np.ones((len(x), 1))])
        value, slope = KM.tube(0.1, 0.05)(full @ w.T, y)
        got, grad = KM.evaluate(blocks, w, KM.tube(0.1, 0.05), mapped)
        assert got == pytest.approx(value) and np.allclose(grad, slope.T @ full)


def test_batches_share_one_place_for_slopes(monkeypatch):
    from tablelab.operators import network as NW
    made, real = [], NW.Net.__post_init__
    monkeypatch.setattr(NW.Net, "__post_init__", lambda self: (made.append(1), real(self))[1])
    net = NW.Net([3, 8, 4, 1], "linear", NW.Options([8, 4], [0.0, 0.0], batch_norm=True))
    rng = np.random.RandomState(0)
    x, y = rng.randn(16, 3), rng.randn(16)
    first = [net.gradient(x, y, rng)[1] for _ in range(20)][0]
    assert len(made) == 2
    other = net.gradient(rng.randn(16, 3), y, rng)[1]
    assert not np.shares_memory(first, other)   # a later batch does not write into an earlier one's slopes


def test_step_of_k_means_against_plain_sums(spark):
    from tablelab.operators import lloyd
    best, at = lloyd.nearest(np.array([[1.0, 2, 3], [1, 1, 4], [0, 1, 3]]))
    assert best.tolist() == [0, 1, 3] and at.tolist() == [2, 1, 0]
    rng = np.random.RandomState(3)
    x, models = rng.randn(500, 2), [rng.randn(2, 2), rng.randn(5, 2)]
    rows = vectors(spark, np.column_stack([x, np.zeros(500)]), ["a", "b"])
    for m, (sums, counts, inertia) in zip(models, lloyd.step(lloyd.blocks_of(rows), models)):
        away = ((x[:, None] - m) ** 2).sum(2)
        hot = np.eye(len(m))[away.argmin(1)]
        assert np.allclose(sums, hot.T @ x) and np.array_equal(counts, hot.sum(0)) and inertia == pytest.approx(away.min(1).sum())


def test_balls_of_rows_give_the_sums_of_single_rows(spark, monkeypatch):
    from tablelab.operators import lloyd
    monkeypatch.setattr(lloyd, "LEAST_ROWS", 500)
    rng = np.random.RandomState(5)
    x = np.column_stack([rng.randn(6001), rng.randint(0, 9, 6001), np.where(rng.rand(6001) < 0.5, 1.0, rng.randn(6001))])
    x[:2500] = x[0]                                   # a crowded place: its region has several blocks
    rows = vectors(spark, np.column_stack([x, np.zeros(len(x))]), ["a", "b", "c"]).repartition(3)
    blocks = lloyd.blocks_of(rows).cache()
    got = blocks.collect()
    assert len(got) > 8 and sum(r.n for r in got) == len(x) and max(r.n for r in got) <= 3000
    kept = np.vstack([np.frombuffer(r.x).reshape(r.leaves, -1, 3)[np.arange(len(r.x) // 24 // r.leaves) <
                      np.frombuffer(r.leaf).reshape(r.leaves, -1)[:, :1]] for r in got])
    assert np.array_equal(kept[np.lexsort(kept.T)], x[np.lexsort(x.T)])
    singles = []
    real = lloyd.Sums.single
    models = [x[rng.choice(len(x), k)] + rng.randn(k, 3) * 0.1 for k in (2, 3, 10)]
    for r in got:                                     # whole balls are added for most rows
        s = lloyd.Sums(models[0])
        monkeypatch.setattr(lloyd.Sums, "single", lambda self, part: (singles.append(part.shape[1]), real(self, part))[1])
        s.block(*next(lloyd.opened([lloyd._batch(r.asDict())], 3)))
    assert 0 < sum(singles) < 0.5 * len(x)
    for m, (sums, counts, inertia) in zip(models, lloyd.step(blocks, models)):
        away = ((x[:, None] - m) ** 2).sum(2)
        hot = np.eye(len(m))[away.argmin(1)]
        assert np.allclose(sums, hot.T @ x) and np.array_equal(counts, hot.sum(0)) and inertia == pytest.approx(away.min(1).sum())


def test_silhouettes_match_sparks_evaluator(spark, monkeypatch):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from tablelab.operators import cluster as CL, lloyd
    rng = np.random.RandomState(6)
    x = np.vstack([rng.randn(300, 2) + c for c in ((0, 0), (6, 0), (0, 6))] + [[[40, 40]]])   # one row alone
    rows = vectors(spark, np.column_stack([x, np.zeros(len(x))]), ["a", "b"])
    models = [np.array(c, float) for c in ([[0, 0], [6, 0]], [[0, 0], [6, 0], [0, 6], [40, 40]], [[0, 1], [5, 0], [90, 90]])]
    calls = []
    monkeypatch.setattr(ClusteringEvaluator, "evaluate", lambda *a: calls.append(1))
    sweep, _ = CL.k_sweep(rows, 3)                    # the sweep makes no pass per k
    assert not calls and {r.k for r in sweep.collect()} == {2, 3}
    monkeypatch.undo()
    for m, got in zip(models, lloyd.silhouettes(lloyd.blocks_of(rows), models)):
        assert got == pytest.approx(ClusteringEvaluator().evaluate(CL.assign_centers(rows, m, "prediction")))
    with pytest.raises(ValueError):
        lloyd.silhouettes(lloyd.blocks_of(rows), [np.array([[0.0, 0], [900, 900]])])


def test_network_blocks_are_dealt_evenly_over_cores(spark, monkeypatch):
    from tablelab.operators import network as NW
    from tablelab.session import rounds
    assert rounds([5, 5, 5, 5, 5, 5, 5], 6) == 10 and rounds([4, 3, 3], 3) == 4
    rng = np.random.RandomState(8)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(NW, "BLOCK_ROWS", 20)
    rows = vectors(spark, np.column_stack([rng.randn(800 * cores, 2), rng.randint(0, 2, 800 * cores)]), ["a", "b"])
    for parts, wanted in ((cores + 1, cores), (cores, cores), (3 * cores, 3 * cores)):   # the last of cores + 1 tasks is a second round
        blocks = NW.network_blocks(rows.repartition(parts), 0.25)
        dealt = [r["n"] for r in blocks.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n")).collect()]
        assert len(dealt) == wanted and rounds(dealt, cores) < 1.5 * 800 and sum(dealt) == 800 * cores
    assert NW.network_blocks(rows.limit(300).repartition(3), 0.25).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("activation, norm", [("relu", True), ("tanh", True), ("elu", False)])
def test_training_batches_share_places_and_match_the_plain_pass(activation, norm):
    from tablelab.operators import network as NW
    rng = np.random.RandomState(9)
    x, y = rng.randn(64, 3), rng.randint(0, 3, 64).astype(float)
    net = NW.Net([3, 8, 4, 3], "softmax", NW.Options([8, 4], [0.2, 0.0], activation=activation, batch_norm=norm))
    plain = NW.Net(net.sizes, net.head, net.options, net.theta)
    for rows in (64, 20, 64):
        a = plain.forward(x[:rows], np.random.RandomState(rows))[0]
        b = net.forward_batch(x[:rows], np.random.RandomState(rows), net.space(rows))[0]
        assert np.array_equal(a, b) and np.array_equal(net.theta, plain.theta)   # running means move alike
    first = net.space(64)[0]["z"]
    net.gradient(x, y, np.random.RandomState(1))
    assert net.space(64)[0]["z"] is first             # no new places for a batch of known size


def test_kernel_values_of_a_pass_take_one_product(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(500, 3)) * 5, rng.normal(size=(40, 3))
    m = KM.KernelMap("rbf", 0.4, z)
    plain, calls = KM.kernel_values(x, z, "rbf", 0.4), []
    monkeypatch.setattr(KM, "kernel_values", lambda *a: calls.append(1))
    assert np.allclose(m.values(x), plain, atol=1e-13) and m.values(z).max() <= 1 and not calls
    monkeypatch.undo()
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(KM, "BLOCK_ROWS", 20)
    rows = vectors(spark, np.column_stack([rng.normal(size=(800 * cores, 2)), rng.integers(0, 2, 800 * cores)]), ["a", "b"])
    blocks = KM.feature_blocks(rows.repartition(cores + 1))   # the last task would be a second round
    assert blocks.rdd.getNumPartitions() == cores and blocks.agg(F.sum("n")).first()[0] == 800 * cores
