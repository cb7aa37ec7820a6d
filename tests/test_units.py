"""Hand-made micro-frames with expected values, cross-checks against pandas,
and properties."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelab.functions import stats as S
from tablelab.operators import eda as E
from tablelab.operators import metrics as MT
from tablelab.operators import ml as ML
from tablelab.operators import preprocess as PP
from tablelab.operators import profile as P
from tablelab.operators import text as X


def test_prefix_sums_buckets_equal_single_window(spark):
    rnd = random.Random(7)
    rows = [("a", float(rnd.randint(0, 500))) for _ in range(3000)] + [("b", float(rnd.random())) for _ in range(800)]
    df = spark.createDataFrame(rows, "column string, x double")
    vc = S.value_counts(df)
    one = {(r["column"], r["x"]): r["cum_before"] for r in S.rank_table(vc, max_distinct=1).collect()}
    many = {(r["column"], r["x"]): r["cum_before"] for r in S.rank_table(vc, values_per_bucket=37).collect()}
    assert one == many


def test_prefix_sums_text_buckets(spark):
    words = [f"w{i:05d}" for i in range(400)] + ["alpha", "beta", "zeta"]
    df = spark.createDataFrame([(w,) for w in words], "x string").withColumn("column", F.lit("c")).withColumn("cnt", F.lit(1))
    got = {r["x"]: r["cnt_before"] for r in S.prefix_sums(df, "column", "x", ("cnt",), values_per_bucket=10).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def test_exact_quantiles_match_pandas(spark):
    vals = [1.0, 2.0, 2.0, 2.0, 3.0, 10.0, 10.0, None, 7.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = S.quantiles_wide(df, ["x"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]).first()
    s = pd.Series([v for v in vals if v is not None])
    for p, nm in [(0.0, "q0"), (0.1, "q10"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.9, "q90"), (1.0, "q100")]:
        assert got[nm] == pytest.approx(s.quantile(p))


def test_exact_quantiles_match_pandas_in_long_columns(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    n = 4 * S.BRACKET + 1234
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 7, n).astype(float), "odd 'name`": rng.exponential(size=n)})
    pdf.loc[::5, "a"] = np.nan
    pdf.loc[: n // 3, "odd 'name`"] = 0.5   # a hot value
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, `odd 'name```  double")
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 1.0]
    plan = S.quantiles_long(df, pdf.columns.tolist(), probs)
    got = {(r["column"], r["prob"]): r["qv"] for r in plan.collect()}
    for c in pdf:
        for p in probs:
            assert got[(c, p)] == pytest.approx(pdf[c].quantile(p), rel=1e-12)


def test_quantiles_scan_the_table_once_in_the_final_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = S.quantiles_wide(df, ["l_quantity", "l_extendedprice", "l_tax"], [0.25, 0.5, 0.75])
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 1


def test_text_buckets_split_shared_prefixes(spark):
    words = [f"Customer#{i:06d}" for i in range(2000)]
    df = spark.createDataFrame([("c", w, 1) for w in words], "column string, x string, cnt int")
    edges = S._text_edges(df, ["column"], "x", 20, 2000).first()["_edges"]
    assert 10 <= len(edges) <= 40 and edges == sorted(edges)
    got = {r["x"]: r["cnt_before"] for r in S.prefix_sums(df, "column", "x", ("cnt",), values_per_bucket=100).collect()}
    assert got == {w: i for i, w in enumerate(words)}


def test_json_lines_by_format_and_strict_csv_numbers(spark, tmp_path):
    from tablelab.sources import io
    (tmp_path / "x.txt").write_text("".join('{"k": %d}\n' % i for i in range(100)))
    assert io.load_table(spark, str(tmp_path / "x.txt"), fmt="jsonl").count() == 100
    (tmp_path / "t.csv").write_text("code,n,x,flag\n1d,1,1.5,true\n2f,-2,2e3,False\n3d,3,.5,TRUE\n")
    df = io.load_table(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double", "boolean"]
    assert [r["code"] for r in df.collect()] == ["1d", "2f", "3d"]


def test_spearman_diagonal_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(10)], "a double, k double")
    got = {(r["col_a"], r["col_b"]): r["rho"] for r in E.spearman_matrix(df, ["a", "k"]).collect()}
    assert got == {("a", "a"): 1.0, ("k", "k"): None, ("a", "k"): None, ("k", "a"): None}


def test_onehot_of_many_values_is_a_sparse_vector(spark, monkeypatch):
    from tablelab.operators import preprocess as PP
    monkeypatch.setattr(PP, "ONEHOT_MAX_VALUES", 5)
    df = spark.createDataFrame([(i, f"v{i % 20:02d}") for i in range(40)] + [(99, None)], "i int, s string")
    model = PP.fit_encode(df, "onehot", ["s"])
    got = {r["i"]: r["s"] for r in model.transform(df).collect()}
    assert all(got[i].size == got[0].size and got[i].indices.tolist() == [sorted(f"v{k:02d}" for k in range(20)).index(f"v{i % 20:02d}") + 1]
               for i in range(40)) and got[99].indices.tolist() == []


def test_extra_trees_differ_and_model_keys_select_their_model(spark):
    from tablelab.operators import ml as ML
    rows = [(i, float(i % 17), float((i * 7) % 13), float(i % 17) * 2 + float((i * 7) % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    r = ML.train_models(df, "y", ["id"], ["a", "b"], "regression", "extra_trees", 0.2, 2, hp={"n_estimators": 5, "max_depth": 5})
    trees = r.models["Extra Trees"].stages[-1].trees
    assert len({t.toDebugString.split("\n", 1)[1] for t in trees}) == 5
    for catalog in (ML.regressors({}, 100, 2), ML.classifiers({}, 100, 2, 2)):
        for key, names in ML.MODEL_KEYS.items():
            assert set(ML.choose_models(catalog, key)) == set(names) & set(catalog)
    with pytest.raises(ValueError):
        ML.regressors({"max_depth": 31}, 100, 2)


def test_adaboost_and_network_stages_save_and_load(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from tablelab.operators import ml as ML
    rows = [(i, float(i % 5), float(i % 3), float(i % 5 > 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    for problem, key in (("classification", "adaboost"), ("regression", "mlp")):
        r = ML.train_models(df, "y", ["id"], ["a", "b"], problem, key, 0.25, 2, hp={"n_estimators": 3})
        name, model = next(iter(r.models.items()))
        test = r.test_predictions[name].select("id", "__f_a", "__f_b")
        model.write().overwrite().save(str(tmp_path / key))
        again = PipelineModel.load(str(tmp_path / key))
        assert sorted(again.transform(test).select("id", "prediction").collect()) == sorted(
            model.transform(test).select("id", "prediction").collect())


def test_svm_gives_probabilities(spark):
    from tablelab.operators import ml as ML
    rows = [(i, float(i % 11), float(i % 7), "abc"[i % 11 // 4]) for i in range(330)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y string")
    r = ML.train_models(df, "y", ["id"], ["a", "b"], "classification", "svm", 0.2, 2)
    p = r.test_predictions["SVM"].select("probability").first()[0]
    assert len(p) == 3 and abs(sum(p) - 1) < 1e-6


def test_checkpoint_folder_of_the_caller_is_kept(spark, tmp_path):
    from tablelab.session import ensure_checkpoint_dir
    before = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == before


def test_skew_kurt_match_pandas(spark):
    vals = [1.0, 2.0, 4.0, 8.0, 16.0, 3.0, 3.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = E.skew_kurtosis(df, ["x"]).first()
    assert r["skewness"] == pytest.approx(pd.Series(vals).skew(), abs=1e-6)
    assert r["kurtosis"] == pytest.approx(pd.Series(vals).kurt(), abs=1e-6)


def test_mode_smallest_among_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "v string")
    r = P.categorical_summary(df, ["v"]).first()
    assert (r["top"], r["freq"], r["n_unique"]) == ("a", 2, 2)


def test_encode_ten_vs_eleven(spark):
    rows = [(f"a{i % 10}", f"b{i % 11}") for i in range(40)]
    df = spark.createDataFrame(rows, "c10 string, c11 string")
    m = PP.fit_encode(df, "auto")
    kinds = dict(m.order)
    assert kinds == {"c10": "onehot", "c11": "label"}
    out = m.transform(df)
    dummies = [c for c in out.columns if c.startswith("c10_")]
    assert len(dummies) == 10
    sums = out.select(sum(F.col(c).cast("int") for c in dummies).alias("s")).agg(F.max("s")).first()[0]
    assert sums <= 1
    codes = sorted(r[0] for r in out.select("c11").distinct().collect())
    assert codes == list(range(11))


def test_all_null_column(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "s string, d double")
    roles = P.infer_roles(df)
    assert "s" in roles["datetime"]            # an all-null text column parses as datetime
    m = PP.fit_impute(df.select("s").withColumn("s", F.col("s")), "mode")
    assert m.fills["s"] == "Unknown"


def test_missing_thresholds_are_strict(spark):
    # 5 %, 20 %, 50 % exactly are not flagged at that level
    n = 100
    rows = [(None if i < 5 else 1.0, None if i < 20 else 1.0, None if i < 50 else 1.0, None if i < 51 else 1.0)
            for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    sev = {r["column"]: r["severity"] for r in P.health_issues(df).collect() if r["kind"] == "missing"}
    assert sev == {"b": "MODERATE", "c": "HIGH", "d": "CRITICAL"}


def test_single_class_guard(spark):
    df = spark.createDataFrame([(i, float(i), "x") for i in range(30)], "k long, f double, y string")
    with pytest.raises(ValueError):
        ML.train_models(df, "y", ["k"], ["f"], "classification", "naive_bayes", 0.2, 2)


def test_target_candidate_hints(spark):
    rows = [(float(i), i, f"u{i}", i % 2, "n") for i in range(30)]
    df = spark.createDataFrame(rows, "price double, customer_id long, uuid string, y long, notes string")
    got = [(r["column"], r["hint_score"]) for r in P.target_candidates(df).orderBy("rank").collect()]
    assert got == [("price", 5), ("y", 5), ("notes", 2)]


def test_ecdf_monotone_ending_at_one(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2, 2, 5, 8, 8, 9]], "x double")
    pts = [r["ecdf"] for r in E.ecdf(df, ["x"]).orderBy("x").collect()]
    assert pts == sorted(pts) and pts[-1] == 1.0


def test_standard_scale_properties(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(rnd.gauss(5, 3),) for _ in range(500)], "x double")
    out = PP.fit_scale(df, "standard").transform(df)
    r = out.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert abs(r["m"]) < 1e-9 and r["s"] == pytest.approx(1.0)


def test_minmax_constant_is_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r[0] for r in PP.fit_scale(df, "minmax").transform(df).collect()] == [0.0, 0.0]


def test_folds_disjoint_and_covering(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(300)], "k long, y long")
    f = ML.assign_folds(df, ["k"], 5, "y").groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in f) == [0, 1, 2, 3, 4]
    assert sum(r["count"] for r in f) == 300


def test_auc_of_negated_score(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "label long, score double")
    a = MT.roc_auc(df, "label", "score", 1, 12).first()["roc_auc"]
    b = MT.roc_auc(df.withColumn("score", -F.col("score")), "label", "score", 1, 12).first()["roc_auc"]
    assert a + b == pytest.approx(1.0)


def test_confusion_total(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string")
    assert MT.confusion(df, "y", "p").agg(F.sum("count")).first()[0] == 3


def test_knn_free_crosstab_rows_sum_to_one(spark):
    df = spark.createDataFrame([(f"v{i % 7}", f"w{i % 4}") for i in range(200)] + [(None, "w1")], "a string, b string")
    sums = E.crosstab_shares(df, "a", "b").groupBy("v1").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-5 for r in sums)


def test_qcut_duplicate_edges(spark):
    vals = [1.0] * 6 + [2.0, 3.0]          # quartile edges repeat -> fewer bins
    df = spark.createDataFrame([(v, None if i == 0 else 1.0) for i, v in enumerate(vals)], "x double, y double")
    got = {r["quartile"]: r["n"] for r in E.missing_by_quartile(df, "x", min_n=1).collect()}
    expect = pd.qcut(pd.Series(vals), 4, duplicates="drop").value_counts(sort=False).tolist()
    assert sorted(got.values()) == sorted(expect)


def test_html_and_intent_helpers(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p><script>x</script>  c &copy;",)], "h string")
    assert df.select(X.html_to_text(F.col("h"))).first()[0] == "a & b c ©"
    t = spark.createDataFrame([("Please SEARCH the web",), ("hello",), ("what is this?",)], "t string")
    got = [r[0] for r in t.select(X.intent_expr(F.col("t"), True)).collect()]
    assert got == ["web_search", "casual_chat", "data_qa"]


def test_linear_model_beats_mean_and_reloads(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, x, 3 * x + 1 + rnd.gauss(0, 0.1)) for i, x in enumerate(rnd.random() * 10 for _ in range(400))]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    r = ML.train_models(df, "y", ["k"], ["x"], "regression", "linear", 0.2, 2)
    best = r.scores.orderBy(F.col("main_metric").desc()).first()
    assert best["main_metric"] > 0.9
    m = r.models[r.best]
    path = str(tmp_path / "m")
    m.write().overwrite().save(path)
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(path)
    a = [x[0] for x in m.transform(r.test_predictions[r.best].select("k", "label", "__f_x")).select("prediction").collect()]
    b = [x[0] for x in again.transform(r.test_predictions[r.best].select("k", "label", "__f_x")).select("prediction").collect()]
    assert a == b


def test_gaussian_nb_matches_numpy(spark):
    rnd = random.Random(9)
    rows = [(float(rnd.gauss(c * 2, 1)), float(rnd.gauss(-c, 1)), c) for c in (0, 1, 2) for _ in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, y long")
    nb = ML.GaussianNB(["a", "b"]).fit(df, "y")
    got = [r["prediction"] for r in nb.transform(df).collect()]
    X_ = np.array([[r[0], r[1]] for r in rows]); y = np.array([r[2] for r in rows])
    eps = 1e-9 * X_.var(axis=0).max()
    ll = []
    for c in (0, 1, 2):
        xc = X_[y == c]
        mu, var = xc.mean(axis=0), xc.var(axis=0) + eps
        ll.append(np.log(len(xc) / len(X_)) - 0.5 * np.log(2 * np.pi * var).sum()
                  - 0.5 * (((X_ - mu) ** 2) / var).sum(axis=1))
    assert got == list(np.argmax(np.array(ll), axis=0))


def test_csv_reader_na_tokens_and_types(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c\n1,2.5,x\nNA,,y\n3,4,N/A\n")
    from tablelab.sources.io import load_table
    df = load_table(spark, str(p))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert df.where(F.col("a").isNull()).count() == 1 and df.where(F.col("c").isNull()).count() == 1


def test_json_reader(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text('[{"age": 35, "income": 75000}, {"age": 42}]')
    from tablelab.sources.io import load_table
    df = load_table(spark, str(p))
    assert df.count() == 2 and set(df.columns) == {"age", "income"}


def test_streaming_scoring_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, rnd.random(), rnd.randint(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, x double, y long")
    r = ML.train_models(df, "y", ["k"], ["x"], "classification", "naive_bayes", 0.2, 2)
    src = tmp_path / "src"
    df.limit(100).write.parquet(str(src / "b1"))
    df.subtract(df.limit(100)).write.parquet(str(src / "b2"))
    from tablelab.operators.score import align_features, predict
    from tablelab.streaming.scoring import run_to_completion
    out = run_to_completion(spark, r.models[r.best], str(src / "*"), df.schema, r.features, ["k"],
                            sink_dir=str(tmp_path / "out"), checkpoint_dir=str(tmp_path / "ck"))
    batch = predict(r.models[r.best], align_features(df, r.features, ["k"])).select("k", "prediction")
    assert sorted(map(tuple, out.select("k", "prediction").collect())) == sorted(map(tuple, batch.collect()))


def test_nan_is_null_on_output(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r[0] for r in P.null_safe(df).collect()] == [None, None, 1.0]





@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_adaboost_keeps_two_rounds_at_most(spark, monkeypatch, kind):
    """frames of earlier rounds are released as soon as the next one is read."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from tablelab.operators.ensemble import adaboost
    rows = [(float(i % 13), float(i % 7), float((i % 13 > 6) != (i % 5 == 0))) for i in range(300)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "a double, b double, label double"))
    kept, most, keep, drop = [], [0], Frame.persist, Frame.unpersist
    persist = lambda self, *a: (kept.append(self), most.append(len(kept)), keep(self, *a))[2]
    unpersist = lambda self, *a: (kept.pop(0) if kept else None, drop(self, *a))[1]
    monkeypatch.setattr(Frame, "persist", persist)
    monkeypatch.setattr(Frame, "unpersist", unpersist)
    model = adaboost(df, kind, n_estimators=4, learning_rate=0.5)
    assert len(model.trees) == 4 and max(most) <= 2 and not kept
    # one pass over all trees gives what every tree's own predictions give
    each = [[r["prediction"] for r in t.setPredictionCol("prediction").transform(df).collect()] for t in model.trees]
    for i, r in enumerate(model.transform(df).collect()):
        own = sorted((e[i], a) for e, a in zip(each, model.alphas))
        if kind == "classification":
            best = max((sum(a for p, a in own if p == k), -k) for k in (0, 1))
            assert r["prediction"] == -best[1]
        else:
            assert r["prediction"] == next(p for j, (p, _) in enumerate(own) if sum(a for _, a in own[:j + 1]) >= sum(model.alphas) / 2)


def test_adaboost_learns_planted_rule(spark):
    from pyspark.ml.feature import VectorAssembler
    from tablelab.operators.ensemble import adaboost
    rnd = random.Random(4)
    rows = [(x, y, float(1 if x + y > 1 else 0)) for x, y in ((rnd.random(), rnd.random()) for _ in range(300))]
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(
        spark.createDataFrame(rows, "x double, y double, label double"))
    m = adaboost(df, "classification", n_estimators=8, learning_rate=1.0)
    acc = MT.classification_metrics(m.transform(df), "label", "prediction").first()["accuracy"]
    assert acc > 0.8


def test_quantile_paths_agree(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(float(rnd.randint(0, 60)), rnd.random() if i % 5 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    fast = {r["column"]: r for r in S.quantiles_wide(df, ["a", "b"], probs).collect()}
    monkeypatch.setattr(S, "VALUES_PER_BUCKET", 20)      # force range buckets inside the rank path
    dist = {r["column"]: r for r in S.quantiles_wide(df, ["a", "b"], probs).collect()}
    for c in ("a", "b"):
        ref = pd.Series([r[0 if c == "a" else 1] for r in rows]).dropna()
        for p in probs:
            nm = f"q{int(round(p * 100))}"
            assert fast[c][nm] == pytest.approx(ref.quantile(p))
            assert dist[c][nm] == pytest.approx(ref.quantile(p))


def test_hot_value_a_third_of_rows(spark, monkeypatch):
    """One value holds a third of all rows: ranks, quantiles, top-k and
    stratified folds stay exact when groups are split into range buckets."""
    rnd = random.Random(13)
    rows = [(i, 7.0 if i % 3 == 0 else float(rnd.randint(0, 400)), "hot" if i % 3 == 0 else f"v{i % 50}")
            for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, x double, s string")
    monkeypatch.setattr(S, "VALUES_PER_BUCKET", 25)
    got = S.quantiles_wide(df, ["x"], [0.1, 0.5, 0.9]).first()
    ref = pd.Series([r[1] for r in rows])
    assert [got["q10"], got["q50"], got["q90"]] == pytest.approx([ref.quantile(p) for p in (0.1, 0.5, 0.9)])
    top = E.top_categories(df, ["s"], 3).orderBy("rank").collect()
    assert (top[0]["value"], top[0]["cnt"]) == ("hot", 500)
    folds = ML.assign_folds(df, ["k"], 5, "s").groupBy("fold").count().collect()
    assert sum(r["count"] for r in folds) == 1500 and len(folds) == 5


def test_mlp_regressor_fits_planted_relation(spark):
    from tablelab.operators import ml as ML
    rnd = random.Random(8)
    rows = [(i, x, 3 * x + 1 + rnd.gauss(0, 0.05)) for i, x in enumerate(rnd.uniform(-1, 1) for _ in range(300))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    scores, _, model = ML.train_nn(df, "y", ["id"], ["x"], 0.2, 60, [16, 8], "regression", dropout=[0.0, 0.0], batch_norm=False, learning_rate=0.01)
    assert {r["metric"]: r["value"] for r in scores.collect()}["r2"] > 0.9
    hist = ML.training_history(model).collect()
    assert hist[-1]["loss"] < hist[0]["loss"] and sum(r["is_best"] for r in hist) == 1


@pytest.mark.parametrize("shift", [-1, 1, 0])
def test_wrong_brackets_are_opened(spark, monkeypatch, shift):
    """First brackets above, below or between the wanted ranks still give exact quantiles."""
    from tablelab.functions import stats
    vals = [float((i * 7919) % 1000) / 10 for i in range(1000)]
    df = spark.createDataFrame([(v, -v) for v in vals], "a double, b double")
    monkeypatch.setattr(stats, "_bracket", lambda first, i, marks, p, wide: tuple(
        min(max(v, float(first[f"a{i}"])), float(first[f"z{i}"])) for v in {-1: (-1e9, -99.0), 0: (0.0, 0.0), 1: (99.0, 1e9)}[shift]))
    got = {(r["column"], r["prob"]): r["qv"] for r in stats.quantiles_long(df, ["a", "b"], [0.1, 0.5, 0.9]).collect()}
    for c, sign in (("a", 1), ("b", -1)):
        want = pd.Series([sign * v for v in vals]).quantile([0.1, 0.5, 0.9])
        assert [got[c, p] for p in (0.1, 0.5, 0.9)] == pytest.approx(want.tolist())
