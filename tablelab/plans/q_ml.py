"""Registered queries: evaluation metrics, splits and supervised learning (M, A)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tablelab.functions.stats import sample_key_sql
from tablelab.operators import metrics as MT
from tablelab.operators import ml as ML
from tablelab.plans.fixtures import fixture, with_fixtures
from tablelab.plans.registry import register, union_all

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ML_FEATURES = ["l_extendedprice", "l_discount", "l_tax"]
ML_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "returned"]


# ------------------------------------------------------------------ M23-M25, M28, M30-M32

@register("regression_metrics", with_fixtures("""
    SELECT round(1 - sum((actual - predicted) * (actual - predicted)) / (count(*) * var_pop(actual)), 4) AS r2,
           round(avg(abs(actual - predicted)), 4) AS mae,
           round(sqrt(sum((actual - predicted) * (actual - predicted)) / count(*)), 4) AS rmse
    FROM det_score""", "det_score"), "M23")
def regression_metrics(spark, sf_dir):
    return MT.regression_metrics(fixture(spark, sf_dir, "det_score"), "actual", "predicted")


@register("classification_metrics", with_fixtures("""
    WITH cells AS (SELECT actual_class AS a, predicted_class AS p, count(*) AS c FROM det_score GROUP BY 1, 2),
         cls AS (SELECT a AS k FROM cells UNION SELECT p FROM cells),
         per AS (SELECT k, coalesce((SELECT sum(c) FROM cells WHERE a = k AND p = k), 0) AS tp,
                        coalesce((SELECT sum(c) FROM cells WHERE a = k), 0) AS support,
                        coalesce((SELECT sum(c) FROM cells WHERE p = k), 0) AS npred FROM cls),
         m AS (SELECT *, CASE WHEN npred > 0 THEN tp * 1.0 / npred ELSE 0 END AS pr,
                         CASE WHEN support > 0 THEN tp * 1.0 / support ELSE 0 END AS rc FROM per)
    SELECT round(sum(tp) * 1.0 / sum(support), 4) AS accuracy,
           round(sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * support) / sum(support), 4) AS f1,
           round(sum(pr * support) / sum(support), 4) AS precision, round(sum(rc * support) / sum(support), 4) AS recall
    FROM m""", "det_score"), "M24")
def classification_metrics(spark, sf_dir):
    return MT.classification_metrics(fixture(spark, sf_dir, "det_score"), "actual_class", "predicted_class")


AUC_SQL = """
    WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk
               FROM det_score WHERE score IS NOT NULL)
    SELECT round((sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
                 / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)), 4) AS roc_auc,
           CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_pos, CAST(count(*) FILTER (WHERE label <> 1) AS BIGINT) AS n_neg
    FROM r"""


@register("roc_auc", with_fixtures(AUC_SQL, "det_score"), "M25")
def roc_auc(spark, sf_dir):
    return MT.roc_auc(fixture(spark, sf_dir, "det_score"), "label", "score", 1)


@register("confusion_matrix", with_fixtures("""
    SELECT actual_class AS actual, predicted_class AS predicted, CAST(count(*) AS BIGINT) AS count
    FROM det_score GROUP BY 1, 2""", "det_score"), "M28")
def confusion_matrix(spark, sf_dir):
    return MT.confusion(fixture(spark, sf_dir, "det_score"), "actual_class", "predicted_class")


@register("roc_curve", with_fixtures("""
    WITH s AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
               FROM det_score WHERE score IS NOT NULL GROUP BY score),
         c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn,
                      sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM s)
    SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
    UNION ALL SELECT score, round(cn * 1.0 / tn, 6), round(cp * 1.0 / tp, 6) FROM c""", "det_score"), "M31")
def roc_curve(spark, sf_dir):
    return MT.roc_curve(fixture(spark, sf_dir, "det_score"), "label", "score", 1)


@register("residual_analysis", with_fixtures(f"""
    WITH r AS (SELECT CAST(actual AS DOUBLE) - CAST(predicted AS DOUBLE) AS x FROM det_score),
         st AS (SELECT min(x) AS mn, max(x) AS mx, count(x) AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM r),
         h AS (SELECT CAST(coalesce(least(floor((x - mn) / nullif(mx - mn, 0) * 35), 34), 0) AS INTEGER) AS bin,
                      count(*) AS cnt FROM r, st WHERE x IS NOT NULL GROUP BY 1)
    SELECT bin, round(mn + bin * (mx - mn) / 35, 6) AS lo, round(mn + (bin + 1) * (mx - mn) / 35, 6) AS hi, cnt,
           round(cnt / (n * (mx - mn) / 35), 6) AS density,
           round(exp(-0.5 * ((round(mn + bin * (mx - mn) / 35, 6) + round(mn + (bin + 1) * (mx - mn) / 35, 6)) / 2 - mu) / sd
                     * ((round(mn + bin * (mx - mn) / 35, 6) + round(mn + (bin + 1) * (mx - mn) / 35, 6)) / 2 - mu) / sd)
                 / (sd * {math.sqrt(2 * math.pi)!r}), 6) AS normal_pdf,
           round(mu, 6) AS mean, round(sd, 6) AS std_pop
    FROM h, st""", "det_score"), "M30")
def residual_analysis(spark, sf_dir):
    return MT.residual_analysis(fixture(spark, sf_dir, "det_score"), "actual", "predicted")


@register("prediction_sample", with_fixtures(f"""
    SELECT {', '.join(LI_KEY)}, actual, predicted FROM det_score ORDER BY {', '.join(LI_KEY)} LIMIT 50""", "det_score"),
    "M32", "A5")
def prediction_sample(spark, sf_dir):
    return MT.prediction_sample(fixture(spark, sf_dir, "det_score"), LI_KEY, "actual", "predicted", 50)


# ------------------------------------------------------------------ M1, M5, M6, M26 (replayable)

@register("problem_type", with_fixtures(union_all([
    f"SELECT '{c}' AS target, CASE WHEN {num} AND count(DISTINCT {c}) > 10 THEN 'regression' ELSE 'classification' END "
    f"AS problem FROM li_ml" for c, num in [("l_quantity", "TRUE"), ("l_linenumber", "TRUE"), ("l_returnflag", "FALSE"),
                                            ("returned", "TRUE"), ("l_extendedprice", "TRUE")]]), "li_ml"), "M1")
def problem_type(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_ml")
    rows = [(c, ML.problem_type(df, c)) for c in ["l_quantity", "l_linenumber", "l_returnflag", "returned", "l_extendedprice"]]
    return spark.createDataFrame(rows, "target string, problem string")


def _split_sql(cuts, strata, out):
    key = sample_key_sql(LI_KEY)
    g = f"CAST({strata} AS VARCHAR)" if strata else "'all'"
    ts = ", ".join(f"list_sort(list(_k))[CAST(round({c!r} * count(*)) AS BIGINT) + 1]" for c in cuts)
    return with_fixtures(f"""
        WITH k AS (SELECT *, {key} AS _k, {g} AS _g FROM li_ml),
             t AS (SELECT _g, [{ts}] AS ts FROM k GROUP BY _g)
        SELECT {', '.join('k.' + c for c in ML_COLS)}, {out}
        FROM k JOIN t USING (_g)""", "li_ml")


@register("train_test_split", _split_sql([0.2], "l_returnflag",
                                         "coalesce(NOT (_k >= ts[1]), true) AS is_test"), "M6")
def train_test_split(spark, sf_dir):
    return ML.train_test_split(fixture(spark, sf_dir, "li_ml"), LI_KEY, 0.2, "l_returnflag")


@register("kfold_assign", _split_sql([0.2, 0.4, 0.6, 0.8], "l_returnflag",
                                     "CAST(len(list_filter(ts, lambda t: _k >= t)) AS INTEGER) AS fold"), "M26")
def kfold_assign(spark, sf_dir):
    return ML.assign_folds(fixture(spark, sf_dir, "li_ml"), LI_KEY, 5, "l_returnflag")


@register("kfold_regression", _split_sql([0.2, 0.4, 0.6, 0.8], None,
                                         "CAST(len(list_filter(ts, lambda t: _k >= t)) AS INTEGER) AS fold"), "M26")
def kfold_regression(spark, sf_dir):
    return ML.assign_folds(fixture(spark, sf_dir, "li_ml"), LI_KEY, 5, None)


@register("class_guard", _split_sql([0.2], "l_returnflag", "coalesce(NOT (_k >= ts[1]), true) AS is_test").replace(
    "SELECT " + ", ".join("k." + c for c in ML_COLS) + ", coalesce(NOT (_k >= ts[1]), true) AS is_test",
    """SELECT CAST(count(DISTINCT k.l_returnflag) AS BIGINT) AS n_all,
               CAST(count(DISTINCT k.l_returnflag) FILTER (WHERE _k >= ts[1]) AS BIGINT) AS n_train,
               CAST(count(DISTINCT k.l_returnflag) FILTER (WHERE coalesce(NOT (_k >= ts[1]), true)) AS BIGINT) AS n_test"""), "M4", "M5")
def class_guard(spark, sf_dir):
    df, _ = ML.label_index(fixture(spark, sf_dir, "li_ml"), "l_returnflag")
    g = ML.class_guard(ML.train_test_split(df, LI_KEY, 0.2, "l_returnflag"))
    return spark.createDataFrame([(g["all"], g["train"], g["test"])], "n_all long, n_train long, n_test long")


@register("label_index_many", """
    SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT label) AS BIGINT) AS n_classes, CAST(sum(label) AS BIGINT) AS total
    FROM (SELECT dense_rank() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) - 1 AS label FROM lineitem) t""", "M4")
def label_index_many(spark, sf_dir):
    """A text target with thousands of classes."""
    df = fixture(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("y"))
    return ML.label_index(df, "y")[0].agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_classes"),
                                          F.sum("label").cast("long").alias("total"))


# ------------------------------------------------------------------ M20 naive Bayes in SQL

NB_FEATS = ["l_quantity", "l_extendedprice", "l_tax"]


def _nb_sql():
    feats = NB_FEATS
    per_class = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in feats)
    eps = "1e-9 * greatest(" + ", ".join(f"var_pop({f})" for f in feats) + ")"
    ll = " + ".join(f"(-0.5 * ln(2 * pi() * (v_{f} + e)) - 0.5 * ({f} - m_{f}) * ({f} - m_{f}) / (v_{f} + e))" for f in feats)
    return with_fixtures(f"""
        WITH d AS (SELECT * FROM li_ml WHERE {' AND '.join(f'{f} IS NOT NULL' for f in feats)} AND l_returnflag IS NOT NULL),
             eps AS (SELECT {eps} AS e FROM d),
             st AS (SELECT l_returnflag AS cls, count(*) * 1.0 / (SELECT count(*) FROM d) AS prior, {per_class}
                    FROM d GROUP BY 1),
             rows AS (SELECT row_number() OVER () AS rid, * FROM li_ml),
             sc AS (SELECT rid, {', '.join(LI_KEY)}, cls, ln(prior) + {ll} AS s FROM rows, st, eps)
        SELECT {', '.join(LI_KEY)}, arg_max(cls, s) AS prediction FROM sc GROUP BY rid, {', '.join(LI_KEY)}""", "li_ml")


@register("naive_bayes_sql", _nb_sql(), "M20")
def naive_bayes_sql(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_ml")
    nb = ML.GaussianNB(NB_FEATS).fit(df, "l_returnflag")
    return nb.transform(df).select(*LI_KEY, "prediction")


# ------------------------------------------------------------------ training runs (rows-only checks)

def _train(spark, sf_dir, target, model_type, problem="auto"):
    df = fixture(spark, sf_dir, "li_ml")
    return ML.train_models(df, target, LI_KEY, ML_FEATURES, problem, model_type, 0.2, 5)


@register("train_linear_regression", None, "M2", "M3", "M7", "M8", "M9", "M22", "M27")
def train_linear_regression(spark, sf_dir):
    return ML.comparison(_train(spark, sf_dir, "l_quantity", "linear").scores)


@register("train_logistic", None, "M4", "M10", "M24", "M25")
def train_logistic(spark, sf_dir):
    return ML.comparison(_train(spark, sf_dir, "l_returnflag", "linear").scores)


@register("cv_decision_tree", None, "M15", "M26")
def cv_decision_tree(spark, sf_dir):
    return ML.cv_summary(_train(spark, sf_dir, "l_quantity", "decision_tree").cv)


@register("feature_importance", None, "M29", "M15")
def feature_importance(spark, sf_dir):
    return ML.feature_importance(_train(spark, sf_dir, "returned", "decision_tree"))


@register("train_naive_bayes", None, "M20")
def train_naive_bayes(spark, sf_dir):
    return ML.comparison(_train(spark, sf_dir, "l_returnflag", "naive_bayes").scores)


@register("train_svm", None, "M18")
def train_svm(spark, sf_dir):
    """Three classes, one solver for all of them."""
    return ML.comparison(_train(spark, sf_dir, "l_returnflag", "svm").scores)


@register("train_nn", None, "A1", "A2", "A3", "M19")
def train_nn(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_ml")
    scores, _, _ = ML.train_nn(df, "l_returnflag", LI_KEY, ML_FEATURES)
    return scores


@register("nn_history", None, "A4")
def nn_history(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_ml")
    _, _, model = ML.train_nn(df, "returned", LI_KEY, ML_FEATURES)
    return ML.training_history(model)


# ------------------------------------------------------------------ M16 nearest neighbours

PART_FEATURES = ["p_size", "p_retailprice"]


def _knn_sql(distance: str, target: str, votes: str, value: str) -> str:
    """Every test row against every training row: the five nearest, ties by label."""
    return f"""
    WITH k AS (SELECT *, {sample_key_sql(['p_partkey'])} AS _k FROM part),
         lab AS (SELECT DISTINCT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS label FROM part),
         s AS (SELECT k.*, label FROM k JOIN lab USING (p_type)),
         cut AS (SELECT {'label' if target == 'label' else "0"} AS g, list_sort(list(_k))[CAST(round(0.2 * count(*)) AS BIGINT) + 1] AS cut
                 FROM s GROUP BY 1),
         t AS (SELECT s.*, _k < cut AS is_test, CAST(s.{target} AS DOUBLE) AS y
               FROM s JOIN cut ON {'label' if target == 'label' else "0"} = g),
         d AS (SELECT a.p_partkey, b.y, {distance} AS d FROM t a JOIN t b ON a.is_test AND NOT b.is_test),
         r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, y) AS r FROM d),
         n AS (SELECT *, min(d) OVER (PARTITION BY p_partkey) AS least FROM r WHERE r <= 5),
         w AS (SELECT *, {votes} AS w FROM n)
    {value}"""


@register("knn_classify", _knn_sql(
    "(a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice)",
    "label", "1", """
    , v AS (SELECT p_partkey, y, sum(w) AS w FROM w GROUP BY 1, 2)
    SELECT p_partkey, arg_min(y, (-w, y)) AS prediction FROM v GROUP BY 1"""), "M16", "M22")
def knn_classify(spark, sf_dir):
    """Class of the five nearest training rows (Euclidean, one vote each)."""
    r = ML.train_models(fixture(spark, sf_dir, "part"), "p_type", ["p_partkey"], PART_FEATURES, "classification", "knn", 0.2, 2)
    return r.test_predictions["KNN"].select("p_partkey", "prediction")


@register("knn_regress", _knn_sql(
    "abs(a.p_size - b.p_size) + abs(a.p_partkey - b.p_partkey)", "p_retailprice",
    "CASE WHEN least = 0 THEN CAST(d = 0 AS DOUBLE) ELSE 1.0 / d END",
    "SELECT p_partkey, round(sum(w * y) / sum(w), 4) AS prediction FROM w GROUP BY 1"), "M16", "M22")
def knn_regress(spark, sf_dir):
    """Mean of the five nearest training rows (Manhattan, weighted by 1 / distance)."""
    df = fixture(spark, sf_dir, "part").withColumn("key_copy", F.col("p_partkey"))
    r = ML.train_models(df, "p_retailprice", ["p_partkey"], ["p_size", "key_copy"], "regression", "knn", 0.2, 2,
                        hp={"knn_metric": "manhattan", "knn_weights": "distance"})
    return r.test_predictions["KNN"].select("p_partkey", F.round("prediction", 4).alias("prediction"))


# Tree ensembles: the library builds them with the reference defaults (200 trees,
# depth 20); the registered runs pass small, explicit hyperparameters so the
# check stays short.
SMALL_TREES = {"n_estimators": 20, "max_depth": 6}


@register("train_random_forest", None, "M11")
def train_random_forest(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_ml")
    return ML.comparison(ML.train_models(df, "returned", LI_KEY, ML_FEATURES, "classification", "random_forest",
                                         0.2, 2, hp=SMALL_TREES).scores)


#: All 200 trees of the default; fully grown they would hold more nodes than a forest may (``grown_trees.MAX_NODES``).
EXTRA_TREES = {"max_depth": 10}


@register("train_extra_trees", None, "M12")
def train_extra_trees(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_ml")
    return ML.comparison(ML.train_models(df, "l_quantity", LI_KEY, ML_FEATURES, "regression", "extra_trees",
                                         0.2, 2, hp=EXTRA_TREES).scores)


@register("train_boosted_presets", None, "M13", "M21")
def train_boosted_presets(spark, sf_dir):
    df = fixture(spark, sf_dir, "li_ml")
    return ML.comparison(ML.train_models(df, "l_quantity", LI_KEY, ML_FEATURES, "regression", "xgboost", 0.2, 2,
                                         hp=SMALL_TREES).scores)


# ------------------------------------------------------------------ M13, M14, M17, M19 by model key

def _by_key(spark, sf_dir, target, problem, key, hp=None):
    df = fixture(spark, sf_dir, "li_ml")
    return ML.comparison(ML.train_models(df, target, LI_KEY, ML_FEATURES, problem, key, 0.2, 2, hp=hp).scores)


# boosting refits the data once per round: the registered runs pass few rounds
FEW_ROUNDS = {"n_estimators": 5, "max_depth": 12}
TEN_ROUNDS = {"n_estimators": 10}


@register("train_adaboost", None, "M14", "M22")
def train_adaboost(spark, sf_dir):
    return _by_key(spark, sf_dir, "l_returnflag", "classification", "adaboost", TEN_ROUNDS)


@register("train_adaboost_regression", None, "M14", "M22")
def train_adaboost_regression(spark, sf_dir):
    return _by_key(spark, sf_dir, "l_quantity", "regression", "adaboost", TEN_ROUNDS)


@register("train_kernel_svr", None, "M17", "M22")
def train_kernel_svr(spark, sf_dir):
    return _by_key(spark, sf_dir, "l_quantity", "regression", "svr")


@register("train_gradient_boosting", None, "M13")
def train_gradient_boosting(spark, sf_dir):
    return _by_key(spark, sf_dir, "returned", "classification", "gradient_boosting", FEW_ROUNDS)


@register("train_lightgbm", None, "M21")
def train_lightgbm(spark, sf_dir):
    """Ten rounds of trees with 31 leaves each, best gain first."""
    return _by_key(spark, sf_dir, "l_quantity", "regression", "lightgbm", TEN_ROUNDS)


@register("train_mlp_regressor", None, "M19", "A1", "A2")
def train_mlp_regressor(spark, sf_dir):
    """Network of two hidden layers with a linear head."""
    return _by_key(spark, sf_dir, "l_quantity", "regression", "mlp")


# ------------------------------------------------------------------ closed forms

@register("ols_closed_form", with_fixtures("""
    WITH k AS (SELECT *, """ + sample_key_sql(LI_KEY) + """ AS _k FROM li_ml),
         t AS (SELECT list_sort(list(_k))[CAST(round(0.2 * count(*)) AS BIGINT) + 1] AS cut FROM k),
         tr AS (SELECT l_quantity AS y, l_extendedprice AS x FROM k, t WHERE _k >= cut),
         m AS (SELECT avg(x) AS mx FROM tr), f AS (SELECT y, coalesce(x, mx) AS x FROM tr, m)
    SELECT round(covar_pop(x, y) / var_pop(x) * stddev_samp(x), 4) AS slope, round(avg(y), 4) AS intercept FROM f""", "li_ml"),
          "M2", "M3", "M7", "M8")
def ols_closed_form(spark, sf_dir):
    """Least squares on one imputed, standardised feature against the textbook formula."""
    df = fixture(spark, sf_dir, "li_ml")
    r = ML.train_models(df, "l_quantity", LI_KEY, ["l_extendedprice"], "regression", "linear", 0.2, 2)
    lr = r.models["Linear Regression"].stages[-1]
    return spark.createDataFrame([(round(float(lr.coefficients[0]), 4), round(float(lr.intercept), 4))],
                                 "slope double, intercept double")
