"""Supervised learning on ``pyspark.ml`` (M1-M33) and the neural-network
endpoint re-aimed onto Spark's multilayer perceptron (A1-A5).

Training data never leaves the cluster: splits and folds are columns computed
with distributed ranks, features are assembled by a ``Pipeline`` (mean
imputation and scaling fitted on the training split only), metrics are
aggregates (:mod:`tablelab.operators.metrics`), and fitted pipelines are saved
with ``PipelineModel.save`` into a shared folder.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions.stats import NUMERIC_TYPES, prefix_sums, q, sample_key
from tablelab.operators import cells as CE
from tablelab.operators import grown_trees as GT
from tablelab.operators import kernel as KM
from tablelab.operators import least_squares as LS
from tablelab.operators import metrics as MT
from tablelab.operators import neighbours as NB
from tablelab.operators import network as NW
from tablelab.operators import stages as ST
from tablelab.session import cut_lineage, even_out
from tablelab.sources import ledger

# FIXED VALUES: default hyperparameters and model-choice keys.
DEFAULTS = {
    "n_estimators": 200, "max_depth": 20, "min_samples_split": 2, "min_samples_leaf": 1,
    "svm_c": 1.0, "svm_kernel": "rbf", "svm_gamma": "scale", "knn_neighbors": 5, "knn_weights": "uniform",
    "knn_metric": "minkowski", "ridge_alpha": 1.0, "lasso_alpha": 0.1, "logistic_penalty": "l2", "logistic_c": 1.0,
    "xgb_learning_rate": 0.1, "xgb_max_depth": 6, "xgb_subsample": 0.8, "xgb_colsample_bytree": 0.8,
    "lgb_num_leaves": 31, "lgb_learning_rate": 0.1, "lgb_feature_fraction": 0.9,
}
MODEL_KEYS = {
    "linear": ["Linear Regression", "Logistic Regression", "Ridge Regression", "Lasso Regression", "ElasticNet"],
    "random_forest": ["Random Forest"], "extra_trees": ["Extra Trees"], "xgboost": ["XGBoost"],
    "lightgbm": ["LightGBM"], "lgb": ["LightGBM"], "catboost": ["CatBoost"], "cat": ["CatBoost"],
    "svm": ["SVM"], "decision_tree": ["Decision Tree"], "mlp": ["MLP"], "naive_bayes": ["Naive Bayes"],
    "knn": ["KNN"], "gradient_boosting": ["Gradient Boosting"], "svr": ["SVR"], "adaboost": ["AdaBoost"],
}
SCALED = ("Linear", "Logistic", "Ridge", "Lasso", "SVR", "SVM", "MLP")
SPARK_MAX_DEPTH = 30
MAX_CLASSES = 100_000
LITERAL_CLASSES = 200


# --------------------------------------------------------------------------
# M1 problem type, M2 features, M4 label index, M5 guard
# --------------------------------------------------------------------------

def problem_type(df: DataFrame, target: str) -> str:
    """M1: numeric with more than 10 distinct values -> regression."""
    if isinstance(df.schema[target].dataType, NUMERIC_TYPES):
        n = df.agg(F.count_distinct(q(target))).first()[0]
        return "regression" if n > 10 else "classification"
    return "classification"


def select_features(df: DataFrame, target: str, requested: list[str] | None = None) -> list[str]:
    """M2: requested columns that exist, minus the target; default all others
    that are numeric (encode categoricals first)."""
    cols = requested or [c for c in df.columns if c != target]
    return [c for c in cols if c in df.columns and c != target
            and isinstance(df.schema[c].dataType, (*NUMERIC_TYPES, T.BooleanType))]


def label_index(df: DataFrame, target: str) -> tuple[DataFrame, list[str] | None]:
    """M4: class index in sorted order of the class text (numeric classes in
    numeric order).  Up to ``LITERAL_CLASSES`` the index is a literal map; beyond,
    classes are ranked by Spark and joined, however many there are.  The list of
    classes is None beyond ``MAX_CLASSES`` (:func:`class_list`)."""
    numeric = isinstance(df.schema[target].dataType, NUMERIC_TYPES)
    key = q(target) if numeric else q(target).cast("string")
    vals = df.select(key.alias("x")).where(F.col("x").isNotNull()).distinct()
    few = [r[0] for r in vals.limit(LITERAL_CLASSES + 1).collect()]
    if len(few) <= LITERAL_CLASSES:
        classes = sorted(few)
        m = F.create_map(*[x for i, v in enumerate(classes) for x in (F.lit(v), F.lit(float(i)))])
        return df.withColumn("label", F.element_at(m, key) if classes else F.lit(None).cast("double")), [str(c) for c in classes]
    vals = cut_lineage(vals)
    n = vals.count()
    ranked = prefix_sums(vals.select(F.lit("all").alias("g"), "x", F.lit(1).alias("cnt")), "g", "x", ("cnt",), max_distinct=n)
    codes = cut_lineage(ranked.select(F.col("x").alias("__class"), F.col("cnt_before").cast("double").alias("label")))
    classes = [str(r[0]) for r in codes.orderBy("label").select("__class").collect()] if n <= MAX_CLASSES else None
    side = F.broadcast(codes) if n <= MAX_CLASSES else codes
    return df.withColumn("__class", key).join(side, "__class", "left").drop("__class"), classes


def class_list(classes: list[str] | None, target: str) -> list[str]:
    """Learners hold weights per class on the driver: they take at most ``MAX_CLASSES`` classes."""
    if classes is None:
        raise ValueError(f"target {target} has more than {MAX_CLASSES} classes")
    return classes


def class_guard(df: DataFrame, label: str = "label", split_col: str = "is_test") -> dict:
    """M5: number of classes overall, in train and in test."""
    r = df.agg(F.count_distinct(q(label)).alias("all"),
               F.count_distinct(F.when(~q(split_col), q(label))).alias("train"),
               F.count_distinct(F.when(q(split_col), q(label))).alias("test")).first()
    return r.asDict()


# --------------------------------------------------------------------------
# M6 split, M26 folds: stratified buckets from distributed ranks
# --------------------------------------------------------------------------

def stratified_buckets(df: DataFrame, key: list[str], cuts: list[float], strata: str | None = None,
                       out: str = "bucket", seed: int = 42) -> DataFrame:
    """Assign each row to a bucket 0..len(cuts) by the rank of its replayable
    sample key within its stratum: bucket j holds ranks in
    [round(cut_j * n), round(cut_{j+1} * n)).  Ranks come from distributed
    prefix sums (no window over a whole class); the per-stratum thresholds
    (strata x cuts values) are broadcast back."""
    g = q(strata).cast("string") if strata else F.lit("all")
    keyed = df.withColumn("_g", g).withColumn("_k", sample_key(key, seed))
    vc = cut_lineage(keyed.groupBy("_g", F.col("_k").alias("x")).agg(F.count(F.lit(1)).alias("cnt")))   # read several times
    ranked = prefix_sums(vc, "_g", "x", ("cnt",))
    tot = vc.groupBy("_g").agg(F.sum("cnt").alias("n"))
    probe = tot.select("_g", "n", F.posexplode(F.array(*[F.lit(float(c)) for c in cuts])).alias("j", "cut")).select(
        "_g", "j", F.round(F.col("cut") * F.col("n")).cast("long").alias("r"))
    thr = (ranked.join(F.broadcast(probe), "_g")
           .where((F.col("cnt_before") <= F.col("r")) & (F.col("r") < F.col("cnt_before") + F.col("cnt")))
           .groupBy("_g").agg(F.collect_list(F.col("x")).alias("_t")))   # at most len(cuts) per stratum
    return (keyed.join(F.broadcast(thr), "_g", "left")
            .withColumn(out, F.size(F.filter(F.coalesce("_t", F.array().cast("array<long>")),
                                             lambda t: F.col("_k") >= t)))
            .drop("_g", "_k", "_t"))


def train_test_split(df: DataFrame, key: list[str], test_size: float = 0.2, strata: str | None = None,
                     seed: int = 42) -> DataFrame:
    """M6: adds boolean ``is_test``; stratified by ``strata`` when given."""
    b = stratified_buckets(df, key, [test_size], strata, "_b", seed)
    return b.withColumn("is_test", F.col("_b") == 0).drop("_b")


def assign_folds(df: DataFrame, key: list[str], k: int = 5, strata: str | None = None, seed: int = 42) -> DataFrame:
    """Adds integer ``fold`` in 0..k-1 (stratified when ``strata`` given)."""
    return stratified_buckets(df, key, [i / k for i in range(1, k)], strata, "fold", seed)


# --------------------------------------------------------------------------
# M7-M22 estimators
# --------------------------------------------------------------------------

def _depth(d):
    """Tree depth; None means Spark's own limit, more than that is rejected."""
    if d is not None and int(d) > SPARK_MAX_DEPTH:
        raise ValueError(f"max_depth {d} is above Spark's limit of {SPARK_MAX_DEPTH}")
    return SPARK_MAX_DEPTH if d is None else int(d)


def _tree_size(h: dict) -> dict:
    """Spark has one minimum, of rows per child: the stricter of the leaf
    minimum and half the split minimum."""
    return {"minInstancesPerNode": max(h["min_samples_leaf"], -(-h["min_samples_split"] // 2))}


def mlp_options(n_train: int) -> NW.Options:
    """Hidden layers 100 and 50, Adam, no held-out fold: the training loss
    decides when to stop."""
    return NW.Options([100, 50], [0.0, 0.0], optimizer="adam", l2=1e-4, batch_norm=False, epochs=500,
                      batch_size=max(1, min(200, n_train)), validation=0.0, patience=10, lr_patience=1000)


def regressors(hp: dict, n_train: int, n_features: int) -> dict:
    """M8, M9, M11-M15, M17, M19, M21 for regression."""
    h = {**DEFAULTS, **(hp or {})}
    d, size = _depth(h["max_depth"]), _tree_size(h)
    gb_depth = max(3, h["max_depth"] // 4) if h["max_depth"] else 5
    return {
        "Linear Regression": R.LinearRegression(regParam=0.0),
        "Ridge Regression": R.LinearRegression(regParam=h["ridge_alpha"] / max(n_train, 1), elasticNetParam=0.0,
                                               standardization=False),
        "Lasso Regression": R.LinearRegression(regParam=h["lasso_alpha"], elasticNetParam=1.0, standardization=False),
        "ElasticNet": R.LinearRegression(regParam=0.1, elasticNetParam=0.5, standardization=False),
        "Random Forest": R.RandomForestRegressor(numTrees=h["n_estimators"], maxDepth=d, seed=42, **size),
        "Extra Trees": GT.ExtraTrees(0, h["n_estimators"], d, h["min_samples_split"], h["min_samples_leaf"], n_features),
        "Gradient Boosting": CE.CellTrees(R.GBTRegressor(maxIter=h["n_estimators"], maxDepth=gb_depth, seed=42, **size), 0),
        "AdaBoost": ST.AdaBoost("regression", h["n_estimators"]),
        "Decision Tree": CE.CellTrees(R.DecisionTreeRegressor(maxDepth=d, seed=42, **size), 0),
        "KNN": NB.KNN("regression", 0, h["knn_neighbors"], h["knn_weights"], h["knn_metric"]),
        "SVR": KM.KernelSVR(h["svm_c"], h["svm_kernel"], h["svm_gamma"]),
        "MLP": NW.Network("regression", 0, mlp_options(n_train)),
        "XGBoost": R.GBTRegressor(maxIter=h["n_estimators"], stepSize=h["xgb_learning_rate"],
                                  maxDepth=h["xgb_max_depth"], subsamplingRate=h["xgb_subsample"],
                                  featureSubsetStrategy=str(h["xgb_colsample_bytree"]), seed=42, **size),
        "LightGBM": GT.LeafWiseBoosting(0, h["n_estimators"], h["lgb_learning_rate"], h["lgb_num_leaves"], h["lgb_feature_fraction"]),
        "CatBoost": CE.CellTrees(R.GBTRegressor(maxIter=h["n_estimators"], stepSize=0.1, maxDepth=6, seed=42, **size), 0),
    }


def classifiers(hp: dict, n_train: int, n_classes: int, n_features: int) -> dict:
    """M10-M15, M18-M21 for classification."""
    h = {**DEFAULTS, **(hp or {})}
    d, size = _depth(h["max_depth"]), _tree_size(h)
    gb_depth = max(3, h["max_depth"] // 4) if h["max_depth"] else 5
    pen = h["logistic_penalty"]
    reg = 0.0 if pen == "none" else 1.0 / (h["logistic_c"] * max(n_train, 1))
    enet = {"l1": 1.0, "l2": 0.0, "elasticnet": 0.5, "none": 0.0}[pen]
    binary = n_classes == 2

    def boosted(**kw):
        g = C.GBTClassifier(seed=42, **kw, **size)
        if not binary:
            return C.OneVsRest(classifier=g)
        return CE.CellTrees(g, n_classes) if g.getSubsamplingRate() == 1.0 else g

    return {
        "Logistic Regression": C.LogisticRegression(regParam=reg, elasticNetParam=enet, standardization=False,
                                                    maxIter=1000),
        "Random Forest": C.RandomForestClassifier(numTrees=h["n_estimators"], maxDepth=d, seed=42, **size),
        "Extra Trees": GT.ExtraTrees(n_classes, h["n_estimators"], d, h["min_samples_split"], h["min_samples_leaf"],
                                     max(1, int(n_features ** 0.5))),
        "Gradient Boosting": boosted(maxIter=h["n_estimators"], maxDepth=gb_depth),
        "AdaBoost": CE.CellTrees(ST.AdaBoost("classification", h["n_estimators"], n_classes=n_classes), n_classes),
        "Decision Tree": CE.CellTrees(C.DecisionTreeClassifier(maxDepth=d, seed=42, **size), n_classes),
        "KNN": NB.KNN("classification", n_classes, h["knn_neighbors"], h["knn_weights"], h["knn_metric"]),
        "Naive Bayes": C.NaiveBayes(modelType="gaussian"),
        "SVM": KM.KernelSVM(n_classes, h["svm_c"], h["svm_kernel"], h["svm_gamma"]),
        "MLP": NW.Network("classification", n_classes, mlp_options(n_train)),
        "XGBoost": boosted(maxIter=h["n_estimators"], stepSize=h["xgb_learning_rate"], maxDepth=h["xgb_max_depth"],
                           subsamplingRate=h["xgb_subsample"], featureSubsetStrategy=str(h["xgb_colsample_bytree"])),
        "LightGBM": GT.LeafWiseBoosting(n_classes, h["n_estimators"], h["lgb_learning_rate"], h["lgb_num_leaves"],
                                        h["lgb_feature_fraction"]),
        "CatBoost": boosted(maxIter=h["n_estimators"], stepSize=0.1, maxDepth=6),
    }


def choose_models(all_models: dict, model_type: str = "all") -> dict:
    """Model key -> names; an unknown key means all models."""
    if model_type == "all":
        return all_models
    allowed = MODEL_KEYS.get(model_type.lower())
    if allowed is None:
        return all_models
    return {k: v for k, v in all_models.items() if k in allowed}


def feature_pipeline(features: list[str], estimator, scale: bool) -> Pipeline:
    """M3 + M7: mean imputation and (for linear / SVM models) standardisation,
    both fitted on the training split only, then the estimator (or list of
    stages)."""
    imp = [f"__imp_{c}" for c in features]
    last = estimator if isinstance(estimator, list) else [estimator]
    stages = [Imputer(inputCols=[f"__f_{c}" for c in features], outputCols=imp, strategy="mean"),
              VectorAssembler(inputCols=imp, outputCol="features_raw" if scale else "features",
                              handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, *last])


def with_feature_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """D2 at training time: features as doubles under pipeline input names."""
    return df.select("*", *[q(c).cast("double").alias(f"__f_{c}") for c in features])


# --------------------------------------------------------------------------
# training run
# --------------------------------------------------------------------------

@dataclass
class TrainResult:
    problem: str
    features: list[str]
    classes: list[str]
    scores: DataFrame
    cv: DataFrame
    best: str
    models: dict = field(default_factory=dict)
    test_predictions: dict = field(default_factory=dict)


def _scores_row(problem, pred_df, n_classes):
    if problem == "regression":
        return MT.regression_metrics(pred_df, "label", "prediction").first().asDict()
    scored = "probability" in pred_df.columns
    if scored:   # all metrics read the predictions: they are made once
        pred_df = pr = cut_lineage(pred_df.select("label", "prediction", vector_to_array("probability").alias("_p")))
    s = MT.classification_metrics(pred_df, "label", "prediction").first().asDict()
    if scored:
        if n_classes == 2:
            s["roc_auc"] = MT.roc_auc(pr.withColumn("_s", F.col("_p")[1]), "label", "_s", 1.0).first()["roc_auc"]
        else:
            cols = {}
            for i in range(n_classes):
                pr = pr.withColumn(f"_p{i}", F.col("_p")[i])
                cols[float(i)] = f"_p{i}"
            s["roc_auc"] = MT.roc_auc_ovr(pr, "label", cols).first()["roc_auc"]
    return s


def train_models(df: DataFrame, target: str, key: list[str], features: list[str] | None = None,
                 problem: str = "auto", model_type: str = "all", test_size: float = 0.2,
                 cv_folds: int = 5, hp: dict | None = None, cv_parallelism: int = 4) -> TrainResult:
    """Split, fit every chosen model, score on the test split,
    cross-validate on the training split, pick the best (first wins ties)."""
    spark = df.sparkSession
    problem = problem_type(df, target) if problem == "auto" else problem
    feats = select_features(df, target, features)
    base = df.where(q(target).isNotNull())
    if problem == "classification":
        base, classes = label_index(base, target)
        classes = class_list(classes, target)
        if len(classes) < 2:
            raise ValueError(f"single_class: target {target} has classes {classes}")
    else:
        base, classes = base.withColumn("label", q(target).cast("double")), []
    strata = "label" if problem == "classification" else None
    split = train_test_split(base, key, test_size, strata)
    if problem == "classification":
        g = class_guard(split)
        if g["train"] < 2 or g["test"] < 2:
            split = train_test_split(base, key, test_size, None)
            if class_guard(split)["train"] < 2:
                raise ValueError("single_class_after_split")
    # iterative learners make many passes: cut the lineage of the split once
    data = even_out(cut_lineage(with_feature_inputs(split, feats).select(
        *[q(c) for c in key], "label", *[f"__f_{c}" for c in feats], "is_test")))
    test = data.where(F.col("is_test"))
    n_train = data.where(~F.col("is_test")).count()
    k = len(classes)
    catalog = regressors(hp, n_train, len(feats)) if problem == "regression" else classifiers(hp, n_train, k, len(feats))
    chosen = choose_models(catalog, model_type)
    folds = min(cv_folds, n_train)
    train_f = cut_lineage(assign_folds(data.where(~F.col("is_test")), key, folds, strata))
    train = train_f
    rows, cv_rows, models, preds = [], [], {}, {}
    inputs = [f"__f_{c}" for c in feats]
    linear = {name: (est, any(s in name for s in SCALED)) for name, est in chosen.items() if isinstance(est, R.LinearRegression)}
    fitted = LS.fit_all(train, inputs, linear, folds, cv_parallelism) if linear else {}
    if fitted:   # all linear models share the preparation, the sums over rows and the scoring of folds
        ready = {scale: feature_pipeline(feats, [], scale).fit(train).stages for scale in {scale for _, scale in linear.values()}}
        models = {name: PipelineModel(stages=[*ready[linear[name][1]], lr]) for name, (lr, _) in fitted.items()}
        preds = {name: m.transform(test) for name, m in models.items()}
        with ThreadPoolExecutor(max_workers=max(1, cv_parallelism)) as pool:
            first = dict(zip(fitted, pool.map(lambda name: _scores_row(problem, preds[name], k), fitted)))
    for i, (name, est) in enumerate(chosen.items()):
        if name in fitted:
            s = first[name]
            rows.append((i, name, json.dumps(s, sort_keys=True), s["r2"]))
            cv_rows.extend((name, f, v) for f, v in enumerate(fitted[name][1]))
            continue
        scale = any(s in name for s in SCALED)
        pipe = feature_pipeline(feats, est, scale)
        model = pipe.fit(train)
        pt = model.transform(test)
        s = _scores_row(problem, pt, k)
        rows.append((i, name, json.dumps(s, sort_keys=True), s.get("r2", s.get("accuracy"))))
        models[name], preds[name] = model, pt
        def fold_score(f, pipe=pipe):
            fm = pipe.fit(train_f.where(F.col("fold") != f))
            fp = fm.transform(train_f.where(F.col("fold") == f))
            if problem == "regression":
                v = MT.regression_metrics(fp, "label", "prediction", 12).first()["r2"]
            else:
                v = MT.classification_metrics(fp, "label", "prediction", 12).first()["accuracy"]
            return f, (float(v) if v is not None else None)

        # folds are independent Spark jobs: submit them concurrently (like CrossValidator's parallelism)
        with ThreadPoolExecutor(max_workers=max(1, min(folds, cv_parallelism))) as pool:
            for f, v in pool.map(fold_score, range(folds)):
                cv_rows.append((name, f, v))
    scores = spark.createDataFrame(rows, "ordinal int, model string, scores string, main_metric double")
    cv = spark.createDataFrame(cv_rows, "model string, fold int, score double")
    best = sorted(rows, key=lambda r: (-(r[3] if r[3] is not None else -1e18), r[0]))[0][1]
    return TrainResult(problem, feats, classes, scores, cv, best, models, preds)


def cv_summary(cv: DataFrame) -> DataFrame:
    """Mean and population std of the fold scores per model, 4 dp."""
    return cv.groupBy("model").agg(F.round(F.avg("score"), 4).alias("mean"),
                                   F.round(F.stddev_pop("score"), 4).alias("std"),
                                   F.array_sort(F.collect_list(F.struct("fold", F.round("score", 4).alias("s"))))
                                   .alias("folds"))


def comparison(scores: DataFrame) -> DataFrame:
    """Models by main metric (desc), first wins ties."""
    from pyspark.sql import Window
    w = Window.orderBy(F.col("main_metric").desc_nulls_last(), "ordinal")   # one row per model
    return scores.withColumn("rank", F.row_number().over(w))


def feature_importance(result: TrainResult) -> DataFrame:
    """Importances of the first trained model that exposes them, sorted."""
    spark = next(iter(result.test_predictions.values())).sparkSession
    for name, m in result.models.items():
        last = m.stages[-1]
        if hasattr(last, "featureImportances"):
            imp = last.featureImportances.toArray().tolist()
            rows = [(name, f, float(v)) for f, v in zip(result.features, imp)]
            return spark.createDataFrame(rows, "model string, feature string, importance double").orderBy(
                F.col("importance").desc())
    return spark.createDataFrame([], "model string, feature string, importance double")


# --------------------------------------------------------------------------
# S8 / M33 registry
# --------------------------------------------------------------------------

def models_dir(spark: SparkSession) -> str:
    """Shared folder for saved pipelines: the session's ``spark.tablelab.models.dir``,
    else below the checkpoint folder (``spark.checkpoint.dir`` on a cluster)."""
    from tablelab.session import ensure_checkpoint_dir
    given = spark.conf.get("spark.tablelab.models.dir", None)
    if given:
        return given.rstrip("/")
    return ensure_checkpoint_dir(spark).rstrip("/") + "/tablelab-models"


def save_models(result: TrainResult, root: str, run_id: str) -> DataFrame:
    """S8 + M33: save every fitted pipeline and return registry rows
    (name, path, type, framework, features, classes, scores)."""
    rows = []
    scores = {r["model"]: r["scores"] for r in result.scores.collect()}   # one row per model
    for name, m in result.models.items():
        path = f"{root}/{run_id}/{name.replace(' ', '_')}"
        m.write().overwrite().save(path)
        rows.append((name, path, result.problem, "spark.ml", result.features, result.classes, scores[name]))
    spark = next(iter(result.test_predictions.values())).sparkSession
    return spark.createDataFrame(rows, "name string, path string, type string, framework string, "
                                       "features array<string>, classes array<string>, scores string")


REGISTRY_FIELDS = ("name string, path string, type string, framework string, features array<string>, "
                   "classes array<string>, scores string")


def register_run(result: TrainResult, root: str, run_id: str) -> bool:
    """Save a run's pipelines below ``root`` and append its entries to the
    registry there; False if the run is in it already."""
    if run_id in ledger.runs(next(iter(result.test_predictions.values())).sparkSession, f"{root}/registry"):
        return False
    return ledger.append(save_models(result, root, run_id), f"{root}/registry", run_id)


def registry(spark: SparkSession, root: str) -> DataFrame:
    """All entries of all runs, with their ``run_id``."""
    return ledger.read(spark, f"{root}/registry", REGISTRY_FIELDS)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --------------------------------------------------------------------------
# A1-A5 neural network
# --------------------------------------------------------------------------

def nn_layers(n_inputs: int, user_layers: list[int] | None = None) -> list[int]:
    """A2 hidden-layer rule by input width."""
    if user_layers:
        return list(user_layers)
    if n_inputs <= 10:
        return [64, 32]
    if n_inputs <= 50:
        return [128, 64, 32]
    if n_inputs <= 100:
        return [256, 128, 64, 32]
    return [512, 256, 128, 64]


def nn_dropout(layers: list[int], n_inputs: int, user_layers: list[int] | None) -> list[float]:
    """A2 dropout rule: falling to 0.1 over the layers of the width rule, 0.3 for given layers."""
    if user_layers:
        return [0.3] * len(layers)
    top = 2 if n_inputs <= 10 else 3 if n_inputs <= 50 else 4
    return [max(1, top - i) / 10 for i in range(len(layers))]


def train_nn(df: DataFrame, target: str, key: list[str], features: list[str] | None = None,
             test_size: float = 0.2, max_epochs: int = 150, layers: list[int] | None = None,
             problem: str = "classification", **options) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """A1-A3: network over standardised features with a linear, sigmoid or softmax
    head, mini-batches, a held-out fold, early stop, halving of the rate and the
    best weights kept (``options``: fields of ``network.Options``).  Returns
    (scores frame, test predictions, model)."""
    feats = select_features(df, target, features)
    base, classes = df.where(q(target).isNotNull()), []
    if problem == "classification":
        base, classes = label_index(base, target)
        classes = class_list(classes, target)
    else:
        base = base.withColumn("label", q(target).cast("double"))
    strata = "label" if classes else None
    split = even_out(cut_lineage(with_feature_inputs(train_test_split(base, key, test_size, strata), feats)))
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    hidden = nn_layers(len(feats), layers)
    given = {"hidden": hidden, "dropout": nn_dropout(hidden, len(feats), layers), "epochs": max_epochs, **options}
    model = feature_pipeline(feats, NW.Network(problem, len(classes), NW.Options(**given)), True).fit(train)
    pred = model.transform(test)
    s = _scores_row(problem, pred, len(classes))
    spark = df.sparkSession
    scores = spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in sorted(s.items())],
                                   "metric string, value double")
    return scores, pred, model


def training_history(model: PipelineModel) -> DataFrame:
    """A4: training and held-out loss and learning rate per epoch, and which epoch
    was best (first smallest held-out loss)."""
    hist = model.stages[-1].history
    spark = SparkSession.getActiveSession()
    best = min(hist, key=lambda h: (h[2], h[0]))[0] if hist else None
    return spark.createDataFrame([(e, float(a), float(b), float(lr), e == best) for e, a, b, lr in hist],
                                 "epoch int, loss double, val_loss double, learning_rate double, is_best boolean")


def confidence(pred: DataFrame) -> DataFrame:
    """Maximum class probability, 4 dp."""
    return pred.withColumn("confidence", F.round(F.array_max(vector_to_array("probability")), 4))



# --------------------------------------------------------------------------
# M20 Gaussian naive Bayes as plain aggregates
# --------------------------------------------------------------------------

@dataclass
class GaussianNB:
    """M20 without an ML library: per-class prior, mean and population
    variance (+ 1e-9 x the largest feature variance), fitted with one grouped
    aggregate; prediction is a projection with one log-likelihood expression
    per class (classes x features numbers, held on the driver)."""
    features: list[str]
    classes: list = field(default_factory=list)
    prior: dict = field(default_factory=dict)
    theta: dict = field(default_factory=dict)
    var: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, label: str) -> "GaussianNB":
        d = df.dropna(subset=self.features + [label])
        eps = 1e-9 * (d.agg(F.greatest(*[F.var_pop(q(c)) for c in self.features])
                            if len(self.features) > 1 else F.var_pop(q(self.features[0]))).first()[0] or 0.0)
        st = d.groupBy(q(label).alias("cls")).agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(self.features)],
            *[F.var_pop(q(c)).alias(f"v{i}") for i, c in enumerate(self.features)]).limit(MAX_CLASSES + 1).collect()
        if len(st) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        total = sum(r["n"] for r in st)
        self.classes = sorted(r["cls"] for r in st)
        for r in st:
            self.prior[r["cls"]] = r["n"] / total
            self.theta[r["cls"]] = [r[f"m{i}"] for i in range(len(self.features))]
            self.var[r["cls"]] = [r[f"v{i}"] + eps for i in range(len(self.features))]
        return self

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        scores = []
        for j, c in enumerate(self.classes):
            s = F.lit(math.log(self.prior[c]))
            for i, f in enumerate(self.features):
                v, m = self.var[c][i], self.theta[c][i]
                s = s - 0.5 * math.log(2 * math.pi * v) - 0.5 * (q(f) - F.lit(m)) * (q(f) - F.lit(m)) / F.lit(v)
            scores.append(F.struct(s.alias("ll"), F.lit(-j).alias("neg_idx"), F.lit(c).alias("cls")))
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return df.withColumn(out, best["cls"])
