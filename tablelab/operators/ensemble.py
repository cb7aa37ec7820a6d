"""Boosting that ``pyspark.ml`` lacks (M14), written as
driver loops over distributed fits: every round is one weighted tree fit plus
one aggregate (regression: three); the per-row state (weights) is a column whose
lineage is cut with ``checkpoint`` every few rounds.  At most two rounds' frames
are kept at a time."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.operators.grown_trees import Trees
from tablelab.session import cut_lineage

CUT_EVERY = 5


def predictions_only(tree):
    """The tree without columns of class shares, which boosting doesn't read."""
    if isinstance(tree, DecisionTreeClassificationModel):
        tree.setRawPredictionCol("").setProbabilityCol("")
    return tree


def round_frame(tree, data: DataFrame, features: str, label: str) -> DataFrame:
    """Rows with weight and the round's prediction, kept for its aggregates and the next fit."""
    return (predictions_only(tree).transform(data)
            .select(features, label, "_w", F.col("prediction").alias("_p")).persist())


def flat_trees(models: list) -> Trees:
    """Fitted trees with continuous splits as arrays; values are their predictions."""
    trees = Trees(len(models), 1)
    stack = [(i, m._java_obj.rootNode()) for i, m in enumerate(models)]
    while stack:
        at, node = stack.pop()
        trees.value[at] = node.prediction()
        if node.getClass().getSimpleName() == "InternalNode":
            cut = node.split()
            none = np.zeros((1, 1))
            left = int(trees.split(np.array([at]), np.array([cut.featureIndex()]), np.array([cut.threshold()]), none, none)[0])
            stack += [(left, node.leftChild()), (left + 1, node.rightChild())]
    return trees


@dataclass
class AdaBoostModel:
    kind: str
    trees: list = field(default_factory=list)
    alphas: list = field(default_factory=list)
    n_classes: int = 2

    def transform(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        """SAMME: class with the largest sum of tree weights voting for it.
        R2: weighted median of the tree predictions."""
        trees, alphas, classes = flat_trees(self.trees), np.array(self.alphas, float), self.n_classes
        half = sum(self.alphas) / 2.0
        votes_of = self.kind == "classification"

        @F.arrow_udf("double")
        def run(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.float64())
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            x, steps = np.where(np.isnan(x), np.inf, x), trees.steps()   # a missing number goes right, as in Spark's trees
            got = (trees.value[trees.walk(x, t, steps), 0] for t in range(len(alphas)))
            if votes_of:
                votes, row = np.zeros((len(x), classes)), np.arange(len(x))
                for p, a in zip(got, alphas):
                    votes[row, p.astype(int)] += a
                return pa.array(votes.argmax(1).astype(float))
            p = np.stack(list(got), 1)
            order = np.lexsort((np.broadcast_to(alphas, p.shape), p), axis=1)
            reached = np.cumsum(alphas[order], axis=1) >= half   # the first prediction with half of the weight
            at = np.take_along_axis(order, reached.argmax(1)[:, None], 1)
            return pa.array(np.take_along_axis(p, at, 1)[:, 0], mask=~reached.any(1))

        return df.withColumn(out, run(vector_to_array(features)))


def adaboost(train: DataFrame, kind: str, n_estimators: int = 200, learning_rate: float = 0.1,
             max_depth: int | None = None, features: str = "features", label: str = "label",
             n_classes: int = 2, seed: int = 42, weight: str | None = None) -> AdaBoostModel:
    """M14.  Classification: SAMME with depth-1 trees.  Regression: AdaBoost.R2
    (linear loss) with depth-3 trees fitted on the weights directly (no
    weighted resampling).  Stops early like the reference (error >= chance /
    average loss >= 0.5).  ``weight``: column with the number of rows a row stands for
    (classification)."""
    depth = max_depth or (1 if kind == "classification" else 3)
    data = cut_lineage(train.select(features, label, (F.col(weight) if weight else F.lit(1.0)).alias("_w")))
    n = data.agg(F.sum("_w")).first()[0] if weight else data.count()
    data = data.withColumn("_w", F.col("_w") / n)
    if kind == "classification":   # the number of classes is known: the tree needs no scan for it
        data = data.withMetadata(label, {"ml_attr": {"type": "nominal", "num_vals": n_classes}})
    model, held = AdaBoostModel(kind, n_classes=n_classes), None
    for m in range(n_estimators):
        if kind == "classification":
            est = DecisionTreeClassifier(maxDepth=depth, weightCol="_w", featuresCol=features, labelCol=label, seed=seed)
        else:
            est = DecisionTreeRegressor(maxDepth=depth, weightCol="_w", featuresCol=features, labelCol=label, seed=seed)
        tree = est.fit(data)
        pred, before = round_frame(tree, data, features, label), held
        held = pred
        if kind == "classification":
            wrong = (F.col("_p") != F.col(label)).cast("double")
            sums = pred.agg(F.sum(F.col("_w") * wrong).alias("bad"), F.sum("_w").alias("all")).first()
            err = sums["bad"] / sums["all"] if sums["all"] and sums["bad"] is not None else None
            if before is not None:
                before.unpersist()   # the sums have read the new frame whole
            if err is None or err >= 1 - 1.0 / n_classes:
                if not model.trees:   # at chance from the start: the first tree alone
                    model.trees, model.alphas = [tree], [1.0]
                break
            err = max(err, 1e-12)
            alpha = learning_rate * (math.log((1 - err) / err) + math.log(n_classes - 1))
            new_w = F.col("_w") * F.exp(F.lit(alpha) * wrong)
            tot = sums["all"] - sums["bad"] + sums["bad"] * math.exp(alpha)
        else:
            dev = F.abs(F.col("_p") - F.col(label))
            mx = pred.agg(F.max(dev)).first()[0] or 0.0
            if before is not None:
                before.unpersist()
            if mx == 0:
                model.trees.append(tree)
                model.alphas.append(1.0)
                break
            loss = dev / mx
            avg = pred.agg((F.sum(F.col("_w") * loss) / F.sum("_w")).alias("l")).first()["l"]
            if avg >= 0.5:
                if not model.trees:
                    model.trees, model.alphas = [tree], [1.0]
                break
            beta = max(avg / (1 - avg), 1e-12)
            alpha = learning_rate * math.log(1 / beta)
            new_w = F.col("_w") * F.pow(F.lit(beta), (1 - loss) * learning_rate)
        model.trees.append(tree)
        model.alphas.append(alpha)
        nxt = pred.select(features, label, new_w.alias("_w"))
        if kind != "classification":
            tot = nxt.agg(F.sum("_w")).first()[0]
        data = nxt.withColumn("_w", F.col("_w") / tot)
        if (m + 1) % CUT_EVERY == 0:
            data = cut_lineage(data)
            held.unpersist()
            held = None
    if held is not None:
        held.unpersist()
    return model
