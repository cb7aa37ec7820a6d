"""Pipeline stages that ``pyspark.ml`` lacks, for use inside a ``Pipeline``:
AdaBoost as an estimator with saved state."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame

from tablelab.operators.ensemble import AdaBoostModel, adaboost
from tablelab.operators.saved import Saved


# -------------------------------------------------------------------- AdaBoost

class AdaBoost(Estimator):
    """M14 as an estimator on ``features`` and ``label``."""

    def __init__(self, kind: str, n_estimators: int = 200, learning_rate: float = 0.1, n_classes: int = 2):
        super().__init__()
        self.kind, self.n_estimators, self.learning_rate, self.n_classes = kind, n_estimators, learning_rate, n_classes
        self.weight: str | None = None

    def setWeightCol(self, name: str) -> "AdaBoost":
        """Rows that stand for as many rows each (classification)."""
        self.weight = name
        return self

    def _fit(self, dataset: DataFrame) -> "AdaBoostStage":
        return AdaBoostStage(adaboost(dataset, self.kind, self.n_estimators, self.learning_rate, n_classes=self.n_classes,
                                      weight=self.weight))


class AdaBoostStage(Saved):
    def __init__(self, model: AdaBoostModel):
        super().__init__()
        self.model = model

    def state(self) -> dict:
        return {"kind": self.model.kind, "alphas": self.model.alphas, "n_classes": self.model.n_classes}

    def parts(self) -> list:
        return self.model.trees

    @classmethod
    def restore(cls, state: dict, path: str) -> "AdaBoostStage":
        tree = DecisionTreeClassificationModel if state["kind"] == "classification" else DecisionTreeRegressionModel
        trees = [tree.load(f"{path}/parts/{i}") for i in range(len(state["alphas"]))]
        return cls(AdaBoostModel(state["kind"], trees, state["alphas"], state["n_classes"]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset)
