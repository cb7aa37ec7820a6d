"""Trees on many rows (M12-M15): rows of equal cells as one weighted row.

Spark's trees cut a feature at no more than 31 places (``maxBins``) and read every
training row once or more for each level and tree.  Here features are first cut into a
grid of at most ``GRID`` cells each, much finer than those places (grid points are
quantiles of ``DRAWN`` rows chosen by hash, Spark's own places those of some 10,000
rows).  A value becomes the upper edge of its cell, in training and in prediction
alike.  Rows of equal cells and class are one row that weighs as many; for regression
rows of equal cells, with their mean label: gains of squared error and leaf means are
those of the single rows.  Every row is counted.  A table of at most ``PLAIN_ROWS``
rows is fitted row by row.

Only for learners that treat all rows alike: with subsampling a row's weight would
fall or stay as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.operators.saved import Saved
from tablelab.session import cut_lineage

PLAIN_ROWS = 1 << 20
GRID = 1024
DRAWN = 200_000
DRAWN_NUMBERS = 4_000_000   # rows times features that are drawn for the grid, at most
WEIGHT, SQUARES = "__weight", "__squares"


def fit_grid(rows: DataFrame, n: int) -> list[np.ndarray]:
    """Upper edges of each feature's cells, in order."""
    x = vector_to_array("features")
    width = len(rows.select(x.alias("x")).first()["x"])
    every = max(1, n // min(DRAWN, DRAWN_NUMBERS // max(1, width)))
    drawn = (rows.where(F.pmod(F.xxhash64(x, "label", F.lit(11)), F.lit(every)) == 0).select(x.alias("x"))
             .limit(2 * DRAWN_NUMBERS // max(1, width)).toArrow())   # twice what is meant, where rows repeat
    if not drawn.num_rows:
        drawn = rows.select(x.alias("x")).limit(1).toArrow()
    values = np.sort(drawn["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(drawn.num_rows, -1), axis=0)
    at = np.unique(np.linspace(0, len(values) - 1, GRID).astype(int))
    return [np.unique(c[at][~np.isnan(c[at])]) if not np.isnan(c[at]).all() else np.zeros(1) for c in values.T]


def codes(x: np.ndarray, grid: list[np.ndarray]) -> np.ndarray:
    """Cell of each value: the first whose upper edge is not below it (values above all: the last)."""
    out = np.empty(x.shape, np.uint16)
    for j, edges in enumerate(grid):
        out[:, j] = np.minimum(np.searchsorted(edges, x[:, j]), len(edges) - 1)
    return out


def edges_of(code: np.ndarray, grid: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([edges[code[:, j]] for j, edges in enumerate(grid)])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def gridded(df: DataFrame, grid: list[np.ndarray]) -> DataFrame:
    """``features`` with every value as the upper edge of its cell."""
    @F.arrow_udf("array<double>")
    def edge(x: pa.Array) -> pa.Array:
        return _lists(edges_of(codes(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(grid)), grid), grid))

    return df.withColumn("features", array_to_vector(edge(vector_to_array("features"))))


def grouped(rows: DataFrame, grid: list[np.ndarray], classes: bool) -> DataFrame:
    """features, label, weight: one row for rows of equal cells (and class), checkpointed; without
    classes the label is their mean, and the sum of squared labels is a column too."""
    width = len(grid)

    @F.arrow_udf("binary")
    def code(x: pa.Array) -> pa.Array:
        got = codes(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), grid)
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * width), len(got), [None, pa.py_buffer(got.tobytes())]).cast(pa.binary())

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint16).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([_lists(edges_of(got, grid)), *b.columns[1:]], names=["x", *b.schema.names[1:]])

    coded = rows.select(code(vector_to_array("features")).alias("c"), F.col("label").cast("double").alias("label"))
    if classes:
        sums = coded.groupBy("c", "label").agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
    else:
        sums = coded.groupBy("c").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias(WEIGHT),
                                      F.sum(F.col("label") * F.col("label")).alias(SQUARES))
    rest = [c for c in sums.columns if c != "c"]
    out = sums.select("c", *rest).mapInArrow(back, ", ".join(["x array<double>", *[f"{c} double" for c in rest]]))
    return cut_lineage(out.select(array_to_vector("x").alias("features"), *rest))


class CellTrees(Estimator):
    """A learner of trees with ``weightCol`` and without subsampling, on ``features`` and ``label``."""

    def __init__(self, learner, classes: int):
        super().__init__()
        self.learner, self.classes = learner, classes

    def _fit(self, dataset: DataFrame):
        n = dataset.count()
        if n <= PLAIN_ROWS:
            return self.learner.fit(dataset)
        rows = dataset.select("features", "label")
        grid = fit_grid(rows, n)
        data = grouped(rows, grid, self.classes > 0)
        if self.classes:   # known: the learner needs no scan for it, and every class keeps its place
            data = data.withMetadata("label", {"ml_attr": {"type": "nominal", "num_vals": self.classes}})
        learner = self.learner.copy().setWeightCol(WEIGHT)
        least = learner.getMinInstancesPerNode() if hasattr(learner, "getMinInstancesPerNode") else 1
        if least > 1:      # of rows, not of cells
            learner = learner.setMinInstancesPerNode(1).setMinWeightFractionPerNode(min(0.499, least / n))
        return CellStage(grid, learner.fit(data))


class CellStage(Saved):
    def __init__(self, grid: list[np.ndarray], model):
        super().__init__()
        self.grid, self.model = grid, model

    def __getattr__(self, name: str):
        if name == "featureImportances":
            return self.model.featureImportances
        raise AttributeError(name)

    def state(self) -> dict:
        return {"grid": [g.tolist() for g in self.grid]}

    def parts(self) -> list:
        return [PipelineModel([self.model])]

    @classmethod
    def restore(cls, state: dict, path: str) -> "CellStage":
        return cls([np.array(g) for g in state["grid"]], PipelineModel.load(f"{path}/parts/0").stages[0])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.model.transform(gridded(dataset.withColumn("__plain", F.col("features")), self.grid))
        return out.withColumn("features", F.col("__plain")).drop("__plain")
