"""Kernel machines (M17 SVR, M18 SVM) as pipeline stages on ``features``.

A kernel is made explicit by landmarks (Nystroem): the features of a row are its
kernel values with at most ``LANDMARKS`` training rows, chosen by hash (a bound of
the fit), turned by the inverse root of the landmarks' kernel matrix; directions
of negative eigenvalue (sigmoid) are left out.  The rows are written once as binary
blocks of ``BLOCK_ROWS`` with their plain features; every pass computes the kernel
values of a block anew, so the disk holds no more than the table, and turns weights
and gradient, which are small, instead of rows.

One solver serves all classes: its weight matrix has a row per class, so every
evaluation is one pass over the blocks for all of them.  Tasks send one binary
blob of summed loss and gradient, which are added in two levels; L-BFGS runs on
the driver, on numbers whose size depends on landmarks and classes only.

Losses: hinge against every other class and epsilon-insensitive absolute error,
both with a quadratic of ``SMOOTH`` width at their corner (residuals inside
epsilon have no gradient), and cross entropy, which turns margins into
probabilities (a logistic regression on the margins).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.operators.saved import Saved
from tablelab.session import cut_lineage, ended_together

LANDMARKS = 100
BLOCK_ROWS = 4096
CORE_BLOCKS = 32     # so many blocks a core are worth dealing anew
SMOOTH = 0.5
EPSILON = 0.1        # fixed value: default width of the tube without loss
DEGREE, COEF0 = 3, 0.0  # fixed values: default polynomial
DIRECT_PARTS = 64    # so many blobs are added by the driver itself


# ---------------------------------------------------------------- kernel features

def gamma_value(gamma, features: int, variance: float) -> float:
    """'scale' (1 / features / variance of all values), 'auto' (1 / features) or a number."""
    if gamma == "scale":
        return 1.0 / (features * variance) if variance > 0 else 1.0
    return 1.0 / features if gamma == "auto" else float(gamma)


def kernel_values(x: np.ndarray, z: np.ndarray, kernel: str, gamma: float) -> np.ndarray:
    dot = x @ z.T
    if kernel == "rbf":
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (z * z).sum(1) - 2 * dot, 0))
    if kernel == "poly":
        return (gamma * dot + COEF0) ** DEGREE
    if kernel == "sigmoid":
        return np.tanh(gamma * dot + COEF0)
    raise ValueError(f"unknown kernel {kernel!r}")


class KernelMap:
    """x -> kernel values with the landmarks times the inverse root; linear: x itself."""

    def __init__(self, kernel: str, gamma: float, landmarks: np.ndarray, root: np.ndarray | None = None):
        self.kernel, self.gamma, self.landmarks, self.root = kernel, gamma, landmarks, root
        if kernel != "linear" and root is None:
            value, vector = np.linalg.eigh(kernel_values(landmarks, landmarks, kernel, gamma))
            keep = value > 1e-8 * max(value.max(), 1e-300)
            self.root = vector[:, keep] / np.sqrt(value[keep])
        if kernel == "rbf":   # exponents of the kernel from (x, |x|^2, 1) in one product
            z = landmarks
            self.far = np.vstack([2 * gamma * z.T, np.full(len(z), -gamma), -gamma * (z * z).sum(1)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x if self.kernel == "linear" else self.values(x) @ self.root

    def values(self, x: np.ndarray) -> np.ndarray:
        """Before the turn: kernel values with the landmarks, or x itself."""
        if self.kernel == "rbf":
            k = np.column_stack([x, (x * x).sum(1), np.ones(len(x))]) @ self.far
            return np.exp(np.minimum(k, 0, out=k), out=k)
        return x if self.kernel == "linear" else kernel_values(x, self.landmarks, self.kernel, self.gamma)

    def turned(self, w: np.ndarray) -> np.ndarray:
        """Weights of mapped features as weights of ``values`` (the last column, of ones, stays)."""
        return w if self.kernel == "linear" else np.hstack([w[:, :-1] @ self.root.T, w[:, -1:]])

    def turned_back(self, g: np.ndarray) -> np.ndarray:
        """Gradient by weights of ``values`` as gradient by weights of mapped features."""
        return g if self.kernel == "linear" else np.hstack([g[:, :-1] @ self.root, g[:, -1:]])

    @property
    def width(self) -> int:
        return self.root.shape[1] if self.root is not None else self.landmarks.shape[1]

    def state(self) -> dict:
        return {"kernel": self.kernel, "gamma": self.gamma, "landmarks": self.landmarks.tolist(),
                "root": None if self.root is None else self.root.tolist()}

    @classmethod
    def of(cls, s: dict) -> "KernelMap":
        return cls(s["kernel"], s["gamma"], np.array(s["landmarks"]), None if s["root"] is None else np.array(s["root"]))


def fit_map(rows: DataFrame, kernel: str, gamma) -> KernelMap:
    """``rows`` has a vector column ``features``."""
    s = rows.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).first()["s"]
    mean, n = s["mean"].toArray(), s["count"]
    variance = float((s["variance"].toArray() * (n - 1) / max(n, 1)).mean() + mean.var())
    x = vector_to_array("features")
    drawn = rows.select(x.alias("x")).orderBy(F.xxhash64("x"), "x").limit(3 * LANDMARKS).collect()
    some = np.array(list(dict.fromkeys(tuple(r["x"]) for r in drawn))[:LANDMARKS])
    return KernelMap(kernel, gamma_value(gamma, len(mean), variance), some)


# ------------------------------------------------------------------------- solver

def feature_blocks(rows: DataFrame) -> DataFrame:
    """n, x, y: blocks of features and labels (checkpointed), dealt anew if there are many and
    their tasks would not end together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                x = np.nan_to_num(part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)]), pa.array([x.tobytes()], pa.binary()),
                     pa.array([part.column(1).to_numpy(zero_copy_only=False).astype(float).tobytes()], pa.binary())], names=["n", "x", "y"])

    out = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    blocks = cut_lineage(ended_together(out.mapInArrow(run, "n long, x binary, y binary"), rows, CORE_BLOCKS * BLOCK_ROWS))
    parts = max(1, blocks.count())  # tasks without a block only cost time
    return blocks.coalesce(parts) if parts < blocks.rdd.getNumPartitions() else blocks


def hinge(s: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """All classes against the rest at once (one column: class 1 against 0)."""
    t = np.where(y[:, None] == (np.arange(s.shape[1]) if s.shape[1] > 1 else [1]), 1.0, -1.0)
    gap = np.maximum(1 - t * s, 0)
    near = gap < SMOOTH
    loss = np.where(near, gap * gap / (2 * SMOOTH), gap - SMOOTH / 2)
    return float(loss.sum()), -t * np.where(near, gap / SMOOTH, 1.0)


def tube(epsilon: float, width: float):
    def loss(s: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        r = s[:, 0] - y
        over = np.maximum(np.abs(r) - epsilon, 0)
        near = over < width
        value = np.where(near, over * over / (2 * width), over - width / 2)
        return float(value.sum()), (np.sign(r) * np.where(near, over / width, 1.0))[:, None]
    return loss


def cross_entropy(s: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    p = softmax(s)
    at = np.arange(len(s)), y.astype(int)
    value = -np.log(np.maximum(p[at], 1e-300)).sum()
    p[at] -= 1
    return float(value), p


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def summed_blobs(blobs: DataFrame, size: int, merge=np.add, zero: float = 0.0) -> np.ndarray:
    """Sum (or other merge) of the float64 vectors in the binary column ``b``, in two levels."""
    def add(batches):
        total = np.full(size, zero)
        for batch in batches:
            for v in batch.column(0):
                merge(total, np.frombuffer(v.as_buffer()), out=total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["b"])

    parts = blobs.rdd.getNumPartitions()
    if parts > DIRECT_PARTS:
        blobs = blobs.repartition(int(parts ** 0.5) + 1).mapInArrow(add, "b binary")
    return merge.reduce([np.frombuffer(r["b"]) for r in blobs.collect()] or [np.full(size, zero)], axis=0)


def evaluate(blocks: DataFrame, w: np.ndarray, loss, mapped: KernelMap) -> tuple[float, np.ndarray]:
    """Summed loss and gradient for the weights (outputs x mapped features and one): one pass."""
    turned = mapped.turned(w)

    def run(batches):
        total, grad = 0.0, np.zeros_like(turned)
        for b in batches:
            for n, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                x = mapped.values(np.frombuffer(x.as_buffer()).reshape(n, -1))
                value, slope = loss(x @ turned[:, :-1].T + turned[:, -1], np.frombuffer(y.as_buffer()))
                total += value
                grad[:, :-1] += slope.T @ x
                grad[:, -1] += slope.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(grad.ravel(), total).tobytes()], pa.binary())], names=["b"])

    got = summed_blobs(blocks.mapInArrow(run, "b binary"), turned.size + 1)
    return float(got[-1]), mapped.turned_back(got[:-1].reshape(turned.shape))


def minimise(blocks: DataFrame, loss, outputs: int, mapped: KernelMap, penalty: float, max_iter: int = 40, tol: float = 1e-4,
             start: np.ndarray | None = None) -> np.ndarray:
    """L-BFGS on mean loss + penalty / 2 * |weights without the last column|^2."""
    n = blocks.agg(F.sum("n")).first()[0] or 1
    width = mapped.width + 1
    free = np.ones((outputs, width))
    free[:, -1] = 0

    def value(w):
        f, g = evaluate(blocks, w, loss, mapped)
        return f / n + penalty / 2 * float((free * w * w).sum()), g / n + penalty * free * w

    w = np.zeros((outputs, width)) if start is None else start
    f, g = value(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(g).max() < 1e-6:
            break
        d, a = -g, []
        for s, y in reversed(steps):
            a.append((s * d).sum() / (s * y).sum())
            d = d - a[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * (s * y).sum() / (y * y).sum()
        else:
            d = d / max(1.0, np.abs(g).sum())
        for (s, y), k in zip(steps, reversed(a)):
            d = d + (k - (y * d).sum() / (s * y).sum()) * s
        slope, size, old = float((g * d).sum()), 1.0, f
        while True:
            new = w + size * d
            f, h = value(new)
            if f <= old + 1e-4 * size * slope or size < 1e-4:
                break
            size /= 2
        if f > old:
            break
        if ((new - w) * (h - g)).sum() > 1e-12:
            steps = [*steps[-9:], (new - w, h - g)]
        w, g = new, h
        if old - f <= tol * max(abs(old), 1e-12):
            break
    return w


# ------------------------------------------------------------------------- stages

class KernelSVM(Estimator):
    """Features, label -> rawPrediction (margins), probability, prediction."""

    def __init__(self, n_classes: int, c: float = 1.0, kernel: str = "rbf", gamma="scale"):
        super().__init__()
        self.n_classes, self.c, self.kernel, self.gamma = n_classes, c, kernel, gamma

    def _fit(self, dataset: DataFrame) -> "KernelSVMStage":
        rows = dataset.select("features", "label")
        mapped = fit_map(rows, self.kernel, self.gamma)
        blocks = feature_blocks(rows)
        n = blocks.agg(F.sum("n")).first()[0] or 1
        outputs = self.n_classes if self.n_classes > 2 else 1
        w = minimise(blocks, hinge, outputs, mapped, 1.0 / (self.c * n))
        plain = KernelMap("linear", 0.0, np.zeros((1, outputs)))
        platt = minimise(_margin_blocks(blocks, w, mapped), cross_entropy, self.n_classes, plain, 1e-3, max_iter=15)
        return KernelSVMStage(mapped, w, platt)


def _margin_blocks(blocks: DataFrame, w: np.ndarray, mapped: KernelMap) -> DataFrame:
    """Blocks of the margins (checkpointed)."""
    turned = mapped.turned(w)

    def run(batches):
        for b in batches:
            for n, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                s = mapped.values(np.frombuffer(x.as_buffer()).reshape(n, -1)) @ turned[:, :-1].T + turned[:, -1]
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()], pa.binary()),
                                                  pa.array([y.as_py()], pa.binary())], names=["n", "x", "y"])
    return cut_lineage(blocks.mapInArrow(run, "n long, x binary, y binary"))


def _rows(x: pd.Series) -> np.ndarray:
    return np.nan_to_num(np.stack(x.to_numpy()))


class KernelSVMStage(Saved):
    def __init__(self, mapped: KernelMap, w: np.ndarray, platt: np.ndarray):
        super().__init__()
        self.mapped, self.w, self.platt = mapped, w, platt

    def state(self) -> dict:
        return {"map": self.mapped.state(), "w": self.w.tolist(), "platt": self.platt.tolist()}

    @classmethod
    def restore(cls, s: dict, path: str) -> "KernelSVMStage":
        return cls(KernelMap.of(s["map"]), np.array(s["w"]), np.array(s["platt"]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mapped, w, platt = self.mapped, self.w, self.platt
        k = len(platt)

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = mapped(_rows(x))
            s = np.hstack([m, np.ones((len(m), 1))]) @ w.T
            p = softmax(np.hstack([s, np.ones((len(s), 1))]) @ platt.T)
            raw = s if k > 2 else np.hstack([-s, s])
            return pd.Series(list(np.hstack([raw, p])))

        both, p = F.col("__scores"), F.slice("__scores", k + 1, k)
        return (dataset.withColumn("__scores", scores(vector_to_array("features")))
                .withColumn("rawPrediction", array_to_vector(F.slice(both, 1, k))).withColumn("probability", array_to_vector(p))
                .withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double")).drop("__scores"))


class KernelSVR(Estimator):
    """Features, label -> prediction."""

    def __init__(self, c: float = 1.0, kernel: str = "rbf", gamma="scale", epsilon: float = EPSILON):
        super().__init__()
        self.c, self.kernel, self.gamma, self.epsilon = c, kernel, gamma, epsilon

    def _fit(self, dataset: DataFrame) -> "KernelSVRStage":
        rows = dataset.select("features", "label")
        mapped = fit_map(rows, self.kernel, self.gamma)
        blocks = feature_blocks(rows)
        r = rows.agg(F.count("*").alias("n"), F.avg("label").alias("m"), F.stddev_pop("label").alias("s")).first()
        start = np.zeros((1, mapped.width + 1))
        start[0, -1] = r["m"] or 0.0
        # the quadratic corner is a twentieth of the label's deviation at most
        corner = max(1e-3, 0.05 * (r["s"] or 0.0))
        w = minimise(blocks, tube(self.epsilon, corner), 1, mapped, 1.0 / (self.c * max(r["n"], 1)), start=start)
        return KernelSVRStage(mapped, w)


class KernelSVRStage(Saved):
    def __init__(self, mapped: KernelMap, w: np.ndarray):
        super().__init__()
        self.mapped, self.w = mapped, w

    def state(self) -> dict:
        return {"map": self.mapped.state(), "w": self.w.tolist()}

    @classmethod
    def restore(cls, s: dict, path: str) -> "KernelSVRStage":
        return cls(KernelMap.of(s["map"]), np.array(s["w"]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mapped, w = self.mapped, self.w

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            m = mapped(_rows(x))
            return pd.Series((np.hstack([m, np.ones((len(m), 1))]) @ w.T)[:, 0])

        return dataset.withColumn("prediction", predict(vector_to_array("features")))
