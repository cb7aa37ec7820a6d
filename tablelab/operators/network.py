"""Feed-forward networks (A1-A4, M19) as pipeline stages on ``features`` and
``label``.

Training is synchronous model averaging.  The rows are written once as binary
blocks.  In an epoch every task starts from the same weights and optimiser state,
runs mini-batches over its own blocks, and sends one binary blob: weights and
state times its rows, losses and counts.  Blobs are added in two levels and
divided by the rows, so the driver handles numbers whose size depends on the
layers only.  On one task this is ordinary mini-batch training.

A hash of the row deals the held-out fold; its loss with the weights of an
epoch's start is measured in the same pass.  That loss drives early stopping,
halving of the learning rate on a plateau, and the choice of the weights that
are kept (:class:`Callbacks`).  The head follows from the target: linear with
squared error, sigmoid or softmax with cross entropy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.operators.kernel import softmax, summed_blobs
from tablelab.operators.saved import Saved
from tablelab.session import cut_lineage, ended_together

BLOCK_ROWS = 4096
CORE_BLOCKS = 32
BN_EPS, BN_KEEP = 1e-3, 0.99   # fixed values: usual constants of batch normalisation
FOLD = 1 << 20


@dataclass
class Options:
    hidden: list[int]
    dropout: list[float]
    activation: str = "relu"
    optimizer: str = "adamw"
    learning_rate: float = 1e-3
    weight_decay: float = 4e-3
    l2: float = 1e-3
    batch_norm: bool = True
    epochs: int = 150
    batch_size: int | None = None      # None: batch_rule
    validation: float = 0.2
    patience: int = 20
    lr_patience: int = 7
    min_lr: float = 1e-7
    seed: int = 42


def batch_rule(rows: int) -> int:
    return min(64, max(16, rows // 32))


def head_of(problem: str, n_classes: int) -> str:
    """A1: linear for numbers, sigmoid for two classes, softmax for more."""
    return "linear" if problem == "regression" else "sigmoid" if n_classes <= 2 else "softmax"


@dataclass
class Callbacks:
    """Early stop after ``patience`` epochs without a smaller loss; the rate halves
    after ``lr_patience`` epochs without one smaller by 1e-4; ``improved`` says
    that the loss just given is the smallest so far."""
    lr: float
    patience: int = 20
    lr_patience: int = 7
    min_lr: float = 1e-7
    best: float = float("inf")
    waited: int = 0
    improved: bool = False
    plateau_best: float = float("inf")
    plateau_waited: int = 0

    def epoch(self, loss: float) -> bool:
        """True: go on."""
        self.improved = loss < self.best
        self.best, self.waited = (loss, 0) if self.improved else (self.best, self.waited + 1)
        if loss < self.plateau_best - 1e-4:
            self.plateau_best, self.plateau_waited = loss, 0
        else:
            self.plateau_waited += 1
            if self.plateau_waited >= self.lr_patience:
                self.lr, self.plateau_waited = max(self.lr * 0.5, self.min_lr), 0
        return self.waited < self.patience


# --------------------------------------------------------------------- the network

ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0), lambda z, a: (z > 0).astype(float)),
    "tanh": (np.tanh, lambda z, a: 1 - a * a),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda z, a: a * (1 - a)),
    "elu": (lambda z: np.where(z > 0, z, np.expm1(np.minimum(z, 0))), lambda z, a: np.where(z > 0, 1, a + 1)),
    "selu": (lambda z: 1.0507009873554805 * np.where(z > 0, z, 1.6732632423543772 * np.expm1(np.minimum(z, 0))),
             lambda z, a: np.where(z > 0, 1.0507009873554805, a + 1.0507009873554805 * 1.6732632423543772)),
}


@dataclass
class Net:
    """Layers as views into one vector ``theta``: weights, bias and, for hidden
    layers with batch normalisation, scale, shift and running mean and variance."""
    sizes: list[int]
    head: str
    options: Options
    theta: np.ndarray | None = None
    parts: list[dict] = field(default_factory=list)

    def __post_init__(self):
        shapes, bn = [], self.options.batch_norm
        for i, (a, b) in enumerate(zip(self.sizes, self.sizes[1:])):
            layer = {"w": (a, b), "b": (b,)}
            if bn and i < len(self.sizes) - 2:
                layer |= {"scale": (b,), "shift": (b,), "mean": (b,), "var": (b,)}
            shapes.append(layer)
        size = sum(int(np.prod(s)) for layer in shapes for s in layer.values())
        fresh = self.theta is None
        self.theta = np.zeros(size) if fresh else np.array(self.theta, float)
        self.decayed, self.trained, at = np.zeros(size, bool), np.ones(size, bool), 0
        rng = np.random.RandomState(self.options.seed)
        self.parts = []
        for layer in shapes:
            views = {}
            for name, shape in layer.items():
                n = int(np.prod(shape))
                views[name] = self.theta[at:at + n].reshape(shape)
                self.decayed[at:at + n] = name == "w"
                self.trained[at:at + n] = name not in ("mean", "var")
                if fresh and name == "w":
                    views[name][:] = rng.uniform(-1, 1, shape) * np.sqrt(6 / sum(shape))
                elif fresh and name in ("scale", "var"):
                    views[name][:] = 1
                at += n
            self.parts.append(views)
        hidden = self.decayed.copy()
        hidden[-(self.parts[-1]["w"].size + self.parts[-1]["b"].size):] = False  # penalty on hidden weights
        self.penalty, self.slopes, self.spaces = 2 * self.options.l2 * hidden, None, {}

    def forward(self, x: np.ndarray, rng=None) -> tuple[np.ndarray, list]:
        """Scores before the head's function, and what the backward pass needs."""
        act, kept = ACTIVATIONS[self.options.activation][0], []
        for i, p in enumerate(self.parts):
            z = x @ p["w"] + p["b"]
            if i == len(self.parts) - 1:
                return z, [*kept, (x,)]
            hat = spread = None
            if "scale" in p:
                mean = np.add.reduce(z) / len(z) if rng is not None else p["mean"]
                off = z - mean
                var = np.add.reduce(off * off) / len(z) if rng is not None else p["var"]
                spread = np.sqrt(var + BN_EPS)
                hat = off / spread
                if rng is not None:
                    p["mean"] += (1 - BN_KEEP) * (mean - p["mean"])
                    p["var"] += (1 - BN_KEEP) * (var - p["var"])
                z = hat * p["scale"] + p["shift"]
            a, rate = act(z), self.options.dropout[i]
            drop = (rng.random_sample(a.shape) >= rate) / (1 - rate) if rng is not None and rate > 0 else None
            kept.append((x, z, a, hat, spread, drop))
            x = a if drop is None else a * drop
        return x, kept

    def output(self, x: np.ndarray) -> np.ndarray:
        z = self.forward(x)[0]
        return z if self.head == "linear" else softmax(z) if self.head == "softmax" else ACTIVATIONS["sigmoid"][0](z)

    def loss(self, z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed loss and its slope by the scores."""
        if self.head == "linear":
            r = z[:, 0] - y
            return float((r * r).sum()), 2 * r[:, None]
        if self.head == "sigmoid":
            p, s = ACTIVATIONS["sigmoid"][0](z[:, 0]), z[:, 0]
            return float((np.logaddexp(0, s) - y * s).sum()), (p - y)[:, None]
        p, at = softmax(z), (np.arange(len(z)), y.astype(int))
        value = -np.log(np.maximum(p[at], 1e-300)).sum()
        p[at] -= 1
        return float(value), p

    def space(self, n: int) -> list[dict]:
        """Places for the numbers of a batch of ``n`` rows, per hidden layer; batches write them over."""
        if n not in self.spaces:
            if len(self.spaces) > 8:
                self.spaces.clear()
            self.spaces[n] = [{name: np.empty((n, width)) for name in ("z", "hat", "tmp", "a", "drop", "x", "delta")} |
                              {"on": np.empty((n, width), bool)} for width in self.sizes[1:-1]]
        return self.spaces[n]

    def forward_batch(self, x: np.ndarray, rng, places: list[dict]) -> tuple[np.ndarray, list]:
        """``forward`` of a training batch in the batch's places: the same numbers."""
        act, relu, n, kept = ACTIVATIONS[self.options.activation][0], self.options.activation == "relu", len(x), []
        for i, (p, s) in enumerate(zip(self.parts, places)):
            z = np.matmul(x, p["w"], out=s["z"])
            z += p["b"]
            hat = spread = None
            if "scale" in p:
                mean = np.add.reduce(z) / n
                hat = np.subtract(z, mean, out=s["hat"])
                var = np.add.reduce(np.multiply(hat, hat, out=s["tmp"])) / n
                spread = np.sqrt(var + BN_EPS)
                hat /= spread
                p["mean"] += (1 - BN_KEEP) * (mean - p["mean"])
                p["var"] += (1 - BN_KEEP) * (var - p["var"])
                np.multiply(hat, p["scale"], out=z)
                z += p["shift"]
            a, rate, drop = np.maximum(z, 0, out=s["a"]) if relu else act(z), self.options.dropout[i], None
            if rate > 0:
                np.greater_equal(rng.random_sample(a.shape), rate, out=s["on"])
                drop = np.multiply(s["on"], 1 / (1 - rate), out=s["drop"])
            kept.append((x, z, a, hat, spread, drop))
            x = a if drop is None else np.multiply(a, drop, out=s["x"])
        p = self.parts[-1]
        return x @ p["w"] + p["b"], [*kept, (x,)]

    def gradient(self, x: np.ndarray, y: np.ndarray, rng) -> tuple[float, np.ndarray]:
        """Mean loss of a batch (without penalty) and gradient with it."""
        places, n = self.space(len(x)), len(x)
        z, kept = self.forward_batch(x, rng, places) if rng is not None else self.forward(x)
        value, slope = self.loss(z, y)
        if self.slopes is None:   # made once: every batch writes the same places
            self.slopes = Net(self.sizes, self.head, self.options, np.zeros_like(self.theta))
        delta, grad = slope / n, self.slopes
        slope_of, relu = ACTIVATIONS[self.options.activation][1], self.options.activation == "relu"
        for i in range(len(self.parts) - 1, -1, -1):
            p, g = self.parts[i], grad.parts[i]
            if i < len(self.parts) - 1:
                _, pre, a, hat, spread, drop = kept[i]
                s = places[i]
                if drop is not None:
                    delta *= drop
                delta *= np.greater(pre, 0, out=s["on"]) if relu else slope_of(pre, a)
                if hat is not None:
                    np.add.reduce(np.multiply(delta, hat, out=s["tmp"]), out=g["scale"]), np.add.reduce(delta, out=g["shift"])
                    delta *= p["scale"]
                    off = np.add.reduce(delta) / n
                    along = np.add.reduce(np.multiply(delta, hat, out=s["tmp"])) / n
                    delta -= off
                    delta -= np.multiply(hat, along, out=s["tmp"])
                    delta /= spread
            inputs = kept[i][0]
            np.matmul(inputs.T, delta, out=g["w"])
            np.add.reduce(delta, out=g["b"])
            if i:
                delta = np.matmul(delta, p["w"].T, out=places[i - 1]["delta"])
        total = self.penalty * self.theta
        total += grad.theta
        return value / n, total


class Optimizer:
    """Adam(W), RMSprop or SGD with momentum on one vector; ``state`` is two
    vectors, so states of several tasks can be averaged."""

    def __init__(self, kind: str, decay: float, state: np.ndarray, step: int):
        self.kind, self.decay, self.state, self.t = kind, decay, state, step
        self.tmp, self.own = np.empty((2, state.shape[-1])), None

    def update(self, net: Net, g: np.ndarray, lr: float) -> None:
        self.t += 1
        m, v, keep = self.state[0], self.state[1], net.trained
        if self.kind == "sgd":
            m[:] = 0.9 * m - lr * g
            net.theta += keep * m
            return
        if self.kind == "rmsprop":
            v[:] = 0.9 * v + 0.1 * g * g
            net.theta -= keep * lr * g / (np.sqrt(v) + 1e-7)
            return
        if self.own is None or self.own[0] != lr:   # rates by place of theta, made once a rate
            self.own = lr, keep * lr, lr * self.decay * net.decayed
        step, root = self.tmp
        m *= 0.9
        m += np.multiply(0.1, g, out=step)
        v *= 0.999
        np.multiply(0.001, g, out=step)
        step *= g
        v += step
        np.divide(m, 1 - 0.9 ** self.t, out=step)
        step *= self.own[1]
        np.sqrt(np.divide(v, 1 - 0.999 ** self.t, out=root), out=root)
        root += 1e-7
        step /= root
        net.theta -= step
        if self.kind == "adamw":
            net.theta -= np.multiply(self.own[2], net.theta, out=step)


# -------------------------------------------------------------------------- stages

def network_blocks(rows: DataFrame, validation: float) -> DataFrame:
    """n, held, x, y: blocks of training and of held-out rows (checkpointed).  Where every
    core has ``CORE_BLOCKS`` of them or more and its tasks would not end together, they are
    dealt anew, a task for each core: epochs wait for their last task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                x = np.nan_to_num(part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                y = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                held = part.column(2).to_numpy(zero_copy_only=False)
                for flag in (False, True):
                    at = held == flag
                    if at.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(at.sum())]), pa.array([flag]), pa.array([x[at].tobytes()], pa.binary()),
                             pa.array([y[at].tobytes()], pa.binary())], names=["n", "held", "x", "y"])

    x = vector_to_array("features")
    out = rows.select(x.alias("x"), F.col("label").cast("double").alias("y"),
                      (F.pmod(F.xxhash64(x, "label", F.lit(5)), F.lit(FOLD)) < int(validation * FOLD)).alias("held"))
    blocks = out.mapInArrow(run, "n long, held boolean, x binary, y binary")
    return cut_lineage(ended_together(blocks, rows, CORE_BLOCKS * BLOCK_ROWS))


def run_epoch(blocks: DataFrame, net: Net, state: np.ndarray, steps: int, batch: int, lr: float, epoch: int):
    """One pass: (averaged weights, averaged state, mean training loss, mean held-out loss at the start)."""
    o, theta, size = net.options, net.theta, len(net.theta)

    def run(batches):
        start = Net(net.sizes, net.head, o, theta)
        own, opt = Net(net.sizes, net.head, o, theta), Optimizer(o.optimizer, o.weight_decay, state.copy(), steps)
        rng = np.random.RandomState([o.seed, epoch, TaskContext.get().partitionId()])
        rows = held = 0
        loss = lost = 0.0
        for b in batches:
            for n, flag, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer()).reshape(n, -1), np.frombuffer(y.as_buffer())
                if flag:
                    lost += start.loss(start.forward(x)[0], y)[0]
                    held += n
                    continue
                order = rng.permutation(n)
                for lo in range(0, n, batch):
                    at = order[lo:lo + batch]
                    value, g = own.gradient(x[at], y[at], rng)
                    opt.update(own, g, lr)
                    loss += value * len(at)
                rows += n
        blob = np.concatenate([own.theta * rows, opt.state.ravel() * rows, [rows, loss, held, lost, opt.t * rows]])
        yield pa.RecordBatch.from_arrays([pa.array([blob.tobytes()], pa.binary())], names=["b"])

    got = summed_blobs(blocks.mapInArrow(run, "b binary"), 3 * size + 5)
    rows, loss, held, lost, t = got[3 * size:]
    n = max(rows, 1.0)
    return got[:size] / n, got[size:3 * size].reshape(2, size) / n, loss / n, (lost / held if held else None), round(t / n)


class Network(Estimator):
    def __init__(self, problem: str, n_classes: int, options: Options):
        super().__init__()
        if options.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {options.activation!r}")
        self.problem, self.n_classes, self.options = problem, n_classes, options

    def _fit(self, dataset: DataFrame) -> "NetworkStage":
        o, head = self.options, head_of(self.problem, self.n_classes)
        blocks = network_blocks(dataset.select("features", "label"), o.validation)
        sizes = {r["held"]: r["n"] for r in blocks.groupBy("held").agg(F.sum("n").alias("n")).collect()}
        blocks = blocks.coalesce(max(1, min(blocks.rdd.getNumPartitions(), -(-sizes.get(False, 0) // BLOCK_ROWS))))
        width = len(dataset.select(vector_to_array("features").alias("x")).first()["x"])
        net = Net([width, *o.hidden, self.n_classes if head == "softmax" else 1], head, o)
        rows = sizes.get(False, 0)
        batch = o.batch_size or batch_rule(rows)
        watch = Callbacks(o.learning_rate, o.patience, o.lr_patience, o.min_lr)
        state, steps, history, kept = np.zeros((2, len(net.theta))), 0, [], net.theta.copy()
        pending = None   # training loss and rate of the epoch whose weights are measured next
        for epoch in range(1, o.epochs + 2):
            theta, new_state, loss, held, t = run_epoch(blocks, net, state, steps, batch, watch.lr, epoch)
            if pending is not None:
                measured = held if held is not None else pending[0]
                history.append((epoch - 1, pending[0], measured, pending[1]))
                go_on = watch.epoch(measured)
                if watch.improved:
                    kept = net.theta.copy()
                if not go_on or epoch > o.epochs:
                    break
            pending = (loss, watch.lr)
            net, state, steps = Net(net.sizes, head, o, theta), new_state, t
        return NetworkStage(net.sizes, head, o, kept, history)


class NetworkStage(Saved):
    def __init__(self, sizes: list[int], head: str, options: Options, theta: np.ndarray, history: list):
        super().__init__()
        self.sizes, self.head, self.options, self.theta, self.history = sizes, head, options, theta, history

    def state(self) -> dict:
        return {"sizes": self.sizes, "head": self.head, "options": asdict(self.options), "theta": self.theta.tolist(),
                "history": self.history}

    @classmethod
    def restore(cls, s: dict, path: str) -> "NetworkStage":
        return cls(s["sizes"], s["head"], Options(**s["options"]), np.array(s["theta"]), [tuple(h) for h in s["history"]])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        net = Net(self.sizes, self.head, self.options, self.theta)

        @F.pandas_udf("array<double>")
        def forward(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            out = net.output(np.nan_to_num(np.stack(x.to_numpy()).astype(float)))
            return pd.Series(list(np.hstack([1 - out, out]) if net.head == "sigmoid" else out))

        out = dataset.withColumn("__out", forward(vector_to_array("features")))
        if self.head == "linear":
            return out.withColumn("prediction", F.col("__out")[0]).drop("__out")
        return (out.withColumn("probability", array_to_vector("__out"))
                .withColumn("prediction", (F.array_position("__out", F.array_max("__out")) - 1).cast("double")).drop("__out"))
