"""Trees grown from aggregates: extremely randomised forests (M12) and leaf-wise
boosting on binned features (M21), as pipeline stages on ``features``, ``label``.

Rows are written once as binary blocks.  A pass over the blocks lets every row walk
the trees as far as they are grown and adds up numbers per open node; each task
sends one binary blob, and blobs are merged in two levels.  What reaches the driver
depends on trees, nodes, features and bins, not on rows.

* **Extra trees**: all trees of the forest grow together, a level at a time.  One pass
  gives the range of each feature in each open node; the driver draws, per node and
  tree, features and one threshold each within the node's own range; a second pass
  gives the statistics left of every drawn threshold, and the best is taken.  Many
  open nodes are dealt to several passes of ``PASS_NUMBERS`` numbers.  A forest stops
  growing at ``MAX_NODES`` nodes, its largest ones first (a bound of the model).
* **Leaf-wise boosting**: features are cut into at most ``BINS`` bins by quantiles.
  Rows of equal bins have equal scores, so they are grouped into one weighted row (by
  class too, or with their mean label) before the first pass.
  A round grows one tree per output by best gain first up to ``num_leaves``.  A pass
  collects (node, feature, bin) sums of gradient, curvature and rows for the children of
  every leaf that could still be split, so a round takes about as many passes as the
  tree is deep, and the tree is the one that splitting leaf by leaf gives.  Scores of
  the rows are written every ``KEPT_ROUNDS`` rounds; rounds since then are walked.

Blocks and scores lie in the checkpoint folder, so any task can be run again.
Null features count as 0 (pipelines impute before); without rows a fit raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelab.operators import cells as CE
from tablelab.operators.kernel import softmax, summed_blobs
from tablelab.operators.saved import Saved
from tablelab.session import cut_lineage

BLOCK_ROWS = 8192
PASS_NUMBERS = 2_000_000
MAX_NODES = 4_000_000
BINS = 255
KEPT_ROUNDS = 10
MIN_CHILD_ROWS, MIN_CHILD_CURVATURE = 20, 1e-3   # fixed values: smallest leaf of a boosted tree


class Trees:
    """Nodes of several trees in flat arrays; the first ``roots`` nodes are the roots.
    A leaf has feature -1; the right child follows the left one."""

    def __init__(self, roots: int, outputs: int):
        self.feature, self.left = np.full(roots, -1, np.int32), np.zeros(roots, np.int32)
        self.cut, self.value = np.zeros(roots), np.zeros((roots, outputs))

    def split(self, nodes: np.ndarray, features: np.ndarray, cuts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Give ``nodes`` children with these values; numbers of the left ones."""
        at = len(self.feature) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.left[nodes] = features, cuts, at
        new = 2 * len(nodes)
        self.feature = np.concatenate([self.feature, np.full(new, -1, np.int32)])
        self.left = np.concatenate([self.left, np.zeros(new, np.int32)])
        self.cut = np.concatenate([self.cut, np.zeros(new)])
        self.value = np.concatenate([self.value, np.stack([left, right], 1).reshape(new, self.value.shape[1])])
        return at

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, cut and left child of every node for walking; a leaf leads to itself."""
        leaf = self.feature < 0
        return (np.where(leaf, 0, self.feature).astype(np.intp), np.where(leaf, np.inf, self.cut),
                np.where(leaf, np.arange(len(leaf)), self.left).astype(np.intp))

    def walk(self, x: np.ndarray, root: int, steps: tuple | None = None) -> np.ndarray:
        """Leaf of each row of ``x`` below ``root``: left where the value is at most the cut."""
        feature, cut, left = steps or self.steps()
        at, flat, first = np.full(len(x), root, np.intp), x.ravel(), np.arange(len(x)) * x.shape[1]
        while True:
            to = left.take(at) + (flat.take(first + feature.take(at)) > cut.take(at))
            if np.array_equal(to, at):
                return at
            at = to

    def total(self, x: np.ndarray, roots: int) -> np.ndarray:
        """Sum over the trees of the values of each row's leaf."""
        out, steps = np.zeros((len(x), self.value.shape[1])), self.steps()
        for r in range(roots):
            out += self.value[self.walk(x, r, steps)]
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame({
            "node": np.arange(len(self.feature)), "feature": self.feature, "cut": self.cut, "left": self.left,
            "value": list(self.value)}), "node long, feature int, cut double, left int, value array<double>")

    @classmethod
    def of(cls, path: str) -> "Trees":
        pdf = SparkSession.getActiveSession().read.parquet(path).toPandas().sort_values("node")   # at most the model's bound
        out = cls(0, 0)
        out.feature, out.cut, out.left = (pdf[c].to_numpy() for c in ("feature", "cut", "left"))
        out.value = np.array(pdf["value"].tolist(), float)
        return out


def row_blocks(rows: DataFrame, coded: Callable[[np.ndarray], np.ndarray], start: np.ndarray) -> DataFrame:
    """n, x, y, s: blocks of coded features, labels and start scores (checkpointed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                x = np.nan_to_num(part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                y = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                yield _block(len(x), coded(x).tobytes(), y.tobytes(), np.tile(start, (len(x), 1)).tobytes())

    out = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    # about a block a task: passes use all cores, and small tables don't spend their time on starting tasks
    wanted = max(1, -(-out.count() // BLOCK_ROWS))
    parts, cores = out.rdd.getNumPartitions(), out.sparkSession.sparkContext.defaultParallelism
    if parts > wanted:
        out = out.coalesce(wanted)
    elif parts < min(wanted, cores):
        out = out.repartition(min(wanted, cores))
    return cut_lineage(out.mapInArrow(run, "n long, x binary, y binary, s binary"))


def cell_blocks(rows: DataFrame, coded: Callable[[np.ndarray], np.ndarray], classes: int, start: np.ndarray) -> DataFrame:
    """Like :func:`row_blocks`, with one weighted row for all rows of equal codes (and class); labels
    are their mean.  ``y`` holds the labels of a block, then its weights."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = coded(np.nan_to_num(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)))
                at = np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1]
                keys = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([keys, b.column(1)], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                y = np.stack([part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2)])
                yield _block(part.num_rows, b"".join(part.column(0).to_pylist()), y.tobytes(), np.tile(start, (part.num_rows, 1)).tobytes())

    codes = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).mapInArrow(
        code, "x binary, y double")
    weight = F.count(F.lit(1)).cast("double").alias("w")
    cells = codes.groupBy("x", "y").agg(weight) if classes else codes.groupBy("x").agg(F.avg("y").alias("y"), weight)
    return cut_lineage(cells.sortWithinPartitions("x", "y").mapInArrow(run, "n long, x binary, y binary, s binary"))


def weighted_blocks(cells: DataFrame, classes: int) -> DataFrame:
    """Like :func:`row_blocks`, of the rows of :func:`cells.grouped`: ``y`` holds class and rows, or
    rows, sum of labels and sum of squared labels, row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                x, *y = b.slice(lo, BLOCK_ROWS).columns
                y = np.stack([c.to_numpy(zero_copy_only=False) for c in y], 1)
                yield _block(len(y), x.flatten().to_numpy(zero_copy_only=False).tobytes(), np.ascontiguousarray(y).tobytes(),
                             np.zeros(len(y)).tobytes())

    w, label = F.col(CE.WEIGHT), F.col("label")
    out = cells.select(vector_to_array("features").alias("x"), *([label, w] if classes else [w, w * label, F.col(CE.SQUARES)]))
    wanted = max(out.sparkSession.sparkContext.defaultParallelism, -(-out.count() // BLOCK_ROWS))
    out = out.coalesce(wanted) if out.rdd.getNumPartitions() > wanted else out
    return cut_lineage(out.mapInArrow(run, "n long, x binary, y binary, s binary"))


def _block(n: int, x: bytes, y: bytes, s: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([x], pa.binary()), pa.array([y], pa.binary()), pa.array([s], pa.binary())],
                                      names=["n", "x", "y", "s"])


def _parts(batches, kind) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for n, x, y, s in zip(b.column(0).to_pylist(), *(b.column(i) for i in (1, 2, 3))):
            yield (np.frombuffer(x.as_buffer(), kind).reshape(n, -1), np.frombuffer(y.as_buffer()),
                   np.frombuffer(s.as_buffer()).reshape(n, -1))


def one_pass(blocks: DataFrame, size: int, put: Callable, kind=np.float64, merge=np.add, zero: float = 0.0) -> np.ndarray:
    """``put(total, x, y, s)`` merges a block into its task's vector; all vectors merged."""
    def run(batches):
        total = np.full(size, zero)
        for x, y, s in _parts(batches, kind):
            put(total, x, y, s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["b"])

    return summed_blobs(blocks.mapInArrow(run, "b binary"), size, merge, zero)


# -------------------------------------------------------------------- extra trees

def _label_sums(classes: int, slots: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """(n, k) sums per slot: rows by class, or rows, labels and squared labels; ``y``: labels, or a
    row of :func:`weighted_blocks` each."""
    if y.ndim == 2:
        if classes:
            return np.bincount(slots * classes + y[:, 0].astype(int), y[:, 1], n * classes).reshape(n, classes)
        return np.stack([np.bincount(slots, w, n) for w in y.T], 1)
    if classes:
        return np.bincount(slots * classes + y.astype(int), minlength=n * classes).reshape(n, classes)
    return np.stack([np.bincount(slots, w, minlength=n) for w in (None, y, y * y)], 1)


def _labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return y if len(y) == len(x) else y.reshape(len(x), -1)


def _size(sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.sum(-1) if classes else sums[..., 0]


def _purity(sums: np.ndarray, classes: int) -> np.ndarray:
    """Larger is purer: rows times the mean squared class share or squared mean."""
    n = np.maximum(_size(sums, classes), 1)
    return (sums * sums).sum(-1) / n if classes else sums[..., 1] ** 2 / n


def _is_pure(sums: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        return sums.max(-1) == sums.sum(-1)
    return sums[..., 2] - _purity(sums, classes) <= 1e-9 * np.maximum(sums[..., 2], 1e-300)


def grow_forest(blocks: DataFrame, width: int, classes: int, trees: int, depth: int, min_split: int, min_leaf: int,
                max_features: int, seed: int = 42) -> tuple[Trees, np.ndarray]:
    """Trees and the purity gained by each feature."""
    def whole(total, x, y, s):
        total += _label_sums(classes, np.zeros(len(x), int), _labels(x, y), 1).ravel()

    stats = max(classes, 3) if not classes else classes
    sums = np.tile(one_pass(blocks, stats, whole), (trees, 1))
    if not _size(sums, classes).any():
        raise ValueError("no training rows")
    value = lambda s: s / _size(s, classes)[:, None] if classes else s[:, 1:2] / s[:, :1]
    forest = Trees(trees, classes or 1)
    forest.value[:] = value(sums)
    gained, nodes, tree = np.zeros(width), np.arange(trees), np.arange(trees)
    for level in range(depth):
        stay = (_size(sums, classes) >= max(min_split, 2 * min_leaf)) & ~_is_pure(sums, classes)
        room = max(0, (MAX_NODES - len(forest.feature)) // 2)
        if stay.sum() > room:
            largest = np.argsort(-np.where(stay, _size(sums, classes), -1), kind="stable")[:room]
            stay = np.zeros(len(stay), bool)
            stay[largest] = True
        nodes, tree, sums = nodes[stay], tree[stay], sums[stay]
        if not len(nodes):
            break
        step = max(1, PASS_NUMBERS // (max_features * stats + 2 * width))
        after = []
        for lo in range(0, len(nodes), step):
            some = slice(lo, lo + step)
            after.append(_split_level(blocks, forest, nodes[some], tree[some], sums[some], width, classes, min_leaf,
                                      max_features, np.random.RandomState([seed, level, lo]), gained, value))
        nodes, tree, sums = (np.concatenate(a) for a in zip(*after))
    return forest, gained


def _split_level(blocks, forest, nodes, tree, sums, width, classes, min_leaf, m, rng, gained, value):
    """Split open nodes at the best of ``m`` drawn (feature, threshold); the children with their sums."""
    n, stats = len(nodes), sums.shape[1]
    slot, steps = np.full(len(forest.feature), -1), forest.steps()
    slot[nodes] = np.arange(n)
    own_slots = [(t, int(i[0]), int(i[-1]) + 1) for t in np.unique(tree) for i in (np.flatnonzero(tree == t),)]   # open nodes lie by tree

    def open_rows(x, t, lo):
        """Rows in open nodes of a tree, and their slots among the tree's."""
        at = slot.take(forest.walk(x, t, steps))
        rows = np.flatnonzero(at >= 0)
        return rows, at[rows] - lo

    def ranges(total, x, y, s):
        both = total.reshape(2, n, width)   # smallest values, and largest ones negated
        for t, lo, hi in own_slots:
            rows, at = open_rows(x, t, lo)
            if len(rows):
                at = at.astype(np.uint16) if hi - lo <= 1 << 16 else at
                order = np.argsort(at, kind="stable")
                at, part = at[order], x[rows[order]]
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                own = at[first].astype(int) + lo
                both[0, own] = np.minimum(both[0, own], np.minimum.reduceat(part, first, axis=0))
                both[1, own] = np.minimum(both[1, own], -np.maximum.reduceat(part, first, axis=0))

    low, high = one_pass(blocks, 2 * n * width, ranges, merge=np.minimum, zero=np.inf).reshape(2, n, width) * [[[1]], [[-1]]]
    order = np.argsort(rng.random_sample((n, width)) + 2 * (low >= high), axis=1, kind="stable")[:, :m]
    a, z = np.take_along_axis(low, order, 1), np.take_along_axis(high, order, 1)
    cuts = a + rng.random_sample(order.shape) * (z - a)
    cuts = np.where(cuts >= z, a, cuts)
    columns, bounds = np.ascontiguousarray(order.T), np.ascontiguousarray(cuts.T)

    def left_sums(total, x, y, s):
        out = total.reshape(m, n, stats)
        flat, y = x.ravel(), _labels(x, y)
        for t, lo, hi in own_slots:
            rows, at = open_rows(x, t, lo)
            here, first, label = at + lo, rows * width, y[rows]
            for j in range(order.shape[1]):
                goes = flat.take(first + columns[j].take(here)) <= bounds[j].take(here)
                out[j, lo:hi] += _label_sums(classes, at[goes], label[goes], hi - lo)

    left = one_pass(blocks, m * n * stats, left_sums).reshape(m, n, stats)[:order.shape[1]]
    right = sums[None] - left
    gain = _purity(left, classes) + _purity(right, classes) - _purity(sums, classes)
    valid = (a < z).T & (np.minimum(_size(left, classes), _size(right, classes)) >= min_leaf)
    gain = np.where(valid, gain, -np.inf)
    # sums of the same rows differ by rounding with their order: gains that close are ties, the first one drawn wins
    best = (gain >= gain.max(0) - 1e-9 * (1 + np.abs(_purity(sums, classes)))).argmax(0)
    own = np.flatnonzero(gain[best, np.arange(n)] > -np.inf)
    best = best[own]
    ls, rs, features = left[best, own], right[best, own], order[own, best]
    np.add.at(gained, features, np.maximum(gain[best, own], 0))
    at = forest.split(nodes[own], features, cuts[own, best], value(ls), value(rs))
    return (np.stack([at, at + 1], 1).ravel(), np.repeat(tree[own], 2), np.stack([ls, rs], 1).reshape(2 * len(own), stats))


# ----------------------------------------------------------------------- boosting

def bin_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins: its distinct quantiles (approximate, at most ``BINS`` - 1)."""
    x = vector_to_array("features")
    probs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    r = rows.select(x.alias("x")).agg(*[F.percentile_approx(F.nanvl(F.get("x", F.lit(i)), F.lit(0.0)), probs, 10_000).alias(f"e{i}")
                                        for i in range(width)]).first()
    return [np.unique(np.array(r[f"e{i}"] if r[f"e{i}"] is not None else [0.0], float)) for i in range(width)]


def gradients(s: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss by score: squared error, logistic (one score) or softmax."""
    if not classes:
        return s - y[:, None], np.ones_like(s)
    if s.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        return p - y[:, None], p * (1 - p)
    p = softmax(s)
    return p - (y[:, None] == np.arange(classes)), p * (1 - p) * classes / (classes - 1)


class _Growing:
    """One round's trees (one per output) with what is known of their nodes."""

    def __init__(self, outputs: int):
        self.trees = Trees(outputs, 1)
        self.best: dict[int, tuple] = {}    # node -> (gain, feature, bin)
        self.hist: dict[int, np.ndarray] = {}
        self.waiting = list(range(outputs))  # nodes whose histogram the next pass collects
        self.parent: dict[int, int] = {}     # of the left children among them

    def leaves_of(self, root: int, num_leaves: int) -> tuple[list[int], list[int]]:
        """Nodes to split, best gain first, and those among them without children yet."""
        frontier, split, missing = [root], [], []
        while len(split) < num_leaves - 1:
            node = max(frontier, key=lambda k: (self.best[k][0], -k), default=None)
            if node is None or self.best[node][0] <= 0:
                break
            frontier.remove(node)
            split.append(node)
            if self.trees.feature[node] < 0:
                missing.append(node)
            else:
                frontier += [k for k in (self.trees.left[node], self.trees.left[node] + 1) if k in self.best]
        return split, missing


def _best_split(h: np.ndarray, allowed: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of sums (features, bins, 3)."""
    c = np.cumsum(h, axis=1)
    whole = c[:, -1:]
    left, right = c[:, :-1], whole - c[:, :-1]
    value = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1], 1e-12)
    gain = value(left) + value(right) - value(whole)
    ok = ((np.minimum(left[..., 2], right[..., 2]) >= MIN_CHILD_ROWS)
          & (np.minimum(left[..., 1], right[..., 1]) >= MIN_CHILD_CURVATURE) & allowed[:, None])
    gain = np.where(ok, gain, 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]) if gain[f, b] > 1e-10 else 0.0, int(f), int(b)


def grow_round(blocks: DataFrame, recent: list[Trees], width: int, classes: int, outputs: int, num_leaves: int,
               allowed: np.ndarray, rate: float) -> tuple[Trees, np.ndarray, int]:
    """One round on weighted rows scored up to ``recent``: trees on bin numbers, gain by feature, passes."""
    g, passes = _Growing(outputs), 0
    while True:
        wanted, trees = np.array(g.waiting), g.trees
        slot = np.full(len(trees.feature), -1)
        slot[wanted] = np.arange(len(wanted))

        def collect(total, x, y, s):
            y, weight = y.reshape(2, -1)
            grad, curve = (v * weight[:, None] for v in gradients(scores(x, s, recent), y, classes))
            sums = total.reshape(len(wanted), width, BINS + 1, 3)
            for t in range(outputs):
                at = slot[trees.walk(x, t)]
                rows = np.flatnonzero(at >= 0)
                if len(rows):
                    cells = at[rows] * (BINS + 1)
                    for f in range(width):
                        cell = cells + x[rows, f]
                        for j, w in enumerate((grad[rows, t], curve[rows, t], weight[rows])):
                            sums[:, f, :, j] += np.bincount(cell, w, minlength=len(wanted) * (BINS + 1)).reshape(-1, BINS + 1)

        got = one_pass(blocks, len(wanted) * width * (BINS + 1) * 3, collect, np.uint8).reshape(len(wanted), width, BINS + 1, 3)
        passes += 1
        for k, h in zip(wanted.tolist(), got):
            g.hist[k] = h
        for k in wanted.tolist():
            if k >= outputs:   # only left children are counted; the right one is the rest of the parent
                g.hist[k + 1] = g.hist[g.parent[k]] - g.hist[k]
            for node in (k,) if k < outputs else (k, k + 1):
                g.best[node] = _best_split(g.hist[node], allowed)
        plans = [g.leaves_of(t, num_leaves) for t in range(outputs)]
        missing = [k for _, m in plans for k in m]
        if not missing:
            break
        cut = np.array([g.best[k][1:] for k in missing])
        at = g.trees.split(np.array(missing), cut[:, 0], cut[:, 1], np.zeros((len(missing), 1)), np.zeros((len(missing), 1)))
        g.parent = dict(zip(at.tolist(), missing))
        g.waiting = at.tolist()
    final, gained = Trees(outputs, outputs), np.zeros(width)
    weight = lambda h: -rate * h[0, :, 0].sum() / max(h[0, :, 1].sum(), 1e-12)
    for t, (split, _) in enumerate(plans):
        number = {t: t}
        final.value[t, t] = weight(g.hist[t])
        for node in split:
            gain, f, b = g.best[node]
            gained[f] += gain
            left, right = int(g.trees.left[node]), int(g.trees.left[node]) + 1
            both = np.zeros((2, 1, outputs))
            both[0, 0, t], both[1, 0, t] = weight(g.hist[left]), weight(g.hist[right])
            at = int(final.split(np.array([number[node]]), np.array([f]), np.array([float(b)]), both[0], both[1])[0])
            number[left], number[right] = at, at + 1
    return final, gained, passes


def scores(x: np.ndarray, s: np.ndarray, recent: list[Trees]) -> np.ndarray:
    for t in recent:
        s = s + t.total(x, t.value.shape[1])
    return s


def rescored(blocks: DataFrame, recent: list[Trees]) -> DataFrame:
    """Blocks whose scores hold the trees of ``recent`` (checkpointed)."""
    def run(batches):
        for b in batches:
            for n, x, y, s in zip(b.column(0).to_pylist(), *(b.column(i) for i in (1, 2, 3))):
                codes = np.frombuffer(x.as_buffer(), np.uint8).reshape(n, -1)
                new = scores(codes, np.frombuffer(s.as_buffer()).reshape(n, -1), recent)
                yield _block(n, x.as_py(), y.as_py(), new.tobytes())

    return cut_lineage(blocks.mapInArrow(run, blocks.schema))


# ------------------------------------------------------------------------- stages

class _TreeStage(Saved):
    """Fitted trees; ``options``: kind, classes, and start scores of boosting."""

    def __init__(self, options: dict, rounds: list[Trees], importances: np.ndarray):
        super().__init__()
        self.options, self.rounds = options, rounds
        self.featureImportances = DenseVector(importances / max(importances.sum(), 1e-300))

    def state(self) -> dict:
        return {"options": self.options, "n": len(self.rounds), "importances": self.featureImportances.toArray().tolist()}

    def tables(self) -> dict:
        spark = SparkSession.getActiveSession()
        return {f"trees{i}": t.frame(spark) for i, t in enumerate(self.rounds)}

    @classmethod
    def restore(cls, s: dict, path: str) -> "_TreeStage":
        return cls(s["options"], [Trees.of(f"{path}/tables/trees{i}") for i in range(s["n"])], np.array(s["importances"]))

    def _output(self) -> Callable[[np.ndarray], np.ndarray]:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        output, k = self._output(), self.options["classes"]

        @F.arrow_udf("array<double>")
        def run(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.list_(pa.float64()))
            got = output(np.nan_to_num(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)))
            return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * got.shape[1], got.ravel())

        out = dataset.withColumn("__out", run(vector_to_array("features")))
        if not k:
            return out.withColumn("prediction", F.get("__out", F.lit(0))).drop("__out")
        return (out.withColumn("rawPrediction", array_to_vector("__out")).withColumn("probability", array_to_vector("__out"))
                .withColumn("prediction", (F.array_position("__out", F.array_max("__out")) - 1).cast("double")).drop("__out"))


class ExtraTrees(Estimator):
    """Every tree sees all rows; ``max_features`` drawn per node."""

    def __init__(self, n_classes: int, n_estimators: int, max_depth: int, min_split: int, min_leaf: int, max_features: int):
        super().__init__()
        self.n_classes, self.n_estimators, self.max_depth = n_classes, n_estimators, max_depth
        self.min_split, self.min_leaf, self.max_features = min_split, min_leaf, max_features

    def _fit(self, dataset: DataFrame) -> "ExtraTreesStage":
        rows = dataset.select("features", "label")
        width = len((rows.first() or ([0],))[0])
        r = rows.agg(F.avg("label")).first()[0] or 0.0
        centre = 0.0 if self.n_classes else float(r)
        rows, n, grid = rows.withColumn("label", F.col("label") - F.lit(centre)), rows.count(), None
        if n > CE.PLAIN_ROWS:   # rows of equal cells are one row with their sums
            grid = CE.fit_grid(rows, n)
            blocks = weighted_blocks(CE.grouped(rows, grid, self.n_classes > 0), self.n_classes)
        else:
            blocks = row_blocks(rows, _plain, np.zeros(1))
        forest, gained = grow_forest(blocks, width, self.n_classes, self.n_estimators, self.max_depth, self.min_split,
                                     self.min_leaf, min(self.max_features, width))
        if not self.n_classes:
            forest.value += centre
        stage = ExtraTreesStage({"classes": self.n_classes, "trees": self.n_estimators}, [forest], gained)
        return stage if grid is None else CE.CellStage(grid, stage)


def _plain(x: np.ndarray) -> np.ndarray:
    return x


class TreeView:
    """One tree of a model as text, its number in the first line."""

    def __init__(self, trees: Trees, root: int):
        lines, stack = [f"Tree {root}"], [(root, 1)]
        while stack:
            k, depth = stack.pop()
            f = int(trees.feature[k])
            lines.append(" " * depth + (f"value {trees.value[k].tolist()}" if f < 0 else f"feature {f} <= {trees.cut[k]}"))
            if f >= 0:
                stack += [(int(trees.left[k]) + 1, depth + 1), (int(trees.left[k]), depth + 1)]
        self.toDebugString = "\n".join(lines)


class ExtraTreesStage(_TreeStage):
    @property
    def trees(self) -> list[TreeView]:
        return [TreeView(self.rounds[0], r) for r in range(self.options["trees"])]

    def _output(self):
        forest, trees = self.rounds[0], self.options["trees"]
        return lambda x: forest.total(x, trees) / trees


class LeafWiseBoosting(Estimator):
    """Gradient boosting of trees grown by best gain first."""

    def __init__(self, n_classes: int, n_estimators: int, rate: float, num_leaves: int, feature_fraction: float = 1.0, seed: int = 42):
        super().__init__()
        self.n_classes, self.n_estimators, self.rate = n_classes, n_estimators, rate
        self.num_leaves, self.feature_fraction, self.seed = num_leaves, feature_fraction, seed

    def _fit(self, dataset: DataFrame) -> "LeafWiseStage":
        rows, k = dataset.select("features", "label"), self.n_classes
        width = len((rows.first() or ([0],))[0])
        outputs = k if k > 2 else 1
        if k:
            counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}   # one row per class
            share = np.array([counts.get(i, 0) + 1e-9 for i in range(k)], float) / max(1, sum(counts.values()))
            start = np.log(share) if outputs > 1 else np.array([np.log(share[1] / share[0])])
        else:
            start = np.array([rows.agg(F.avg("label")).first()[0] or 0.0])
        edges = bin_edges(rows, width)
        blocks = cell_blocks(rows, _coder(edges), k, start)
        rng, rounds, recent, gained, passes = np.random.RandomState(self.seed), [], [], np.zeros(width), 0
        for _ in range(self.n_estimators):
            allowed = np.zeros(width, bool)
            allowed[rng.permutation(width)[:max(1, round(self.feature_fraction * width))]] = True
            trees, g, p = grow_round(blocks, recent, width, k, outputs, self.num_leaves, allowed, self.rate)
            passes, gained = passes + p, gained + g
            recent.append(trees)
            rounds.append(trees)
            if len(recent) == KEPT_ROUNDS:
                blocks, recent = rescored(blocks, recent), []
        return LeafWiseStage({"classes": k, "start": start.tolist(), "edges": [e.tolist() for e in edges], "passes": passes}, rounds, gained)


def _coder(edges: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Values to bin numbers: bin b holds values at most its edge."""
    return lambda x: np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8)


class LeafWiseStage(_TreeStage):
    def tables(self) -> dict:
        spark = SparkSession.getActiveSession()
        parts = [t.frame(spark).toPandas().assign(round=i) for i, t in enumerate(self.rounds)]
        schema = "node long, feature int, cut double, left int, value array<double>, round int"
        return {"trees": spark.createDataFrame(pd.concat(parts) if parts else [], schema)}

    @classmethod
    def restore(cls, s: dict, path: str) -> "LeafWiseStage":
        pdf, rounds = SparkSession.getActiveSession().read.parquet(f"{path}/tables/trees").toPandas(), []
        for _, part in sorted(pdf.groupby("round"), key=lambda p: p[0]):
            part, t = part.sort_values("node"), Trees(0, 0)
            t.feature, t.cut, t.left = (part[c].to_numpy() for c in ("feature", "cut", "left"))
            t.value = np.array(part["value"].tolist(), float)
            rounds.append(t)
        return cls(s["options"], rounds, np.array(s["importances"]))

    def _output(self):
        o, rounds = self.options, self.rounds
        code, start, k = _coder([np.array(e) for e in o["edges"]]), np.array(o["start"]), o["classes"]

        def run(x):
            s = scores(code(x), np.tile(start, (len(x), 1)), rounds)
            if not k:
                return s
            if k > 2:
                return softmax(s)
            p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
            return np.hstack([1 - p, p])
        return run
