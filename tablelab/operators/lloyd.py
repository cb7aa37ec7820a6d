"""k-means for many models at once (C2: every k with ten starts).

All (k, start) models live in one list of centres.  A step of Lloyd's algorithm is
one pass over the rows for all of them: every task sums its rows by nearest centre
of each model with numpy and sends one binary blob of sums, counts and inertia;
blobs are added in two levels.  Models that no longer move drop out of the next
pass.  Starts are drawn by k-means++ on a sample of at most ``SAMPLE`` rows chosen by
hash (a bound of the start only: steps and inertia use all rows).

Rows are dealt by regions of the space (median cuts of the sample) into blocks, and a
block is ordered by median cuts into leaves of some ``LEAF`` rows and groups of ``FAN``
leaves, each with its mean, the radius of the ball around it that holds its rows, and
the squares of their distances from it.  A ball whose rows are all nearest to one
centre (its lead over any other centre is larger than the ball) is added as a whole;
only the others are opened, down to single rows.  So every row is counted with its
nearest centre in every step, and a step costs what lies along the borders of clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.operators.kernel import summed_blobs
from tablelab.session import cut_lineage

SAMPLE = 4000
CHUNK_NUMBERS = 1 << 20  # rows times features of a block
LEAST_ROWS = 1 << 13     # rows of a block, fewer if all rows are fewer
LEAF, FAN = 16, 32
PIECE_NUMBERS = 1 << 20  # rows times features that a task deals out at once
BLOCK_ROWS = 4096        # rows whose silhouettes are computed at once
TASKS_PER_CORE = 2
TOL = 1e-4       # fixed value: centres that move less than this share of the features' variance are done
MAX_STEPS = 300  # fixed value


# ------------------------------------------------------------------ regions and blocks

def region_cuts(points: np.ndarray, regions: int) -> list[tuple[int, float, int, int]]:
    """Nodes (feature, cut, left, right) of median cuts of ``points`` into so many regions;
    a child below 0 is region -1 - child, values below the cut go left."""
    nodes: list[tuple[int, float, int, int]] = []

    def grow(part: np.ndarray, first: int, count: int) -> int:
        if count == 1:
            return -1 - first
        left = count // 2
        at = int((part.max(0) - part.min(0)).argmax()) if len(part) else 0
        cut = float(np.partition(part[:, at], i := len(part) * left // count)[i]) if len(part) else 0.0
        low = part[:, at] < cut
        me = len(nodes)
        nodes.append((at, cut, 0, 0))
        nodes[me] = (at, cut, grow(part[low], first, left), grow(part[~low], first + left, count - left))
        return me

    grow(points, 0, regions)
    return nodes


def region_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64) if nodes else np.full(len(x), -1)
    if nodes:
        feature, cut, left, right = (np.array(v) for v in zip(*nodes))
        while len(open_ := np.flatnonzero(at >= 0)):
            node = at[open_]
            at[open_] = np.where(x[open_, feature[node]] < cut[node], left[node], right[node])
    return -1 - at


def ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows by leaf: leaves x places x features, rows in each leaf): median cuts along the
    widest feature; places without a row come last in their leaf."""
    n, width = x.shape
    levels = max(0, int(np.log2(n / LEAF))) if n else 0
    places = -(-n // (1 << levels)) << levels
    x = np.column_stack([np.vstack([x, x[:places - n]]), np.arange(places) < n])
    for level in range(levels):
        part = x.reshape(1 << level, -1, width + 1)
        widest = (part[:, :, :width].max(1) - part[:, :, :width].min(1)).argmax(1)
        key = np.take_along_axis(part, widest[:, None, None], 2)[:, :, 0]
        order = np.argpartition(key, key.shape[1] // 2, axis=1)
        x = x[(order + (np.arange(1 << level) * key.shape[1])[:, None]).ravel()]
    x = x.reshape(1 << levels, -1, width + 1)
    x = np.take_along_axis(x, np.argsort(-x[:, :, width], axis=1, kind="stable")[:, :, None], 1)
    return np.ascontiguousarray(x[:, :, :width]), x[:, :, width].sum(1)


def balls(x: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Per group of rows (groups x places x features; ``filled``: which places hold a row)
    its rows, radius, squares around the mean, and mean."""
    n = filled.sum(1)
    mean = (x * filled[:, :, None]).sum(1) / np.maximum(n, 1)[:, None]
    away = ((x - mean[:, None]) ** 2).sum(2) * filled
    # a little larger than measured, for the rounding of centres' distances
    radius = np.sqrt(away.max(1)) * (1 + 1e-9) + 1e-12 * (1 + np.abs(x).max())
    return np.column_stack([n, radius, away.sum(1), mean])


def block_of(x: np.ndarray) -> dict:
    rows, n = ordered(x)
    leaves, places, width = rows.shape
    filled = np.arange(places) < n[:, None]
    fan = min(FAN, leaves)
    return {"n": len(x), "leaves": leaves, "x": rows.tobytes(), "leaf": balls(rows, filled).tobytes(),
            "top": balls(rows.reshape(leaves // fan, -1, width), filled.reshape(leaves // fan, -1)).tobytes()}


BLOCK = "n long, leaves long, x binary, leaf binary, top binary"


def _batch(block: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block["n"]]), pa.array([block["leaves"]]),
                                       *[pa.array([block[c]], pa.binary()) for c in ("x", "leaf", "top")]],
                                      names=["n", "leaves", "x", "leaf", "top"])


def opened(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows by leaf, balls of leaves and balls of groups, block by block."""
    for b in batches:
        for leaves, x, leaf, top in zip(b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
            yield (np.frombuffer(x.as_buffer()).reshape(leaves, -1, width), np.frombuffer(leaf.as_buffer()).reshape(leaves, -1),
                   np.frombuffer(top.as_buffer()).reshape(-1, width + 3))


def drawn(feat: DataFrame, seed: int = 42) -> np.ndarray:
    some = feat.select(vector_to_array("features").alias("x")).orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(SAMPLE).collect()
    return np.array([r["x"] for r in some], float)


def blocks_of(feat: DataFrame, points: np.ndarray | None = None) -> DataFrame:
    """Blocks of the rows of each region of the ``features`` (checkpointed)."""
    points = drawn(feat) if points is None else points
    n, cores = feat.count(), feat.sparkSession.sparkContext.defaultParallelism
    width = max(1, points.shape[1] if len(points) else 0)
    wanted = max(1, min(CHUNK_NUMBERS // width, max(LEAST_ROWS, -(-n // (cores * 4)))))
    regions = max(1, -(-n // wanted))
    nodes = region_cuts(points, regions)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            x = np.concatenate(parts)
            at = region_of(x, nodes)
            order = np.argsort(at, kind="stable")
            x, (names, starts) = x[order], np.unique(at[order], return_index=True)
            ends = [*starts[1:], len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)],
                                                                                   pa.binary())], names=["region", "x"])
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))
                rows += b.num_rows
            if rows * width >= PIECE_NUMBERS:
                yield from pieces(held)
                held, rows = [], 0
        if rows:
            yield from pieces(held)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, [], 0
        for b in batches:
            for region, x in zip(b.column(0).to_pylist(), b.column(1)):
                if rows and (region != now or rows >= 2 * wanted):   # a crowded region has several blocks
                    yield _batch(block_of(np.concatenate(held)))
                    held, rows = [], 0
                now = region
                held.append(np.frombuffer(x.as_buffer()).reshape(-1, width))
                rows += len(held[-1])
        if rows:
            yield _batch(block_of(np.concatenate(held)))

    dealt = feat.select(vector_to_array("features").alias("x")).mapInArrow(deal, "region long, x binary")
    out = cut_lineage(dealt.repartition(regions, "region").sortWithinPartitions("region").mapInArrow(build, BLOCK))
    return out.coalesce(max(1, min(out.rdd.getNumPartitions(), out.count(), cores * TASKS_PER_CORE)))


def plus_plus(points: np.ndarray, k: int, rng: np.random.RandomState) -> np.ndarray:
    centers = [points[rng.randint(len(points))]]
    away = ((points - centers[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = away.sum()
        at = rng.randint(len(points)) if total <= 0 else int(np.searchsorted(np.cumsum(away), rng.random_sample() * total))
        centers.append(points[min(at, len(points) - 1)])
        away = np.minimum(away, ((points - centers[-1]) ** 2).sum(1))
    return np.array(centers)


# ------------------------------------------------------------------ steps

def nearest(away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value of each column of ``away`` (centres x rows) and its centre (ties: the first)."""
    best, at = away[0].copy(), np.zeros(away.shape[1], np.intp)
    for j in range(1, len(away)):
        np.copyto(at, j, where=away[j] < best)
        np.minimum(best, away[j], out=best)
    return best, at


class Sums:
    """Sums of one model: features, rows and squared distances by nearest centre."""

    def __init__(self, centers: np.ndarray):
        self.centers, self.k, self.width = centers, len(centers), centers.shape[1]
        self.norms = (centers * centers).sum(1)[:, None]
        self.gaps = 2 * np.sqrt(((centers[:, None] - centers) ** 2).sum(2))
        np.fill_diagonal(self.gaps, -1.0)
        self.total = np.zeros((self.k, self.width + 2))

    def whole(self, ball: np.ndarray) -> np.ndarray:
        """Adds the balls that one centre owns; returns which ones it doesn't."""
        mean, radius = ball[:, 3:], ball[:, 1]
        away = self.norms - 2 * (self.centers @ mean.T)
        best, at = nearest(away)
        owned = np.ones(len(ball), bool)
        for j in range(self.k):
            owned &= away[j] - best > radius * self.gaps[j][at]
        ball, at = ball[owned], at[owned]
        rows, mean = ball[:, 0], ball[:, 3:]
        off = mean - self.centers[at]
        self.add(at, (mean * rows[:, None]).T, rows, ball[:, 2] + rows * (off * off).sum(1))
        return np.flatnonzero(~owned)

    def single(self, x: np.ndarray) -> None:
        """Adds rows (features x rows)."""
        best, at = nearest(self.norms - 2 * (self.centers @ x))
        self.add(at, x, None, np.maximum((x * x).sum(0) + best, 0))

    def add(self, at: np.ndarray, x: np.ndarray, rows: np.ndarray | None, squares: np.ndarray) -> None:
        for j in range(self.width):
            self.total[:, j] += np.bincount(at, x[j], self.k)
        self.total[:, -2] += np.bincount(at, rows, self.k)
        self.total[:, -1] += np.bincount(at, squares, self.k)

    def block(self, x: np.ndarray, leaf: np.ndarray, top: np.ndarray) -> None:
        fan, places = len(leaf) // len(top), x.shape[1]
        part = (self.whole(top)[:, None] * fan + np.arange(fan)).ravel()
        part = part[self.whole(leaf[part])] if len(part) else part
        if len(part):
            self.single(np.ascontiguousarray(x[part][np.arange(places) < leaf[part, :1]].T))


def step_sums(blocks: DataFrame, models: list[np.ndarray]) -> list[np.ndarray]:
    """One pass: per model and nearest centre (ties: the first) the sums of features, the rows
    and the squared distances."""
    width = models[0].shape[1]
    edges = np.concatenate([[0], np.cumsum([len(m) for m in models])])

    def run(batches):
        sums = [Sums(m) for m in models]
        for x, leaf, top in opened(batches, width):
            for s in sums:
                s.block(x, leaf, top)
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([s.total for s in sums]).tobytes()], pa.binary())], names=["b"])

    got = summed_blobs(blocks.mapInArrow(run, "b binary"), int(edges[-1]) * (width + 2)).reshape(-1, width + 2)
    return [got[lo:hi] for lo, hi in zip(edges[:-1], edges[1:])]


def step(blocks: DataFrame, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One pass: per model the sums and counts by nearest centre (ties: the first) and the inertia."""
    return [(s[:, :-2], s[:, -2], float(s[:, -1].sum())) for s in step_sums(blocks, models)]


def fit_blocks(blocks: DataFrame, points: np.ndarray, ks: list[int], starts: int = 10,
               seed: int = 42) -> dict[int, tuple[np.ndarray, float]]:
    """k -> (centres, inertia) of the best of ``starts`` runs (ties: the first)."""
    tol = TOL * float(points.var(axis=0).mean())
    live = {(k, s): plus_plus(points, k, np.random.RandomState([seed, k, s])) for k in ks for s in range(starts)}
    done: dict[tuple[int, int], tuple[np.ndarray, float]] = {}
    still: set = set()   # models whose inertia with their last centres is to be measured
    for turn in range(MAX_STEPS + 1):
        names = list(live)
        for name, (sums, counts, inertia) in zip(names, step(blocks, [live[n] for n in names])):
            if name in still or turn == MAX_STEPS:
                done[name] = (live.pop(name), inertia)
                continue
            old = live[name]
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], old)
            live[name] = new
            if float(((new - old) ** 2).sum()) <= tol:
                still.add(name)
        if not live:
            break
    return {k: min((done[k, s] for s in range(starts)), key=lambda m: m[1]) for k in ks}


def fit_all(feat: DataFrame, ks: list[int], starts: int = 10, seed: int = 42) -> dict[int, tuple[np.ndarray, float]]:
    """k -> (centres, inertia) of the best of ``starts`` runs (ties: the first)."""
    points = drawn(feat, seed)
    return fit_blocks(blocks_of(feat, points), points, ks, starts, seed) if len(points) else {}


# ------------------------------------------------------------------ silhouettes

def silhouettes(blocks: DataFrame, models: list[np.ndarray]) -> list[float]:
    """Mean silhouette of squared Euclidean distances for each model, over all rows.
    A row's mean distance to a cluster is its distance from the cluster's mean and the
    cluster's mean square around it, so two passes do for all models."""
    width, plans = models[0].shape[1], []
    for m, got in zip(models, step_sums(blocks, models)):
        rows = got[:, -2]
        if (rows > 0).sum() < 2:
            raise ValueError("a silhouette needs at least 2 clusters with rows")
        mean = np.where(rows[:, None] > 0, got[:, :-2] / np.maximum(rows, 1)[:, None], np.inf)
        inside = got[:, -1] / np.maximum(rows, 1) - np.where(rows > 0, ((mean - m) ** 2).sum(1), 0)
        plans.append((m, (m * m).sum(1)[:, None], rows, mean, np.maximum(inside, 0)))

    def sizes(x: np.ndarray, plan) -> float:
        m, norms, rows, mean, inside = plan
        at, lanes = nearest(norms - 2 * (m @ x))[1], np.arange(x.shape[1])
        away = np.stack([((x - c[:, None]) ** 2).sum(0) + v for c, v in zip(mean, inside)])
        own = away[at, lanes] * (rows / np.maximum(rows - 1, 1))[at]
        away[at, lanes] = np.inf
        other = away.min(0)
        larger = np.maximum(own, other)
        s = np.divide(other - own, larger, out=np.zeros_like(own), where=larger > 0)
        return float(np.where(rows[at] > 1, s, 0).sum())

    def run(batches):
        total = np.zeros(len(plans) + 1)
        for x, leaf, _ in opened(batches, width):
            rows = x[np.arange(x.shape[1]) < leaf[:, :1]]
            total[-1] += len(rows)
            for lo in range(0, len(rows), BLOCK_ROWS):
                part = np.ascontiguousarray(rows[lo:lo + BLOCK_ROWS].T)
                for i, plan in enumerate(plans):
                    total[i] += sizes(part, plan)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["b"])

    got = summed_blobs(blocks.mapInArrow(run, "b binary"), len(plans) + 1)
    return [float(v) for v in got[:-1] / got[-1]]
