"""Product-quantised vector codes with exact integer arithmetic.

Components become integers floor(scale * x); vectors are cut into ``parts``
equal consecutive parts, each with a codebook of its own.  A codebook starts as
that part of the ``entries`` smallest ids; each round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and
replaces each entry by the componentwise floor of its parts' mean.

*Limb-split GEMM*: both factors of x.c are broken into limbs of so few bits that
a float64 BLAS product of limbs stays below 2^53 and is exact; the products are
recombined with shifts in int64, and |c|^2 - 2 x.c decides by first argmin.

Work per round is one scan: a task sums the parts of each (part, entry) over all
its rows, Spark adds these sums, and only the codebooks (parts * entries rows,
whatever the table's size) reach the driver.  Codes are written once; errors are
summed by label and joined back (a hot label is a skewed join side of many
rows against one, which adaptive execution splits).

Defined results: vectors that are null or empty, hold null or non-finite
components or integers of 2^90 and more take no part, nor do vectors whose
length differs from the most common one (ties: the shorter) or isn't a multiple
of ``parts``.  Rows without an id get codes but start no entry; a repeated id
counts as often as it stands, smaller vectors first; fewer rows than ``entries``
give fewer entries; null labels are one label; an error beyond a long is null.
Integers too large for int64 distances are worked on as Python integers.  An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_ROWS = 2048
LARGEST = 2.0 ** 90


# ------------------------------------------------------------ exact arithmetic

def limb_bits(width: int) -> int:
    """Bits of a limb so that a sum of ``width`` limb products is below 2^53."""
    return (52 - max(0, width - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """int64 -> float64 limbs, lowest first: x = sum limb_k * 2^(bits k); all
    but the last are in [0, 2^bits), the last carries the sign."""
    out = []
    while True:
        rest = x >> bits
        if ((rest == 0) | (rest == -1)).all():
            return out + [x.astype(float)]
        out.append((x & ((1 << bits) - 1)).astype(float))
        x = rest


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(parts, rows, entries) int64 inner products of (parts, rows, width) and
    (parts, entries, width) integers; exact while the results fit int64."""
    bits = limb_bits(x.shape[2])
    total = np.zeros((x.shape[0], x.shape[1], c.shape[1]), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(c, bits)):
            if bits * (i + j) < 64:
                total += np.matmul(a, b.transpose(0, 2, 1)).astype(np.int64) << np.int64(bits * (i + j))
    return total


def fits(largest: float, width: int) -> bool:
    """Squared distances of integers up to ``largest`` stay in int64."""
    return width * (2 * largest) ** 2 < 2.0 ** 62


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance, both (parts, rows), of
    parts (parts, rows, width) against codebooks (parts, entries, width)."""
    if x.dtype == object or codebooks.dtype == object:
        x, codebooks = x.astype(object), codebooks.astype(object)
        away = ((x[:, :, None, :] - codebooks[:, None]) ** 2).sum(axis=3)
        at = np.array([[min(range(len(d)), key=d.__getitem__) for d in rows] for rows in away.tolist()], np.int64)
        at = at.reshape(x.shape[:2])
        return at, np.take_along_axis(away, at[:, :, None], axis=2)[:, :, 0]
    away = (codebooks * codebooks).sum(axis=2)[:, None, :] - 2 * exact_products(x, codebooks)
    at = away.argmin(axis=2)
    return at, np.take_along_axis(away, at[:, :, None], axis=2)[:, :, 0] + (x * x).sum(axis=2)


def to_integers(values: np.ndarray, parts: int, codebooks: np.ndarray | None = None) -> np.ndarray:
    """(rows, dims) whole doubles -> (parts, rows, width) integers: int64, or
    Python integers where distances might leave int64."""
    largest = float(np.abs(values).max(initial=0.0))
    width = values.shape[1] // parts
    if codebooks is not None:
        largest = max(largest, float(max(map(abs, codebooks.ravel().tolist()), default=0)))
    if fits(largest, width):
        ints = values.astype(np.int64)
    else:
        ints = np.array([[int(v) for v in row] for row in values.tolist()], object).reshape(values.shape)
    return np.ascontiguousarray(ints.reshape(len(values), parts, width).transpose(1, 0, 2))


# ------------------------------------------------------------------ Spark jobs

def usable(table: DataFrame, parts: int, scale: int) -> DataFrame:
    """vec_id, label, v: vectors of whole doubles that take part."""
    x = F.col("v")
    rows = (table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"),
                         F.col("embedding").cast("array<double>").alias("v"))
            .where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0)))
    rows = rows.withColumn("v", F.transform(x, lambda c: c * float(scale))).where(F.coalesce(F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST))), F.lit(False)))
    usual = rows.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size(x) == (usual[0]["d"] if usual else -1))


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, floors of the vectors) of bounded slices."""
    for lo in range(0, batch.num_rows, BLOCK_ROWS):
        v = batch.column(column).slice(lo, BLOCK_ROWS)
        yield lo, np.floor(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1))


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    drawn = rows.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "v").limit(entries).collect()
    values = np.floor(np.array([r["v"] for r in drawn], float))
    return to_integers(values, parts) if len(drawn) else np.zeros((parts, 0, 1), np.int64)


def refine(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of its parts' mean."""
    parts, entries, width = codebooks.shape
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), object)
        for batch in batches:
            for _, values in _blocks(batch, 0):
                x = to_integers(values, parts, c)
                at, _ = nearest(x, c)
                for p in range(parts):
                    counts[p] += np.bincount(at[p], minlength=entries)
                    order = np.argsort(at[p], kind="stable")
                    used, start = np.unique(at[p][order], return_index=True)
                    sums[p, used] += np.add.reduceat(x[p][order], start, axis=0).astype(object)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(p, width).astype(np.int32)), pa.array(np.repeat(e, width).astype(np.int32)),
                 pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))), pa.array(np.repeat(counts[p, e], width)),
                 pa.array([Decimal(int(s)) for s in sums[p, e].ravel()], pa.decimal128(38, 0))],
                names=["p", "e", "j", "n", "s"])

    added = (rows.select("v").mapInArrow(run, "p int, e int, j int, n long, s decimal(38,0)")
             .groupBy("p", "e", "j").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect())
    new = codebooks.astype(object)
    for r in added:  # parts * entries * width rows
        new[r["p"], r["e"], r["j"]] = int(r["s"]) // r["n"]
    largest = float(max(map(abs, new.ravel().tolist()), default=0))
    return new.astype(np.int64) if fits(largest, width) else new


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    codebooks = first_codebooks(rows, parts, entries)
    for _ in range(rounds if codebooks.shape[1] else 0):
        codebooks = refine(rows, codebooks)
    return codebooks


def assign(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part; wider codebooks: as many as needed), error."""
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)
    digits = max(2, -(-max(1, (codebooks.shape[1] - 1).bit_length()) // 4))
    parts = codebooks.shape[0]
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        hexes = np.array([f"{k:0{digits}x}" for k in range(c.shape[1])])
        for batch in batches:
            for lo, values in _blocks(batch, 2):
                at, away = nearest(to_integers(values, parts, c), c)
                codes = np.ascontiguousarray(hexes[at.T]).view(f"<U{digits * parts}").ravel()
                total = away.sum(axis=0)
                errors = pa.array([int(t) if t < 1 << 63 else None for t in total.tolist()], pa.int64())
                some = batch.slice(lo, len(values))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(codes.tolist()), errors],
                                                 names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
           scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every usable row."""
    rows = usable(table, parts, scale)
    codebooks = fit(rows, parts, entries, rounds)
    if not codebooks.shape[1]:
        return (rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
                .withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit("")))
    codes = written(assign(rows, codebooks), "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = codes.groupBy(F.col("label").alias("of")).agg(
        F.when(total < F.lit(1 << 62) * F.lit(2).cast("decimal(38,0)"), total).cast("long").alias("label_error"))
    return (codes.join(by_label, codes["label"].eqNullSafe(by_label["of"])).drop("of")
            .withColumn("codebooks_sha256", F.lit(digest(codebooks))))
