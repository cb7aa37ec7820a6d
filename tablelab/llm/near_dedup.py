"""Near-duplicate documents with MinHash bands and odd sketches.

A document is the set of its distinct 5-word shingles (64-bit hashes); linked
are pairs with Jaccard similarity of at least ``PERCENT`` / 100.

1. *Signature*: 128 MinHash samples.  Groups of 4 give 32 band keys (a pair at
   0.75 shares none with probability 5e-6).  The bottom-``SAMPLE`` MinHash
   sample (the smallest hashes; for most documents the whole set) is folded into
   an odd sketch of 1024 bits: each element flips one bit, so common elements of
   two documents cancel and the population count of the XOR of two sketches is
   at most, and close to, the number of elements that differ.
2. *Copies*: equal sets form a class; only its smallest doc_id goes on.
3. *First links*: the smallest doc_id of a band's bucket is its center.  A
   document is compared with the center that it shares most bands with; such
   comparisons are at most one per document, however large the buckets.
4. *Other links*: components are formed; within a bucket only documents outside
   the center's component are compared, with the members of other components.
   A group of thousands of near copies, which step 3 has joined, costs nothing
   here, and no bucket is capped.
5. *Verification*: pairs whose sketches differ in more bits than a linked pair
   of their sizes can (``may_link``; exact for sets within the sample, 5
   deviations beyond the expectation for larger ones) are dropped; the others
   are confirmed on their full sets, made again from the whole texts.
6. Components of all links give the result.

Defined results: null, empty and white-space texts have the empty set and link
with nothing; fewer than 5 words are one shingle; rows that repeat a doc_id are
one document (each row is returned; it links if one of its texts does); rows
with a null doc_id link with nothing, have a null component and are kept;
extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import space_words, written
from tablelab.llm.components import components

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLE = 1024
SKETCH_WORDS = 16  # of 64 bits
DEVIATIONS = 5
KEEP_WORDS = 100_000
SLICE_BYTES = 16 << 20


# ---------------------------------------------------------------- shingle sets

class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _random(n: int, name: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(name)) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    by = _random(SHINGLE, 1)
    n = max(1, len(h) - SHINGLE + 1)
    size = min(SHINGLE, len(h))
    code = np.full(n, size, np.uint64)
    for k in range(size):
        code += h[k:k + n] * by[k]
    return np.unique(mix(code))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 100 * small < percent * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


# ------------------------------------------------------------------ signatures

def minhash(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS samples of a non-empty set."""
    k = BANDS * ROWS
    by = (_random(k, 2) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
    plus = (_random(k, 3) >> np.uint64(32)).astype(np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        part = by[:, None] * x[None, lo:lo + 1024]
        part += plus[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(documents x samples) -> (documents x bands)."""
    x = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mix((x * _random(ROWS, 4)).sum(axis=2, dtype=np.uint64) + _random(BANDS, 5))


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap (SKETCH_WORDS numbers) of the bottom sample of a sorted set."""
    bits = 64 * SKETCH_WORDS
    at = (mix(shingles[:SAMPLE] + np.uint64(0x632BE59BD9B4E019)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


_SIGNATURE = ("doc_id {id}, n_shingles long, print string, keys array<long>, "
              + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS)))


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set fingerprint, band keys and odd sketch of every row."""
    ddl = _SIGNATURE.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                sizes, prints = [], []
                samples = np.zeros((b.num_rows, BANDS * ROWS), np.uint32)
                sketch = np.zeros((b.num_rows, SKETCH_WORDS), np.uint64)
                for i, text in enumerate(b.column(1)):
                    s = shingle_set(text.as_py())
                    sizes.append(len(s))
                    prints.append(xxhash.xxh128_hexdigest(s.tobytes()))
                    if len(s):
                        samples[i], sketch[i] = minhash(s), odd_sketch(s)
                keys, sketch = band_keys(samples).view(np.int64), sketch.view(np.int64)
                keys = [k if n else [] for k, n in zip(keys, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sizes, pa.int64()), pa.array(prints), pa.array(keys, pa.list_(pa.int64()))]
                    + [pa.array(sketch[:, i]) for i in range(SKETCH_WORDS)],
                    names=["doc_id", "n_shingles", "print", "keys"] + [f"s{i}" for i in range(SKETCH_WORDS)])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def flips(left: str, right: str):
    """Population count of the XOR of two sketches."""
    total = F.bit_count(F.col(f"{left}.s0").bitwiseXOR(F.col(f"{right}.s0")))
    for i in range(1, SKETCH_WORDS):
        total = total + F.bit_count(F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}")))
    return total


def may_link(left: str, right: str, percent: int):
    """False only for pairs whose sketches rule out a link.

    With n and m elements and similarity J or more, at least
    I = (n + m) J / (1 + J) are common.  Sets within the sample differ in at most
    n + m - 2 I elements.  Of larger ones the samples have about
    SAMPLE * I / max(n, m) in common, less by some deviations at worst.  A sketch
    shows at most as many odd bits as elements differ, and about
    bits / 2 (1 - exp(-2 d / bits)) for d of them."""
    n, m = F.col(f"{left}.n_shingles").cast("double"), F.col(f"{right}.n_shingles").cast("double")
    large, bits = F.greatest(n, m), F.lit(64.0 * SKETCH_WORDS)
    common = (n + m) * F.lit(percent / (100.0 + percent))
    share = F.least(F.lit(1.0), common / large)
    seen = F.when(large <= SAMPLE, common).otherwise(
        SAMPLE * share - DEVIATIONS * F.sqrt(SAMPLE * share * (1 - share)))
    differ = F.least(n, F.lit(SAMPLE)) + F.least(m, F.lit(SAMPLE)) - 2 * seen
    expected = bits / 2 * (1 - F.exp(-2 * differ / bits))
    limit = F.least(differ, expected + DEVIATIONS * F.sqrt(expected * (1 - expected / bits)))
    return (100 * F.least(n, m) >= percent * large) & (flips(left, right) <= limit + 1e-6)


# ---------------------------------------------------------------- verification

def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked; b is the side that repeats."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                text = batch.column(3)[i].as_py()
                if text != last:
                    last, last_set = text, shingle_set(text)
                keep.append(linked(shingle_set(batch.column(2)[i].as_py()), last_set, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {id_type}, b {id_type}")


# ------------------------------------------------------------------- the whole

def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sketch = ["n_shingles", *[f"s{i}" for i in range(SKETCH_WORDS)]]
    sig = written(signatures(texts), "near-signatures")
    some = sig.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))

    # classes of equal sets
    classes = written(some.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
                      .where("n > 1").select("print", "rep"), "near-classes")
    member = some.join(classes, "print", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "keys", *sketch)
    copies = member.where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = written(member.where(F.col("doc_id") == F.col("rep")).select("doc_id", "keys", *sketch)
                   .dropDuplicates(["doc_id", *sketch]), "near-reps")

    # buckets of two or more documents and their centers
    bands = reps.select(F.explode("keys").alias("key"), "doc_id")
    centers = written(bands.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("top"))
                      .where("center < top").select("key", "center"), "near-centers")
    member = written(bands.join(centers, "key"), "near-members")
    a, b = reps.alias("a"), reps.alias("b")
    near = may_link("a", "b", percent)

    # first links: each document with the center it shares most bands with
    star = (member.where(F.col("doc_id") != F.col("center")).groupBy("doc_id", "center").agg(F.count("*").alias("n"))
            .groupBy("doc_id").agg(F.max_by("center", F.struct("n", -F.col("center"))).alias("center")))
    star = (star.alias("p").join(a, F.col("p.doc_id") == F.col("a.doc_id"))
            .join(b, (F.col("p.center") == F.col("b.doc_id")) & near)
            .select(F.col("p.doc_id").alias("a"), F.col("p.center").alias("b")).distinct())
    links = written(verified(star, texts, percent), "near-links")
    label = components(links)

    # other links: members of a bucket outside its center's component
    of = label.select(F.col("node").alias("doc_id"), "component")
    at = label.select(F.col("node").alias("center"), F.col("component").alias("center_component"))
    member = member.join(of, "doc_id", "left").join(at, "center", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"),
        F.coalesce("center_component", "center").alias("center_component"))
    member = written(member, "near-members")
    odd = written(member.where(F.col("component") != F.col("center_component")).select("key").distinct(), "near-odd")
    member = written(member.join(odd, "key").join(reps.select("doc_id", *sketch), "doc_id"), "near-open")
    x, y = member.where(F.col("component") != F.col("center_component")).alias("x"), member.alias("y")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
                   & ((F.col("y.component") == F.col("y.center_component")) | (F.col("x.doc_id") < F.col("y.doc_id")))
                   & may_link("x", "y", percent))
    cross = cross.select(F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).distinct()
    more = verified(written(cross, "near-cross"), texts, percent)

    label = components(links.unionByName(more).unionByName(copies))
    rows = sig.select("doc_id", "n_shingles").join(
        label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_duplicates`` keeps; of rows
    that repeat a doc_id the one with the smallest text."""
    names = [f"`{c}`" for c in docs.columns]
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    repeated = written(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
                       .where("n > 1").select("doc_id"), "near-repeated")
    rows = docs.join(gone, "doc_id", "left_anti").select(*names)
    if repeated.isEmpty():
        return rows
    first = (rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id")
             .agg(F.min_by(F.struct(*names), F.struct(F.col("text").cast("string"))).alias("row")).select("row.*"))
    return rows.join(repeated, "doc_id", "left_anti").select(*names).unionByName(first.select(*names))
