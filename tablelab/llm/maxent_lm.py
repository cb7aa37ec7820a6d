"""Hashed maximum-entropy language model.

A token's probability is factored over classes,

    p(w | history) = p(class(w) | history) * p(w | class(w)).

* ``p(class | history)`` is a log-linear (maximum-entropy) model: the history's
  features (previous word, previous two words, the word before the previous
  one, and pairs of classes one, three and five tokens back: n-grams and
  skips) are hashed into ``BUCKETS`` rows of class weights, which are added and
  normalised by a softmax over the ``CLASSES`` classes.
* ``p(w | class)`` has one weight per word, whose maximum-likelihood value needs
  no training: (c + 1) / (N_class + V_class + 1) from the corpus counts; an unseen
  word is the one extra word of its class.

Classes: the end of text, the most frequent words, the word endings with most
tokens, and hashed classes for the rest; all from counts over the corpus.

Jobs:

1. texts become dictionary-encoded blocks (distinct word hashes, one number
   per token), written to the shared folder; nothing below reads text again;
2. exact counts of all training words (a shuffle of each block's distinct words);
3. training: all training documents are dealt over ``ROUNDS`` rounds; in each,
   tasks run gradient updates from the current weights over their documents,
   and their updates are summed per weight row by Spark (weighted by how often
   a row was used) and added on the driver (``BUCKETS`` x ``CLASSES`` numbers);
4. blocks look up their words' counts with a join by word, and are scored in
   numpy, ``CHUNK`` tokens at a time.

The vocabulary is never broadcast or collected.  Defined results: null, empty
and white-space texts are their end token alone; a null doc_id counts as
training; without training documents N = V = 0; repeated rows each get their
row and count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import crc_bucket, space_words, written

BUCKETS = 1 << 13
CLASSES = 64
TOP_WORDS = 24
TOP_ENDINGS = 31  # the rest of the classes is hashed
ROUNDS = 3
CHUNK = 8192
RATE = 0.25
BLOCK_TOKENS = 3_000_000
SLICE_TOKENS = 200_000
SHAPES = 1 << 20
WEIGHT_BLOCKS = 16
PLACE_BITS = 24   # places of words in a block; block numbers are partition * 2^12 + a counter
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


# ------------------------------------------------------------------- blocks

class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def ending(word: bytes) -> bytes:
    """Word ending: trailing punctuation mark, if any, and the last letters."""
    text = word.decode()
    body = text.rstrip(".,;:!?\"')")
    return (body[-3:] + "|" + text[len(body):][:1]).encode()


def to_planes(codes: np.ndarray) -> bytes:
    """Numbers below 2^24 as three planes of bytes; the high ones compress well."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes()


def from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int32)
    return planes[0] | planes[1] << 8 | planes[2] << 16


_BLOCK = ("block long, doc_ids array<{id}>, held_out array<boolean>, lengths array<int>, "
          "words binary, shapes binary, counts binary, codes binary")


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Dictionary-encoded blocks of whole documents.  words: uint64 hashes of a
    block's distinct words; shapes: hashed endings; counts: occurrences in
    training documents; codes: per token the place of its word."""
    ddl = _BLOCK.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 12
        ids, held, codes, numbers, size = [], [], [], _Numbers(), 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(codes)
            keep = np.repeat(~np.array(held, bool), [len(c) for c in codes])
            words = list(numbers)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([at], pa.int64()), "doc_ids": [ids], "held_out": [held],
                "lengths": pa.array([[len(c) for c in codes]], pa.list_(pa.int32())),
                "words": pa.array([np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).tobytes()]),
                "shapes": pa.array([np.fromiter((xxhash.xxh32_intdigest(ending(w)) % SHAPES for w in words),
                                                np.int32, len(words)).tobytes()]),
                "counts": pa.array([np.bincount(flat[keep], minlength=len(words)).astype(np.int32).tobytes()]),
                "codes": pa.array([to_planes(flat)])})

        for b in batches:
            for doc_id, text, out in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                words = space_words(text.as_py())
                ids.append(doc_id), held.append(out)
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(words) + 1
                if size >= block_tokens:
                    yield flush()
                    at += 1
                    ids, held, codes, numbers, size = [], [], [], _Numbers(), 0
        if ids:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), "held_out").mapInArrow(run, ddl)


# -------------------------------------------------------------------- classes

@dataclass
class Classes:
    words: np.ndarray      # sorted hashes of the words with classes of their own
    word_class: np.ndarray
    shapes: np.ndarray     # class of each hashed ending, 0: none
    total: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.int64))     # N_class
    distinct: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.int64))  # V_class

    def of(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        first = 1 + TOP_WORDS + TOP_ENDINGS
        out = (first + words % np.uint64(CLASSES - first)).astype(np.uint8)
        by_shape = self.shapes[shapes]
        out = np.where(by_shape > 0, by_shape, out)
        if len(self.words):
            at = np.searchsorted(self.words, words)
            at[at == len(self.words)] = 0
            out = np.where(self.words[at] == words, self.word_class[at], out)
        return out


def learn_classes(vocabulary: DataFrame) -> Classes:
    """``vocabulary``: (word, shape, c).  The driver gets the chosen words and
    endings and, below, one row per class."""
    top = vocabulary.orderBy(F.desc("c"), "word").limit(TOP_WORDS).collect()
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    ends = (vocabulary.where(~F.col("word").isin([r["word"] for r in top])).groupBy("shape")
            .agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "shape").limit(TOP_ENDINGS).collect())
    shapes = np.zeros(SHAPES, np.uint8)
    for i, r in enumerate(ends):
        shapes[r["shape"]] = 1 + TOP_WORDS + i
    classes = Classes(words[order], (1 + order).astype(np.uint8), shapes)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = classes.of(b["word"].to_numpy().view(np.uint64), b["shape"].to_numpy())
            n = np.bincount(k, weights=b["c"].to_numpy(), minlength=CLASSES).astype(np.int64)
            yield pd.DataFrame({"k": np.arange(CLASSES), "n": n, "v": np.bincount(k, minlength=CLASSES)})

    for r in (vocabulary.mapInPandas(totals, "k int, n long, v long").groupBy("k")
              .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()):
        classes.total[r["k"]], classes.distinct[r["k"]] = r["n"], r["v"]
    return classes


# -------------------------------------------------------------------- features

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


@dataclass
class Tokens:
    """Token sequence of some documents: word hashes, classes, places in them."""
    word: np.ndarray
    cls: np.ndarray
    place: np.ndarray


def tokens(words: np.ndarray, classes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> Tokens:
    """Every document's tokens and its end (class 0)."""
    full = lengths + 1
    place = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    is_end = place == np.repeat(lengths, full)
    word, cls = np.full(len(place), END), np.zeros(len(place), np.uint8)
    word[~is_end], cls[~is_end] = words[codes], classes[codes]
    return Tokens(word, cls, place)


def features(t: Tokens, a: int, b: int) -> list[np.ndarray]:
    """Bucket of each feature for the tokens a..b."""
    def back(values: np.ndarray, k: int, start) -> np.ndarray:
        out = np.full(b - a, start, values.dtype)
        use = t.place[a:b] >= k
        out[use] = values[np.flatnonzero(use) + (a - k)]
        return out

    w1, w2 = back(t.word, 1, START), back(t.word, 2, START)
    c = [back(t.cls, k, CLASSES).astype(np.uint64) for k in range(1, 7)]
    raw = [w1, w1 * np.uint64(3) + w2 * np.uint64(0xB5297A4D1B56C4E9), w2,
           c[0] * np.uint64(256) + c[1], c[2] * np.uint64(256) + c[3], c[4] * np.uint64(256) + c[5]]
    return [(_mix(x + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) % np.uint64(BUCKETS)).astype(np.int64)
            for i, x in enumerate(raw)]


def log_softmax(weights: np.ndarray, bias: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
    z = weights[buckets[0]] + bias
    for x in buckets[1:]:
        z += weights[x]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


# -------------------------------------------------------------------- training

@dataclass
class Weights:
    rows: np.ndarray   # BUCKETS x CLASSES
    bias: np.ndarray   # CLASSES
    past: np.ndarray   # per row: summed squared gradient (for step sizes)


def initial(classes: Classes, ends: int) -> Weights:
    n = classes.total.copy()
    n[0] = ends
    p = (n + 1) / (n + 1).sum()
    return Weights(np.zeros((BUCKETS, CLASSES), np.float32), np.log(p).astype(np.float32),
                   np.zeros(BUCKETS, np.float32))


def descend(w: Weights, t: Tokens, used: np.ndarray) -> None:
    """Gradient updates over all tokens, ``CHUNK`` at a time; ``used`` counts
    how often each weight row was."""
    for a in range(0, len(t.word), CHUNK):
        b = min(a + CHUNK, len(t.word))
        at = features(t, a, b)
        g = np.exp(log_softmax(w.rows, w.bias, at))
        g[np.arange(b - a), t.cls[a:b]] -= 1
        for x in at:
            order = np.argsort(x.astype(np.uint16), kind="stable")
            s = x[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            row, n = s[first], np.diff(np.append(first, len(s)))
            step = np.add.reduceat(g[order], first, axis=0) / np.sqrt(n)[:, None].astype(np.float32)
            w.past[row] += (step * step).mean(axis=1)
            w.rows[row] -= (RATE / CLASSES ** 0.5 / np.sqrt(w.past[row] + 1e-6))[:, None] * step
            used[row] += n


def train(table: DataFrame, classes: Classes, w: Weights, rounds: int = ROUNDS) -> Weights:
    """``rounds`` rounds over disjoint shares of the training documents."""
    spark = table.sparkSession
    shared_classes = spark.sparkContext.broadcast(classes)
    size = BUCKETS // WEIGHT_BLOCKS

    for r in range(rounds):
        start = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], r: int = r, start=start) -> Iterator[pa.RecordBatch]:
            base, mine, used = start.value, None, np.zeros(BUCKETS, np.int64)
            for b in batches:
                for row in b.to_pylist():
                    t = share_of(row, shared_classes.value, r, rounds)
                    if t is not None:
                        mine = mine or Weights(base.rows.copy(), base.bias, base.past.copy())
                        descend(mine, t, used)
            if mine is not None:
                n = used[:, None].astype(np.float32)
                packed = np.hstack([(mine.rows - base.rows) * n, (mine.past - base.past)[:, None] * n, n]).astype(np.float32)
                parts = packed.reshape(WEIGHT_BLOCKS, -1)
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(WEIGHT_BLOCKS), pa.int32()),
                                                  "x": pa.array([p.tobytes() for p in parts])})

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                    x = np.frombuffer(x.as_buffer(), np.float32)
                    sums[k] = sums[k] + x if k in sums else x.astype(np.float64)
            if sums:
                yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int32()),
                                                  "x": pa.array([s.tobytes() for s in sums.values()])})

        updates = table.select("held_out", "lengths", "words", "shapes", "codes").mapInArrow(run, "k int, x binary")
        for row in updates.repartition(WEIGHT_BLOCKS, "k").mapInArrow(total, "k int, x binary").groupBy("k").agg(
                F.first("x").alias("x")).collect():
            x = np.frombuffer(row["x"], np.float64).reshape(size, CLASSES + 2)
            at, n = slice(row["k"] * size, (row["k"] + 1) * size), np.maximum(x[:, -1:], 1)
            w.rows[at] += (x[:, :CLASSES] / n).astype(np.float32)
            w.past[at] += (x[:, CLASSES] / n[:, 0]).astype(np.float32)
    return w


def share_of(row: dict, classes: Classes, r: int, rounds: int) -> Tokens | None:
    """Tokens of the training documents of a block that round r is about."""
    lengths = np.array(row["lengths"], np.int64)
    use = ~np.array(row["held_out"], bool) & (np.arange(len(lengths)) % rounds == r)
    if not use.any():
        return None
    words, shapes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["shapes"], np.int32)
    codes = from_planes(row["codes"])[np.repeat(use, lengths)]
    return tokens(words, classes.of(words, shapes), codes, lengths[use])


# --------------------------------------------------------------------- scoring

def score_block(row: dict, c: np.ndarray, classes: Classes, w: Weights, n_all: int, v_all: int, ends: int) -> dict:
    """Scores of a block's documents; ``c``: corpus counts of its words."""
    words, shapes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["shapes"], np.int32)
    cls = classes.of(words, shapes) if len(words) else np.zeros(0, np.uint8)
    lengths, codes = np.array(row["lengths"], np.int64), from_planes(row["codes"])
    total, distinct = classes.total.copy(), classes.distinct.copy()
    total[0], distinct[0] = ends, int(ends > 0)
    below = np.log10(total + distinct + 1)
    start = np.cumsum(lengths) - lengths
    parts, a = [], 0
    while a < len(lengths):   # whole documents, about SLICE_TOKENS tokens at a time
        b = max(a + 1, int(np.searchsorted(start, start[a] + SLICE_TOKENS)))
        use = slice(start[a], start[b - 1] + lengths[b - 1])
        t, full = tokens(words, cls, codes[use], lengths[a:b]), lengths[a:b] + 1
        is_end = t.place == np.repeat(lengths[a:b], full)
        count = np.full(len(t.word), ends, np.int64)
        count[~is_end] = c[codes[use]]
        logs = np.log10(count + 1)
        model = logs - below[t.cls]
        for lo in range(0, len(t.word), CHUNK):
            hi = min(lo + CHUNK, len(t.word))
            z = log_softmax(w.rows, w.bias, features(t, lo, hi))
            model[lo:hi] += z[np.arange(hi - lo), t.cls[lo:hi]] / math.log(10)
        at = np.cumsum(full) - full
        parts.append((full, np.add.reduceat((count > 0).astype(np.int64), at),
                      np.add.reduceat(logs, at) - full * math.log10(n_all + v_all + 1), np.add.reduceat(model, at)))
        a = b
    return dict(zip(("n_tokens", "n_known", "base_score", "score"), map(np.concatenate, zip(*parts))))


def score(docs: DataFrame, rounds: int = ROUNDS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row; ``docs`` has doc_id, text and held_out."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    table = written(blocks(docs, block_tokens), "lm-blocks", compression="zstd")

    def words(with_counts: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    h = np.frombuffer(row["words"], np.int64)
                    if with_counts:
                        n = np.frombuffer(row["counts"], np.int32)
                        cols = [h[n > 0], np.frombuffer(row["shapes"], np.int32)[n > 0], n[n > 0].astype(np.int64)]
                        names = ["word", "shape", "c"]
                    else:
                        at = (row["block"] << PLACE_BITS) + np.arange(len(h))
                        cols, names = [h, at], ["word", "at"]
                    for lo in range(0, len(cols[0]), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + 100_000]) for x in cols], names=names)
        return run

    counted = table.select("words", "shapes", "counts").mapInArrow(words(True), "word long, shape int, c long")
    vocabulary = written(counted.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("c").alias("c")), "lm-words", compression="zstd")
    ends = table.select(F.explode("held_out").alias("h")).where("not h").count()
    whole = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = (whole["n"] or 0) + ends, whole["v"] + int(ends > 0)
    classes = learn_classes(vocabulary)
    weights = train(table, classes, initial(classes, ends), rounds)
    shared = spark.sparkContext.broadcast((classes, weights))

    found = (table.select("block", "words").mapInArrow(words(False), "word long, at long")
             .join(vocabulary.select("word", "c"), "word")
             .select(F.shiftright("at", PLACE_BITS).alias("block"), "at", "c"))
    # place in the block and count in one number
    found = found.select("block", (F.shiftleft("c", PLACE_BITS) + F.col("at").bitwiseAND((1 << PLACE_BITS) - 1)).alias("c"))
    ddl = (f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")

    def run(block: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in block.to_dict("records"):
            c = np.zeros(len(row["words"]) // 8, np.int64)
            packed = counts["c"].to_numpy()
            c[packed & ((1 << PLACE_BITS) - 1)] = packed >> PLACE_BITS
            got = score_block(row, c, *shared.value, n_all, v_all, ends)
            out.append(pd.DataFrame({"doc_id": pd.Series(list(row["doc_ids"]), dtype=object),
                                     "held_out": np.array(row["held_out"], bool)} | got))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    rows = (table.select("block", "doc_ids", "held_out", "lengths", "words", "shapes", "codes").groupBy("block")
            .cogroup(found.groupBy("block")).applyInPandas(run, ddl))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
                       "base_score", "score")


def held_out():
    return F.coalesce(crc_bucket("doc_id", 7) == 2, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text", held_out().alias("held_out")))
