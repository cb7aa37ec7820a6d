"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item with fewer words is one window).  A window's *shingles* are its runs of
three consecutive words (one or two words for windows shorter than that).  A
document holds a window only if it holds all of the window's shingles, so the
necessary prefix of a window (its shingles ordered by rarity over the whole
corpus, containment 1) is its single rarest shingle:

1. one scan counts the corpus frequency of all benchmark shingles;
2. a second scan joins each document's shingles with the prefix shingles,
   keeps the places where the window fits between the document's ends given
   the shingle's position inside the window (length and positional bounds),
   and compares all words of the item-sized window exactly.

The benchmark side is processed in blocks of at most ``block_windows`` distinct
windows, so what is broadcast is bounded; documents are never shuffled.

Defined results: a null or empty text has no words and is hit by nothing;
rows that repeat a doc_id are judged each on its own; a benchmark row without
words contributes no window; a null item_id marks words as hit but is not
listed; repeated benchmark rows count once; an empty benchmark hits nothing.
Extra columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import alnum_words, arrow_schema, filter_texts

WINDOW = 10
BLOCK_WINDOWS = 100_000
SHINGLE = 3
_OUT = "doc_id {id}, n_words long, n_hit long, item_ids array<string>"
_STATE = "doc_id {id}, text string, hits binary, item_ids array<string>"


# ------------------------------------------------------------ benchmark side

def windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the items they occur in: (win, items)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wins = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = alnum_words(text)
                if words:
                    for i in range(max(1, len(words) - window + 1)):
                        ids.append(item)
                        wins.append(b" ".join(words[i:i + window]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.string())],
                                             names=["item", "win"])

    pairs = bench.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return (pairs.mapInArrow(cut, "item string, win string")
            .groupBy("win").agg(F.collect_set("item").alias("items")))


class Block:
    """A bounded set of windows as arrays over word numbers (0: a word that no
    window of the block has).  Shingles are rows of ``SHINGLE`` word numbers
    packed into one integer; missing places are 0."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        rows = sorted((tuple(w.encode().split(b" ")), sorted(items)) for w, items in rows)
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for win, _ in rows for w in win}))}
        self.base = len(self.number) + 1
        self.items = sorted({x for _, items in rows for x in items})
        at = {x: i for i, x in enumerate(self.items)}
        self.window_items = [np.array([at[x] for x in items], np.int64) for _, items in rows]
        self.ids = [np.array([self.number[w] for w in win], np.int64) for win, _ in rows]
        self.length = np.array([len(x) for x in self.ids], np.int64)
        self.shingles = np.unique(np.concatenate(
            [np.zeros(0, np.int64)] + [self.pack(x, min(SHINGLE, len(x))) for x in self.ids]))
        self.sizes = sorted({min(SHINGLE, len(x)) for x in self.ids})

    def pack(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Packed shingles of ``size`` words that start at each place."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code = ids[:n].copy()
        for k in range(1, SHINGLE):
            code *= self.base
            if k < size:
                code += ids[k:k + n]
        return code

    def choose_prefix(self, counts: np.ndarray) -> None:
        """Order each window's shingles by corpus frequency (ties: smaller
        code) and keep the first, as its place and position in the window."""
        prefix = np.zeros(len(self.ids), np.int64)
        self.offset = np.zeros(len(self.ids), np.int64)
        for w, ids in enumerate(self.ids):
            at = np.searchsorted(self.shingles, self.pack(ids, min(SHINGLE, len(ids))))
            best = np.lexsort((at, counts[at]))[0]
            prefix[w], self.offset[w] = at[best], best
        order = np.argsort(prefix, kind="stable")
        self.prefix_windows = order
        self.prefix_start = np.searchsorted(prefix[order], np.arange(len(self.shingles) + 1))

    def doc_ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, one zero after each text, and the number
        of words of each text."""
        get, lengths, parts = self.number.get, [], []
        for text in texts:
            words = alnum_words(text)
            lengths.append(len(words))
            parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
            parts.append(_ZERO)
        return np.concatenate(parts) if parts else _ZERO[:0], np.array(lengths, np.int64)

    def places(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, shingle number) of all benchmark shingles, by shingle size."""
        known = ids > 0
        for size in self.sizes:
            n = len(ids) - size + 1
            if n <= 0:
                continue
            full = known[:n].copy()
            for k in range(1, size):
                full &= known[k:k + n]
            place = np.flatnonzero(full)
            code = ids[place].copy()
            for k in range(1, SHINGLE):
                code *= self.base
                if k < size:
                    code += ids[place + k]
            at = np.searchsorted(self.shingles, code)
            at[at == len(self.shingles)] = 0
            ok = self.shingles[at] == code if len(self.shingles) else np.zeros(len(at), bool)
            yield place[ok], at[ok]

    def match(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hit flag of every place and the items of every text."""
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        mark = np.zeros(len(ids) + 1, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for place, shingle in self.places(ids):
            many = self.prefix_start[shingle + 1] - self.prefix_start[shingle]
            place, shingle, many = place[many > 0], shingle[many > 0], many[many > 0]
            for lo in range(0, len(place), 50_000):
                p, s, m = place[lo:lo + 50_000], shingle[lo:lo + 50_000], many[lo:lo + 50_000]
                first = np.repeat(self.prefix_start[s] - np.cumsum(m) + m, m)
                win = self.prefix_windows[first + np.arange(m.sum())]
                doc = np.repeat(np.searchsorted(ends, p, side="left"), m)
                begin = np.repeat(p, m) - self.offset[win]
                fits = (begin >= starts[doc]) & (begin + self.length[win] <= ends[doc])
                win, doc, begin = win[fits], doc[fits], begin[fits]
                same = np.ones(len(win), bool)
                for size in np.unique(self.length[win]):
                    of = np.flatnonzero(self.length[win] == size)
                    want = np.stack([self.ids[w] for w in win[of]])
                    same[of] = (ids[begin[of][:, None] + np.arange(size)] == want).all(axis=1)
                win, doc, begin = win[same], doc[same], begin[same]
                np.add.at(mark, begin, 1)
                np.add.at(mark, begin + self.length[win], -1)
                found.append((doc, win))
        items: list[np.ndarray] = [_ZERO[:0]] * len(lengths)
        if found:
            doc, win = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            for d, w in {(int(a), int(b)) for a, b in zip(doc, win)}:
                items[d] = np.union1d(items[d], self.window_items[w])
        return np.cumsum(mark[:-1]) > 0, items


_ZERO = np.zeros(1, np.int64)


# ------------------------------------------------------------- document side

def _count_shingles(docs: DataFrame, shared) -> dict[int, int]:
    """Corpus frequency of the block's shingles; one row per shingle returns."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = shared.value, None
        for b in batches:
            total = np.zeros(len(block.shingles), np.int64) if total is None else total
            for _, s in block.places(block.doc_ids(b.column(0).to_pylist())[0]):
                total += np.bincount(s, minlength=len(total))
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["shingle", "n"])

    rows = (docs.select("text").mapInArrow(count, "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n").alias("n")).collect())
    return {r["shingle"]: r["n"] for r in rows}


def _apply_block(state: DataFrame, shared, id_type: str, first: bool, last: bool) -> DataFrame:
    ddl = (_OUT if last else _STATE).format(id=id_type)
    schema = arrow_schema(state.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            ids, lengths = block.doc_ids(texts)
            hit, found = block.match(ids, lengths)
            begin = np.cumsum(lengths + 1) - lengths - 1
            flags = [hit[a:a + n] for a, n in zip(begin, lengths)]
            items = [[block.items[i] for i in x] for x in found]
            if not first:
                for i, (old, more) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                    flags[i] = flags[i] | np.unpackbits(np.frombuffer(old, np.uint8),
                                                        count=len(flags[i])).astype(bool)
                    items[i] = sorted({*items[i], *more})
            if last:
                cols = [b.column(0), pa.array(lengths), pa.array([int(f.sum()) for f in flags], pa.int64()),
                        pa.array(items, pa.list_(pa.string()))]
            else:
                cols = [b.column(0), b.column(1), pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
                        pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return state.mapInArrow(run, ddl)


def _blocks(docs: DataFrame, bench: DataFrame, window: int, block_windows: int) -> list:
    """Broadcast blocks of windows whose prefixes follow the rarity in ``docs``."""
    spark = docs.sparkSession
    wins = windows(bench, window)
    n_blocks = max(1, -(-wins.count() // block_windows))
    shared = []
    for k in range(n_blocks):
        part = wins if n_blocks == 1 else wins.where(F.pmod(F.xxhash64("win"), F.lit(n_blocks)) == k)
        block = Block([(r["win"], r["items"]) for r in part.collect()])
        counts = np.zeros(len(block.shingles), np.int64)
        for at, n in _count_shingles(docs, spark.sparkContext.broadcast(block)).items():
            counts[at] = n
        block.choose_prefix(counts)
        shared.append(spark.sparkContext.broadcast(block))
    return shared


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, item_ids (sorted as strings)."""
    state = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    id_type = state.schema["doc_id"].dataType.simpleString()
    shared = _blocks(state, bench, window, block_windows)
    for k, part in enumerate(shared):
        state = _apply_block(state, part, id_type, k == 0, k == len(shared) - 1)
    return state


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs."""
    def keep(shared):
        def fn(texts: list[str | None]) -> list[bool]:
            ids, lengths = shared.value.doc_ids(texts)
            hit, _ = shared.value.match(ids, lengths)
            begin = np.cumsum(lengths + 1) - lengths - 1
            return [not hit[a:a + n].any() for a, n in zip(begin, lengths)]
        return fn

    for part in _blocks(docs.select(F.col("text").cast("string").alias("text")), bench, window, block_windows):
        docs = filter_texts(docs, keep(part))
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The report columns of ``decontaminate``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))

