"""Removal of repeated passages with compressed FM-indexes.

A window is ``window`` consecutive words of one document.  Words covered by a
window whose word sequence also starts in a document with a smaller id are
removed; windows are judged on the input.

1. *Shards by content.*  A window's anchor is the smallest hash of its runs of
   ``ANCHOR_WORDS`` words, so equal windows have equal anchors.  Consecutive
   windows with one anchor form a segment (at most ``RUN`` windows).  Only anchors
   in more than one document matter: tasks send each of their anchors once, with one
   document, and learn which of them others have, too (``shared_anchors``).
   Segments of shared anchors are dealt by anchor, equal ones of a task as one row
   with the smallest and largest id of their documents.  Anchors of very many
   documents (a frequent phrase, the edge of a frequent passage) have their windows
   dealt one by one, by the hash of the whole window.
2. *Index per shard.*  A shard's segments, in chunks of bounded size that keep an
   anchor together, make an FM-index: suffix array by doubling, Burrows-Wheeler transform as a wavelet matrix of packed bits
   with one count per 64.  The segments are streamed through it by backward
   search, all at once; their matching statistics are the suffix-array intervals
   of at least ``window`` words, and the smallest document of an interval is the
   minimum of the document array over all suffixes with the same first words.
   (An anchor with a single sequence of words needs no search: no other one can
   share its windows.)
3. *Back to the documents.*  Documents' segments are joined with the reported ones
   (a hot segment is a skewed join side of many rows against one, which adaptive
   execution splits) and the covered words are cut.  The texts are shuffled once, by
   a 61-bit hash of id and text, for both steps.

Defined results: null and empty texts have no words; texts of fewer words than a
window keep them all; a window that repeats within one document only stays, so do
windows shared by rows with one id; rows without an id come after all others and
make no other row lose words; an empty table gives no rows; extra columns are
ignored.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import written

WINDOW = 13
ANCHOR_WORDS = 4
RUN = 32                 # windows of a segment at most
STEP_BYTES = 4 << 20     # text that a task works on at a time
ROWS_TOGETHER = 200_000  # segments that a task compares before it hands them on
CHUNK_BYTES = 2 << 20    # text of one index
HOT_MOST = 32_768        # documents of an anchor whose segments are dealt together
HOT_LEAST = 256
HOT_LIST = 1 << 20       # anchors in the list of frequent ones at most
NO_ID = (1 << 63) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# --------------------------------------------------------------- words and segments

def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Words:
    """Words of several texts in one buffer, one space behind each."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[raw]
        keep = ~space
        keep[1:] |= keep[:-1]
        at = np.cumsum(keep)
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        flat = np.where(space, 0x20, raw)[keep].astype(np.uint8)
        self.buffer = flat.tobytes()
        self.ends = np.flatnonzero(flat == 0x20)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        place = np.concatenate([[0], at])[edges]       # place of each text in the buffer
        self.first = np.searchsorted(self.ends, place)  # number of the first word of each text, and the end
        self.flat = flat

    def hashes(self) -> np.ndarray:
        if not len(self.ends):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts + 1
        inside = np.arange(len(self.flat)) - np.repeat(self.starts, size)
        product = (self.flat.astype(np.uint64) + np.uint64(1)) * _multipliers(int(size.max()))[inside]
        return _mixed(np.add.reduceat(product, self.starts))


def segments(words: Words, window: int, hot: np.ndarray, shared: list | None = None):
    """(route, first word, windows, text number) of all segments, or of those whose
    anchors are among the text's ``shared`` ones, as arrays."""
    h, first = words.hashes(), words.first
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = owner[:n] == owner[window - 1:]
    grams = min(ANCHOR_WORDS, window)
    m = _multipliers(grams)
    g = sum((h[k:len(h) - grams + 1 + k] * m[k] for k in range(grams)), np.uint64(0))
    g = _mixed(g)
    span, have = window - grams + 1, 1
    while have < span:  # smallest of ``span`` neighbours by doubling
        step = min(have, span - have)
        g = np.minimum(g[:-step], g[step:])
        have += step
    anchor = (g[:n] >> np.uint64(3)).astype(np.int64)
    at = np.flatnonzero(valid)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    a, o = anchor[at], owner[at]
    if shared is not None:
        # (text, anchor) as one number each; a collision would only send a segment too many
        both = lambda t, x: x.view(np.uint64) + _mixed(t.astype(np.uint64) + np.uint64(1))
        size = np.array([len(x) for x in shared])
        wanted = both(np.repeat(np.arange(len(shared)), size), np.concatenate(shared))
        change = np.ones(len(at), bool)
        change[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
        kept = np.isin(both(o[change], a[change]), wanted)[np.cumsum(change) - 1]
        at, a, o = at[kept], a[kept], o[kept]
        if not len(at):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
    frequent = np.isin(a, hot) if len(hot) else np.zeros(len(a), bool)
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1]) | (at[1:] != at[:-1] + 1) | frequent[1:]
    head = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(inside % RUN == 0)
    count = np.diff(np.append(head, len(at)))
    route = a[head].copy()
    if frequent.any():
        q, whole = _multipliers(window), np.zeros(n, np.uint64)
        for k in range(window):
            whole += h[k:k + n] * q[k]
        route = np.where(frequent[head], (_mixed(whole)[at[head]] >> np.uint64(3)).astype(np.int64), route)
    return route, at[head], count, o[head]


def _steps(batches) -> Iterator[list]:
    """Lists of column values with at most about ``STEP_BYTES`` of text (the last column, as bytes)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy().astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + STEP_BYTES, side="right")))
            yield [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns)]
            lo = hi


def _cut(texts: list[bytes], window: int, hot: np.ndarray, shared: list | None = None):
    """route, key and text of each segment, its first word within its text, and the text's number."""
    words = Words(texts)
    route, at, count, owner = segments(words, window, hot, shared)
    buffer = words.buffer
    lo = words.starts[at] if len(at) else at
    hi = words.ends[at + count + window - 2] if len(at) else at
    blobs = [buffer[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
    digest = xxhash.xxh3_64_intdigest
    key = np.fromiter((digest(x) for x in blobs), np.uint64, len(blobs)).astype(np.int64)
    return route, key, blobs, at - words.first[owner] if len(at) else at, owner


# ------------------------------------------------------------------------ FM-index

class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit row per bit of the symbols,
    with the number of ones before every 64."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.rows, self.before, self.zeros = [], [], []
        n = len(symbols)
        for b in range(self.bits - 1, -1, -1):
            bit = ((symbols >> b) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[:len(some)] = some
            row = packed.view("<u8")
            ones = np.bitwise_count(row).astype(np.int64)
            self.rows.append(row)
            self.before.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(n - int(ones.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.origin = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, (row, before, zeros) in enumerate(zip(self.rows, self.before, self.zeros)):
            block = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(row[block] & mask)
            bit = (symbol >> (self.bits - 1 - level)) & 1
            place = np.where(bit == 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``place`` symbols."""
        return self._walk(symbol, place) - self.origin[symbol]


class FMIndex:
    """Index of word sequences for backward search.

    ``words`` are ids from 0, ``bounds`` the sequences' edges.  ``group`` numbers
    the suffixes, in suffix-array order, by their first ``window`` words."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, window: int):
        sequences = len(bounds) - 1
        self.owner = np.repeat(np.arange(sequences), np.diff(bounds) + 1)
        self.size = n = len(words) + sequences
        text = np.empty(n, np.int64)
        place = np.arange(len(words)) + np.repeat(np.arange(sequences), np.diff(bounds))
        last = bounds[1:] + np.arange(sequences)
        text[last] = np.arange(sequences)            # every end of a sequence is a symbol of its own
        text[place] = words + sequences
        order, groups = self._suffixes(text, window)
        self.owner, self.group = self.owner[order], groups
        before = text[order - 1] - sequences + 1     # ends of sequences are symbol 0
        size = int(words.max(initial=-1)) + 2
        counts = np.bincount(words + 1, minlength=size)
        self.least = sequences + np.cumsum(counts) - counts
        self.ranks = WaveletMatrix(np.maximum(before, 0), size)
        self.symbols = size

    @staticmethod
    def _suffixes(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(text)
        rank, k, kept = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, None
        while True:
            if kept is None and 2 * k > window:
                kept = (rank, window - k)            # two overlapping ranks tell windows apart
            second = np.zeros(n, np.int64)
            second[:n - k] = rank[k:] + 1
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            changed = np.ones(n, bool)
            changed[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(changed) - 1
            if changed.all():
                break
            k *= 2
        if kept is None:
            return order, np.arange(n)
        a, shift = kept
        b = np.full(n, -1, np.int64)
        b[:n - shift] = a[shift:]
        a, b = a[order], b[order]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return order, np.cumsum(new) - 1

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + string, given those of the strings."""
        m = len(symbol)
        both = self.ranks.rank(np.concatenate([symbol, symbol]) + 1, np.concatenate([lo, hi]))
        base = self.least[symbol + 1]
        return base + both[:m], base + both[m:]

    def matches(self, words: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
        """For every place of the streamed sequences the first suffix of an
        interval whose suffixes begin with the ``window`` words there, or -1.
        Ids below 0 or unknown to the index match nothing.

        Every sequence is read backwards; where no suffix is left, the search goes
        on from the longest end that a window not yet ruled out can have."""
        found = np.full(len(words), -1, np.int64)
        start, end = bounds[:-1].copy(), bounds[1:].copy()
        at, lo, hi = end.copy(), np.zeros(len(end), np.int64), np.full(len(end), self.size)
        active = np.flatnonzero(end - start >= window)
        while len(active):
            symbol = words[at[active] - 1]
            known = (symbol >= 0) & (symbol < self.symbols - 1)
            low, high = self.extend(np.where(known, symbol, 0), lo[active], hi[active])
            good = known & (low < high)
            g = active[good]
            at[g] -= 1
            lo[g], hi[g] = low[good], high[good]
            long = end[g] - at[g] >= window
            found[at[g[long]]] = lo[g[long]]
            b = active[~good]
            if len(b):
                fails = at[b] - 1
                end[b] = np.where(~known[~good], fails,
                                  np.where(end[b] - at[b] >= window, fails + window, end[b] - 1))
                at[b], lo[b], hi[b] = end[b], 0, self.size
            active = active[(at[active] > start[active]) & (end[active] - start[active] >= window)]
        return found


def smallest_documents(blobs: list[bytes], first: np.ndarray, window: int) -> list[np.ndarray]:
    """For every window of the (different) sequences the smallest document that
    has it, given the smallest document of each sequence."""
    flat = b" ".join(blobs).split(b" ")
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
    bounds = np.concatenate([[0], np.cumsum([b.count(b" ") + 1 for b in blobs], dtype=np.int64)])
    index = FMIndex(words, bounds, window)
    heads = np.flatnonzero(np.diff(index.group, prepend=-1))
    least = np.minimum.reduceat(first[index.owner], heads)
    found = index.matches(words, bounds, window)
    docs = least[index.group[found]]
    return [docs[a:b - window + 1] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


# ---------------------------------------------------------------------- Spark jobs

def _texts(docs: DataFrame) -> DataFrame:
    """rk, d, text: a hash of id and text, the id (rows without one come last), the bytes."""
    text = F.col("text").cast("string")
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(F.shiftrightunsigned(F.xxhash64(d, text), 3).alias("rk"), d.alias("d"), text.cast("binary").alias("text"))


def shared_anchors(texts: DataFrame, window: int) -> DataFrame:
    """k, rk: the anchors of every text that stand in other texts, too (written).

    A task sends an anchor of one text as (k, rk), an anchor of several texts as
    one marker; its own texts with such an anchor are known at once and go on by
    rk.  So an anchor of any number of documents is one row per task."""
    ask, mark, know = 0, 1, 2
    none = np.zeros(0, np.int64)

    def send(batches):
        held, n = [], 0

        def out():
            k, rk = (np.concatenate([h[i] for h in held]) for i in range(2))
            order = np.lexsort((rk, k))
            k, rk = k[order], rk[order]
            once = np.ones(len(k), bool)
            once[1:] = (k[1:] != k[:-1]) | (rk[1:] != rk[:-1])
            k, rk = k[once], rk[once]
            head = np.flatnonzero(np.diff(k, prepend=-1))
            size = np.diff(np.append(head, len(k)))
            alone, many = head[size == 1], head[size > 1]
            local = np.flatnonzero(np.repeat(size > 1, size))
            route = np.concatenate([k[alone], k[many], rk[local]])
            other = np.concatenate([rk[alone] << 2 | ask, rk[many] << 2 | mark, k[local] << 2 | know])
            for lo in range(0, len(route), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(route[lo:lo + 50_000]), pa.array(other[lo:lo + 50_000])], names=["route", "other"])

        for rk, _, text in _steps(batches):
            words = Words([t.as_py() for t in text])
            k, _, _, owner = segments(words, window, none)
            held.append((k, rk.to_numpy()[owner]))
            n += len(k)
            if n >= ROWS_TOGETHER:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def answer(batches):
        rest = np.zeros((2, 0), np.int64)
        for batch in chain(batches, [None]):
            rows = rest if batch is None else np.concatenate([rest, [batch.column(0).to_numpy(), batch.column(1).to_numpy()]], axis=1)
            if not rows.shape[1]:
                continue
            cut = rows.shape[1] if batch is None else int(np.searchsorted(rows[0], rows[0, -1]))
            rows, rest = rows[:, :cut], rows[:, cut:]
            kind = rows[1] & 3
            known = rows[:, kind == know]
            asked = rows[:, kind != know]
            head = np.flatnonzero(np.diff(asked[0], prepend=-1))
            if len(head):
                size = np.diff(np.append(head, asked.shape[1]))
                rk, marked = asked[1] >> 2, np.add.reduceat(asked[1] & 3, head) > 0
                differ = marked | (np.minimum.reduceat(rk, head) < np.maximum.reduceat(rk, head))
                asked = asked[:, np.repeat(differ, size) & ((asked[1] & 3) == ask)]
            k, rk = np.concatenate([asked[0], known[1] >> 2]), np.concatenate([asked[1] >> 2, known[0]])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(rk)], names=["k", "rk"])

    sent = texts.where(F.col("text").isNotNull()).select("rk", "d", "text").mapInArrow(send, "route long, other long")
    return written(sent.repartition("route").sortWithinPartitions("route").mapInArrow(answer, "k long, rk long"), "shared-anchors")


def frequent_anchors(shared: DataFrame) -> np.ndarray:
    """Anchors of so many documents that their windows are dealt one by one (at most
    ``HOT_LIST``; beyond that only the chunk of a less frequent one grows)."""
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = min(HOT_MOST, max(HOT_LEAST, shared.count() // (4 * parts)))
    rows = (shared.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot)
            .orderBy(F.desc("n"), "k").limit(HOT_LIST).collect())
    return np.array(sorted(r["k"] for r in rows), np.int64)


def _segments_once(route, key, doc, blobs):
    """One row for equal segments, with their smallest and largest document."""
    order = np.lexsort((doc, key, route))
    r, s, d = route[order], key[order], doc[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(r)) - 1
    return r[head], s[head], d[head], d[tail], [blobs[i] for i in order[head].tolist()]


_SEGMENT = "k long, seg long, first long, last long, blob binary"


def _wanted(batches):
    """Steps of (rk, d, shared anchors of each text as arrays, texts)."""
    for rk, d, ks, text in _steps(batches):
        edge, flat = ks.offsets.to_numpy(), ks.values.to_numpy()
        yield rk, d, [flat[a:b] for a, b in zip(edge[:-1], edge[1:])], [t.as_py() for t in text]


def dealt_segments(wanted: DataFrame, window: int, hot) -> DataFrame:
    def run(batches):
        held, n = [], 0

        def out():
            r, s, d = (np.concatenate([h[i] for h in held]) for i in range(3))
            r, s, a, z, blobs = _segments_once(r, s, d, [b for h in held for b in h[3]])
            for lo in range(0, len(r), 20_000):
                hi = lo + 20_000
                yield pa.RecordBatch.from_arrays([pa.array(r[lo:hi]), pa.array(s[lo:hi]), pa.array(a[lo:hi]), pa.array(z[lo:hi]),
                                                  pa.array(blobs[lo:hi], pa.binary())], names=["k", "seg", "first", "last", "blob"])

        for _, d, ks, texts in _wanted(batches):
            route, key, blobs, _, owner = _cut(texts, window, hot.value, ks)
            held.append((route, key, d.to_numpy()[owner] if len(owner) else owner, blobs))
            n += len(route)
            if n >= ROWS_TOGETHER:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    return wanted.mapInArrow(run, _SEGMENT)


def solve_shards(dealt: DataFrame, window: int) -> DataFrame:
    """k, seg, docs: the smallest document of each window of the segments in which
    some document loses words."""
    def solve(rows):
        r, s, a, z, blobs = rows
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        head = np.flatnonzero(new)
        a, z = np.minimum.reduceat(a, head), np.maximum.reduceat(z, head)
        r, s, blobs = r[head], s[head], [blobs[i] for i in head.tolist()]
        group = np.flatnonzero(np.diff(r, prepend=r[0] - 1))
        shared = np.minimum.reduceat(a, group) < np.maximum.reduceat(z, group)
        keep = np.flatnonzero(np.repeat(shared, np.diff(np.append(group, len(r)))))
        if not len(keep):
            return None
        r, s, a, z, blobs = r[keep], s[keep], a[keep], z[keep], [blobs[i] for i in keep.tolist()]
        # an anchor with one sequence of words shares its windows with no other sequence
        alone = np.repeat(*(lambda c: (c == 1, c))(np.unique(r, return_counts=True)[1]))
        least: list = [None] * len(r)
        for i in np.flatnonzero(alone).tolist():
            least[i] = np.full(blobs[i].count(b" ") + 2 - window, a[i])
        among = np.flatnonzero(~alone)
        if len(among):
            for i, m in zip(among.tolist(), smallest_documents([blobs[i] for i in among.tolist()], a[among], window)):
                least[i] = m
        some = [i for i, m in enumerate(least) if (m < z[i]).any()]
        return pa.RecordBatch.from_arrays([pa.array(r[some]), pa.array(s[some]), pa.array([least[i] for i in some], pa.list_(pa.int64()))],
                                          names=["k", "seg", "docs"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            blobs = b.column(4).to_pylist()
            sizes = np.cumsum([len(x) for x in blobs])
            lo = 0
            while lo < b.num_rows:
                done = int(sizes[lo - 1]) if lo else 0
                if size and size >= CHUNK_BYTES and held[-1][0][-1] != cols[0][lo]:
                    got, held, size = solve(_joined(held)), [], 0
                    if got is not None:
                        yield got
                # up to the next change of the anchor behind a full chunk
                full = int(np.searchsorted(sizes, done + max(0, CHUNK_BYTES - size)))
                if full < b.num_rows:
                    full = int(np.searchsorted(cols[0], cols[0][full], side="right"))
                hi = max(lo + 1, min(full, b.num_rows))
                held.append([c[lo:hi] for c in cols] + [blobs[lo:hi]])
                size += int(sizes[hi - 1]) - done
                lo = hi
        if held:
            got = solve(_joined(held))
            if got is not None:
                yield got

    return (dealt.repartition("k").sortWithinPartitions("k", "seg")
            .mapInArrow(run, "k long, seg long, docs array<long>"))


def _joined(held):
    return [np.concatenate([h[i] for h in held]) for i in range(4)] + [[b for h in held for b in h[4]]]


def occurrences(wanted: DataFrame, window: int, hot) -> DataFrame:
    """k, seg, rk, d, at: the segments of every document and their first words."""
    def run(batches):
        for rk, d, ks, texts in _wanted(batches):
            route, key, _, at, owner = _cut(texts, window, hot.value, ks)
            if len(route):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route), pa.array(key), pa.array(rk.to_numpy()[owner]), pa.array(d.to_numpy()[owner]),
                     pa.array(at.astype(np.int32))], names=["k", "seg", "rk", "d", "at"])

    return wanted.mapInArrow(run, "k long, seg long, rk long, d long, at int")


_RESULT = ("doc_id long, n_words long, n_removed long, "
           "spans array<struct<first: int, last: int>>, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans (runs of removed words, first and last
    number from 0) and kept (the words left, joined by one space) of every row."""
    spark = docs.sparkSession
    texts = _texts(docs)
    shared = shared_anchors(texts, window)
    hot = spark.sparkContext.broadcast(frequent_anchors(shared))
    by_text = shared.groupBy("rk").agg(F.collect_list("k").alias("ks"))
    wanted = texts.join(by_text, "rk").select("rk", "d", "ks", "text")
    found = solve_shards(dealt_segments(wanted, window, hot), window)
    lost = F.filter(F.transform("docs", lambda m, i: F.when(m < F.col("d"), F.col("at") + i)), lambda x: x.isNotNull())
    starts = (occurrences(wanted, window, hot).join(found, ["k", "seg"])
              .select("rk", "d", lost.alias("at")).where(F.size("at") > 0)
              .groupBy("rk").agg(F.collect_set(F.struct(F.col("d").alias("of"), "at")).alias("at")))
    own = F.flatten(F.transform(F.filter("at", lambda x: x["of"] == F.col("d")), lambda x: x["at"]))
    rows = texts.join(starts, "rk", "left").select("d", own.alias("at"), "text")
    out = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        for d, at, text in _steps(batches):
            counts, removed, spans, kept = [], [], [], []
            for places, t in zip(at, text):
                words = t.as_py().split() if t.is_valid else []
                counts.append(len(words))
                if not places.is_valid or not len(words):
                    removed.append(0), spans.append([]), kept.append(b" ".join(words))
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                first = np.unique(places.values.to_numpy())
                edge[first] += 1
                np.add.at(edge, first + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                removed.append(int(gone.sum()))
                spans.append([{"first": a, "last": b - 1} for a, b in turn.reshape(-1, 2).tolist()])
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
            ids = d.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == NO_ID), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, out), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return rows.mapInArrow(run, _RESULT)
