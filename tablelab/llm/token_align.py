"""Alignment of the tokens of two tokenizers over a corpus.

Tokenizer A (byte-level BPE) encodes space + text, tokenizer B (SentencePiece,
which adds that space) the text.  Byte offsets at which tokens of both end cut
the tokens into groups; every A token of a group is linked with every B token of
it.  The count of a pair of ids is the number of documents that hold it linked.

All steps between the encoders and Spark are Arrow kernels and Acero plans on
some megabytes of text at a time:

* lists of ids are flattened with their parent indices; token ends are segmented
  cumulative sums of byte lengths (running sum less the document's);
* an Acero hash join on (document, end) finds the common ends, a running count of
  them numbers the groups;
* the distinct ids of a group on both sides, with their multiplicities
  (``Table.group_by``), are joined on the group, so a group of many equal tokens is
  one row with a weight and not the product of its tokens;
* ``Table.group_by`` counts pairs per batch, Spark merges these partial counts.

The aligned documents are written once.  Pair counts come back to them in two
ways: the at most ``FREQUENT_PAIRS`` pairs with the highest counts as a sorted
array in every task (a bound independent of the corpus), all others by a join
on the pair, in which no key has as many rows as the least frequent pair of the
array has documents.  The highest count of each A id is one number per entry
of the vocabulary.

Defined results: null and empty texts, and texts whose token bytes differ from
space + text on either side, have no tokens: zeros and an empty digest; special
tokens' strings are plain text; rows with equal ids (or none) each count as a
document and keep their row; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.byte_bpe import ByteBPE
from tablelab.llm.common import arrow_schema, written

STEP_BYTES = 1 << 20
STEP_ROWS = 4096
FREQUENT_PAIRS = 1 << 19
ID_BITS = 24  # an id pair is a << 24 | b


# ------------------------------------------------------------------ tokenizers

@dataclass
class Side:
    """Token bytes, their lengths and decimal ids of one vocabulary, by id."""
    encode: object
    pieces: pa.Array
    sizes: pa.Array
    names: pa.Array


def _side(encode, pieces: list[bytes]) -> Side:
    return Side(encode, pa.array(pieces, pa.binary()), pa.array([len(p) for p in pieces], pa.int64()),
                pa.array([str(i) for i in range(len(pieces))]))


def byte_level_side(tokenizer_file: str) -> Side:
    bpe = ByteBPE(tokenizer_file, special_is_text=True)
    return _side(lambda texts: bpe.encode([" " + t for t in texts]), bpe.pieces)


def sentencepiece_side(model_file: str) -> Side:
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=model_file)
    pieces = []
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        code = re.fullmatch("<0x([0-9A-F]{2})>", name) if sp.is_byte(i) else None
        pieces.append(bytes([int(code[1], 16)]) if code else name.replace("▁", " ").encode())
    return _side(lambda texts: sp.encode(texts, num_threads=1), pieces)


_SIDES: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(tokenizer_file: str, model_file: str) -> tuple[Side, Side]:
    key = tokenizer_file, model_file
    if key not in _SIDES:
        _SIDES[key] = byte_level_side(tokenizer_file), sentencepiece_side(model_file)
    return _SIDES[key]


# ------------------------------------------------------------------- alignment

def _lists(offsets, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _bytes_of(ids: pa.Array, side: Side) -> pa.Array:
    return pc.binary_join(_lists(ids.offsets, side.pieces.take(ids.flatten())), b"")


def _ends(ids: pa.Array, side: Side) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flat ids, their documents, and where they end within their document."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    running = pc.cumulative_sum(side.sizes.take(flat))
    before = pa.array(np.concatenate([[0], running.to_numpy()])[ids.offsets.to_numpy()[:-1]])
    return flat, parent, pc.subtract(running, before.take(parent))


def _groups(at: np.ndarray, n: int) -> np.ndarray:
    """Number of common ends before each token."""
    ends = np.zeros(n, np.int64)
    ends[at] = 1
    return np.cumsum(ends) - ends


def align(texts: list[str], a_side: Side, b_side: Side) -> dict[str, pa.Array]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and links (distinct id
    pairs in ascending order and how often each is linked) of each text."""
    spaced = pa.array([b" " + t.encode() for t in texts], pa.binary())
    a = pa.array(a_side.encode(texts), pa.list_(pa.int32()))
    b = pa.array(b_side.encode(texts), pa.list_(pa.int32()))
    same = pc.and_(pc.equal(_bytes_of(a, a_side), spaced), pc.equal(_bytes_of(b, b_side), spaced))
    whole = np.flatnonzero(same.to_numpy(zero_copy_only=False) & np.array([bool(t) for t in texts], bool))
    a, b = (pa.concat_arrays([x.take(pa.array(whole))]) for x in (a, b))
    docs = len(whole)
    (a_ids, a_doc, a_end), (b_ids, b_doc, b_end) = _ends(a, a_side), _ends(b, b_side)
    na, nb = len(a_ids), len(b_ids)
    left = pa.table({"doc": a_doc, "end": a_end, "ia": np.arange(na)})
    right = pa.table({"doc": b_doc, "end": b_end, "ib": np.arange(nb)})
    common = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
    a_at, b_at = np.sort(common["ia"].to_numpy()), np.sort(common["ib"].to_numpy())
    doc_of = a_doc.to_numpy()[a_at].astype(np.int64)  # document of each group
    many = len(a_at)

    # links: distinct ids of each group on both sides
    bits = pa.scalar(1 << ID_BITS, pa.int64())
    one = [([], "count_all")]
    sets = [pa.table({"g": _groups(at, n), "id": ids}).group_by(["g", "id"], use_threads=False).aggregate(one)
            .rename_columns(["g", f"id_{s}", f"n_{s}"])
            for s, at, n, ids in (("a", a_at, na, a_ids), ("b", b_at, nb, b_ids))]
    pairs = sets[0].join(sets[1], "g", join_type="inner", use_threads=False)
    pair = pc.add(pc.multiply(pairs["id_a"].cast(pa.int64()), bits), pairs["id_b"].cast(pa.int64()))
    doc = pa.chunked_array([pa.array(doc_of[pairs["g"].to_numpy()])])
    found = (pa.table({"doc": doc, "pair": pair, "n": pc.multiply(pairs["n_a"], pairs["n_b"])})
             .group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")]))
    d, p, w = (found[c].to_numpy() for c in ("doc", "pair", "n_sum"))
    order = np.lexsort((p, d))
    d, p, w = d[order], p[order], w[order]
    edge = np.searchsorted(d, np.arange(docs + 1))
    total = np.concatenate([[0], np.cumsum(w)])

    # digests: a1,a2|b1;a3|b2,b3
    shown = [pc.binary_join(_lists(np.append(0, at + 1), side.names.take(ids)), ",")
             for side, ids, at in ((a_side, a_ids, a_at), (b_side, b_ids, b_at))]
    cut = np.searchsorted(doc_of, np.arange(docs + 1))
    lines = pc.binary_join(_lists(cut, pc.binary_join_element_wise(*shown, "|")), ";") if many else pa.nulls(docs, pa.string())
    digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in lines]

    def spread(values, empty=0):
        out = np.full(len(texts), empty, object if empty == "" else np.int64)
        out[whole] = values
        return pa.array(out)

    sizes = spread(np.diff(edge)).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return {"n_a": spread(np.diff(a.offsets.to_numpy())), "n_b": spread(np.diff(b.offsets.to_numpy())),
            "n_groups": spread(np.diff(cut)), "n_links": spread(total[edge[1:]] - total[edge[:-1]]),
            "groups_sha256": pa.array(spread(np.array(digests, object) if docs else [], "").to_pylist(), pa.string()),
            "pairs": _lists(offsets, pa.array(p, pa.int64())), "links": _lists(offsets, pa.array(w, pa.int64()))}


# ------------------------------------------------------------------ Spark jobs

_ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs array<long>, links array<long>")


def aligned(docs: DataFrame, tokenizer_file: str, model_file: str) -> DataFrame:
    """One row per document, numbered, with its digest and its id pairs (written)."""
    schema = arrow_schema(docs.sparkSession, _ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = sides(tokenizer_file, model_file), TaskContext.get().partitionId() << 33
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + STEP_BYTES, side="right"))
                hi = max(lo + 1, min(hi, lo + STEP_ROWS))
                ids, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                got = align([t or "" for t in texts.to_pylist()], *both)
                got |= {"row": pa.array(np.arange(row, row + hi - lo)), "doc_id": ids}
                yield pa.RecordBatch.from_arrays([got[f.name].cast(f.type) for f in schema], schema=schema)
                row, lo = row + hi - lo, hi

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(df.mapInArrow(run, _ALIGNED), "aligned", compression="zstd")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: documents that hold the id pair linked (written)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = (pa.table({"pair": batch.column(0).flatten()}).group_by("pair", use_threads=False)
                   .aggregate([([], "count_all")]).rename_columns(["pair", "n"]))
            yield from got.to_batches()

    return written(rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair")
                   .agg(F.sum("n").alias("n")), "pair-counts")


def frequent_bound(counts: DataFrame, most: int) -> int:
    """The smallest count (of a scale of eighths of powers of two) that at most
    ``most`` pairs reach."""
    level = F.floor(F.log2("n") * 8)
    sizes = {r["k"]: (r["m"], r["least"]) for r in
             counts.groupBy(level.alias("k")).agg(F.count("*").alias("m"), F.min("n").alias("least")).collect()}
    held, bound = 0, 1 << 62
    for k in sorted(sizes, reverse=True):
        held += sizes[k][0]
        if held > most:
            break
        bound = sizes[k][1]
    return bound


def alignment(docs: DataFrame, tokenizer_file: str, model_file: str, frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, pairs, links."""
    spark = docs.sparkSession
    rows = aligned(docs, tokenizer_file, model_file)
    counts = pair_counts(rows)
    best = counts.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("n").alias("n")).collect()
    top = np.zeros(max((r["a"] for r in best), default=0) + 1, np.int64)  # one number per A id
    for r in best:
        top[r["a"]] = r["n"]
    bound = frequent_bound(counts, frequent_pairs)
    held = counts.where(F.col("n") >= bound).toArrow().sort_by("pair") if best else None
    known = (held["pair"].to_numpy(), held["n"].to_numpy()) if best else (np.zeros(0, np.int64),) * 2
    shared = spark.sparkContext.broadcast((*known, top))

    def look_up(pairs: np.ndarray) -> np.ndarray:
        """Counts of the frequent pairs, 0 for the others."""
        keys, n, _ = shared.value
        if not len(keys):
            return np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        return np.where(keys[at] == pairs, n[at], 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            pairs, links = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            n = look_up(pairs)
            hit = (n > 0) & (n == shared.value[2][pairs >> ID_BITS])
            edge = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (links * n, links * hit)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(s[edge[1:]] - s[edge[:-1]]) for s in sums]], names=["row", "count_sum", "n_best"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, links = batch.column(1).flatten(), batch.column(2).flatten()
            rare = np.flatnonzero(look_up(pairs.to_numpy()) == 0)
            row = batch.column(0).to_numpy()[pc.list_parent_indices(batch.column(1)).to_numpy()[rare]]
            for lo in range(0, len(rare), 500_000):
                at = rare[lo:lo + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(row[lo:lo + 500_000]), pairs.take(pa.array(at)), links.take(pa.array(at))],
                                                 names=["row", "pair", "links"])

    lists = rows.select("row", "pairs", "links")
    sums = lists.mapInArrow(score, "row long, count_sum long, n_best long")
    rare = counts.where(F.col("n") < bound)
    if best and not rare.isEmpty():
        tops = spark.createDataFrame([(r["a"], r["n"]) for r in best], "a long, top long")  # vocabulary-sized
        rare = rare.join(F.broadcast(tops), F.shiftright("pair", ID_BITS) == F.col("a")).select(
            "pair", "n", (F.col("n") == F.col("top")).alias("hit"))
        more = lists.mapInArrow(others, "row long, pair long, links long").join(rare, "pair").select(
            "row", (F.col("links") * F.col("n")).alias("count_sum"),
            F.when(F.col("hit"), F.col("links")).otherwise(0).alias("n_best"))
        sums = sums.unionByName(more).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return rows.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                         "groups_sha256", "pairs", "links")
