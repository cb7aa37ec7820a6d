"""SentencePiece (BPE) encoding through a table of last tokens, and decoding.

BPE encodings are consistent: the encoding of a prefix is a prefix table entry
(its unique last token) plus the encoding of what precedes that token.  So one
pass over the characters finds, for every prefix, the one vocabulary piece
that

* ends there (an automaton of all pieces yields the matches, longest first), and
* is *compatible* with the last token of the remaining prefix, i.e. the two
  pieces' joined text encodes to just these two pieces;

the ids are then recovered backwards from the end.  Pair tests and piece tests
use the merge rule itself (best score first, leftmost on ties) on the few
characters of two pieces and are kept in a table.  A character without a piece
is a token of its own that is compatible with everything; it becomes byte
tokens (or the unknown id) on output.

Two neighbouring characters that are neighbours in no piece are never merged,
so a text may be cut between them: in front of a space mark that follows
another character (if the model has no piece across it, else texts are not
cut), and inside such parts at the other pairs.  Parts repeat, so each worker
keeps bounded tables of encoded parts.  Decoding is the library's.

Defined results: null and empty texts encode to the begin and end ids alone;
repeated rows each get their row; whole texts are encoded whatever their
length; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import map_arrow

MARK = "▁"
KEEP_PARTS = 300_000


class Recent:
    """Bounded table in two halves; entries that are still asked for move on."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def find(self, key: str) -> bytes | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.keep(key, got)
        return got

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self.young) >= self.limit:
            self.old = dict(self.young)
            self.young.clear()  # the same object: callers hold its methods
        if len(key) <= 256:
            self.young[key] = value
        return value


class PrefixEncoder:
    """Encoder for one BPE model file; texts are normalised by the library."""

    def __init__(self, model_file: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.score = {p: sp.get_score(i) for i, p in enumerate(self.piece) if not special[i]}
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(sp.is_byte(i) for i in self.bytes)
        self.unknown = sp.unk_id()
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.compatible: dict[tuple[str, str], bool] = {}
        self.neighbours = {pair for p in self.id for pair in zip(p, p[1:])}
        self.code = {p: _ids([i]) for p, i in self.id.items()}
        self.parts = Recent(KEEP_PARTS)
        whole = [p for p in self.id if len(p) == 1 or self.merge(p) == [p]]
        self.multi = {p for p in whole if len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.multi:
            self.automaton.add_word(p, p)
        if self.multi:
            self.automaton.make_automaton()

    def merge(self, text: str) -> list[str]:
        """Merge rule on a short text: best scored pair first, leftmost on ties."""
        out, score = list(text), self.score
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            out[at:at + 2] = [out[at] + out[at + 1]]
        return out

    def fits(self, pair: tuple[str, str]) -> bool:
        if len(self.compatible) >= 2 * KEEP_PARTS:
            self.compatible.clear()
        got = self.compatible[pair] = self.merge(pair[0] + pair[1]) == [*pair]
        return got

    def last_tokens(self, text: str) -> list[str | None]:
        """Last token of every prefix (None: the prefix's last character)."""
        last: list[str | None] = [None] * len(text)
        if len(text) > 1 and self.multi:
            known, fits = self.compatible, self.fits
            for end, piece in self.automaton.iter(text):  # longest first at each end
                if last[end] is None:
                    before = end - len(piece)
                    if before < 0:
                        last[end] = piece
                    else:
                        key = (last[before] or text[before], piece)
                        if known[key] if key in known else fits(key):
                            last[end] = piece
        return last

    def ids(self, text: str) -> bytes:
        """Ids of a normalised part as little-endian 32-bit integers, recovered
        from the last prefix backwards."""
        last, out, i, code = self.last_tokens(text), [], len(text) - 1, self.code
        while i >= 0:
            token = last[i] or text[i]
            out.append(code[token] if token in code else self.other(token))
            i -= len(token)
        if not self.has_bytes:  # neighbouring unknown characters are one unknown id
            unknown = _ids([self.unknown])
            out = [x for x, y in zip(out, [None, *out]) if not x == y == unknown]
        out.reverse()
        return b"".join(out)

    def other(self, char: str) -> bytes:
        return _ids([self.bytes[b] for b in char.encode()] if self.has_bytes else [self.unknown])

    def part(self, text: str) -> bytes:
        got = self.parts.find(text)
        if got is None:
            near, starts = self.neighbours, [0]
            for i, pair in enumerate(zip(text, text[1:]), 1):
                if pair not in near:
                    starts.append(i)
            if len(starts) == 1:
                got = self.ids(text)
            else:
                get, parts_of = self.parts.young.get, self.part
                got = b"".join([get(x) or parts_of(x) for x in map(text.__getitem__, map(slice, starts, [*starts[1:], None]))])
            self.parts.keep(text, got)
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end ids, as little-endian 32-bit integers."""
        line = self.sp.normalize(text) if text else ""
        if not line:
            body = b""
        elif not self.cuts or not self.has_bytes:
            body = self.ids(line)
        else:
            parts = line.split(MARK)
            if "" in parts[1:] or parts[0]:
                parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", line)
            else:
                parts = [MARK + p for p in parts[1:]]
            get, parts_of = self.parts.young.get, self.part
            body = b"".join([get(p) or parts_of(p) for p in parts])
        return _ids([self.sp.bos_id()]) + body + _ids([self.sp.eos_id()])

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())


def _ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(model_file: str) -> PrefixEncoder:
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = PrefixEncoder(model_file)
    return _ENCODERS[model_file]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array<int>, with begin and end ids) of every whole text."""
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(cols: dict) -> dict:
        enc = encoder(model_file)
        return {"doc_id": cols["doc_id"],
                "ids": [np.frombuffer(enc.encode(t), "<u4").astype(np.int32) for t in cols["text"]]}

    return map_arrow(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(cols: dict) -> dict:
        enc = encoder(model_file)
        n, a, b = [], [], []
        for text in cols["text"]:
            ids = enc.encode(text)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
        return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_arrow(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, "
                              "ids_sha256 string, decoded_sha256 string")
