"""Language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of its
labelled text.  A text is parsed greedily against each automaton: a phrase is
the longest match that starts where the last phrase ended (an unmatched
character is a phrase of its own).  Few long phrases mean that the text is made
of pieces of that language, so

    entropy = phrases * log2(training length, at least MIN_LENGTH) / characters

(the cross-parsing estimate of cross entropy in bits per character) decides;
the language needing least wins, ties go to the smaller label.  Every language
keeps its own training length, however little text another one has.  A phrase
never costs less than a place among ``MIN_LENGTH`` characters: a label with a few
letters of text would otherwise have almost free phrases and take the others'
texts.

Texts are lower-cased, letters become symbols, every run of other characters
one space.  Each language has its own alphabet: its ``MAX_ALPHABET`` most frequent
letters, one symbol for the rest of its letters, and one that matches nothing
for letters that it doesn't have.  Texts are parsed whole, in blocks of ``BLOCK`` symbols (a phrase
ends at a block's end), many blocks at a time: the automata are one numpy table
``next state * 4 + phrases ended`` by (state, symbol), row by row, and all blocks of a batch
step through it together.

The model is fit on at most ``max_rows`` rows and ``max_chars`` characters per
language (rows chosen by a hash of their text), for the ``MAX_LANGUAGES`` most
frequent labels (ties: the smaller label); with so many labels that the tables
could pass ``MAX_CELLS`` numbers (256 MB), each language gets an equal share of
them.  These are documented bounds of the fit, so the broadcast model is bounded.

Defined results: ``und`` (score 0) for null texts, texts without a letter, or
if nothing was learned; ``score`` is 1 - best entropy / runner-up entropy
(1 if only one language was learned); rows with null labels teach nothing;
repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.llm.common import arrow_schema, crc_bucket, filter_texts

UND = "und"
MAX_ROWS = 600
MAX_CHARS = 60_000
MAX_LANGUAGES = 200
MAX_ALPHABET = 126
MIN_LENGTH = 4096         # characters; see the entropy
MAX_CELLS = 64 << 20      # numbers in the tables of all languages
BLOCK = 1024
LANES = 4096
MIN_PHRASE_CHARS = 2.0  # texts in no learned language parse into phrases of 1 or 2 characters; see clear_text


@functools.cache
def _letter_flags() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


# ---------------------------------------------------------------------- the model

@dataclass
class Model:
    langs: list[str]
    symbols: np.ndarray  # code point -> symbol: 0 space, 1 other letter, 2.. letters of the model
    local: np.ndarray    # language x symbol -> symbol of the language: 0 space, 1 rare, 2.. frequent, last: not in it
    table: np.ndarray    # rows of all states: next state * 4 + phrases ended, by symbol of the language
    roots: np.ndarray    # first state of each language
    widths: np.ndarray   # symbols of each language
    starts: np.ndarray   # place of each language's first row in the table
    bits: np.ndarray     # cost of a phrase of each language
    length: np.ndarray   # training length of each language


def suffix_automaton(text: list[int], width: int) -> np.ndarray:
    """Transition rows of the suffix automaton of ``text`` (-1: none)."""
    size = 2 * len(text) + 2
    go = np.full((size, width), -1, np.int32)
    link, length, n, last = [-1] * size, [0] * size, 1, 0
    nxt: list[dict[int, int]] = [{}]
    for c in text:
        cur, n = n, n + 1
        nxt.append({})
        length[cur] = length[last] + 1
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone, n = n, n + 1
                nxt.append(dict(nxt[q]))
                length[clone], link[clone] = length[p] + 1, link[q]
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    for state, row in enumerate(nxt):
        for c, to in row.items():
            go[state, c] = to
    return go[:n]


def fit_samples(samples: dict[str, list[str]], max_chars: int = MAX_CHARS) -> Model:
    """Automata over each language's joined samples."""
    letters = _letter_flags()
    points = {k: [code_points(t) for t in v] for k, v in sorted(samples.items())}
    counts: dict[str, Counter] = {}
    for lang, parts in points.items():
        count = counts[lang] = Counter()
        for x in parts:
            values, n = np.unique(x[letters[x]], return_counts=True)
            count.update(dict(zip(values.tolist(), n.tolist())))
    symbols = letters.astype(np.int32)
    seen = sorted(set().union(*counts.values()))
    symbols[seen] = np.arange(len(seen)) + 2
    langs, local, tables, roots, widths, starts, bits, length, at, start = [], [], [], [], [], [], [], [], 0, 0
    for lang, parts in points.items():
        joined = [_squeezed(symbols[np.concatenate([x, np.array([32], np.uint32)])]) for x in parts]
        # an automaton has at most two states a character, and a column for each symbol
        most = min(max_chars, MAX_CELLS // len(points) // (2 * min(len(counts[lang]) + 3, MAX_ALPHABET + 3)))
        text = np.concatenate(joined)[:most] if joined else np.zeros(0, np.int32)
        if not (text > 0).any():
            continue
        count = counts[lang]
        kept = sorted(sorted(count, key=lambda c: (-count[c], c))[:MAX_ALPHABET])
        width = len(kept) + 3
        own = np.full(len(seen) + 2, width - 1, np.uint8)
        own[0] = 0
        own[symbols[list(count)]] = 1
        own[symbols[kept]] = np.arange(len(kept)) + 2
        go = suffix_automaton(own[text].tolist(), width)
        root = go[0]
        miss = go < 0
        # a missing transition ends the phrase; the symbol starts the next one,
        # or is a phrase of its own if the language doesn't have it
        to = np.where(miss, np.where(root < 0, 0, root), go).astype(np.int64)
        ended = np.where(miss, np.where(root < 0, 2, 1), 0)
        ended[0] = np.where(root < 0, 1, 0)
        langs.append(lang), local.append(own), roots.append(at), widths.append(width), starts.append(start)
        tables.append(((to + at) * 4 + ended).astype(np.int32).ravel())
        bits.append(math.log2(max(MIN_LENGTH, len(text))))
        length.append(len(text))
        at += len(go)
        start += go.size
    return Model(langs, symbols, np.array(local, np.uint8).reshape(len(langs), len(seen) + 2),
                 np.concatenate(tables) if tables else np.zeros(0, np.int32), np.array(roots, np.int64),
                 np.array(widths, np.int64), np.array(starts, np.int64), np.array(bits), np.array(length))


def _squeezed(symbols: np.ndarray) -> np.ndarray:
    """One space for each run of spaces."""
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    return symbols[keep]


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample of (text, lang) rows: about ``max_rows`` rows of
    each language by hash of the text, none if the label or text is null."""
    rows = docs.select(F.col("text").cast("string").alias("t"), F.col("lang").cast("string").alias("l")).where(
        F.col("t").isNotNull() & F.col("l").isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return fit_samples({})
    scale = 1 << 30
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("l") == lang, F.lit(min(scale, scale * max_rows // n + 1))).otherwise(share)
    # a sampled row gives at most 4 * max_chars / max_rows characters, from a
    # place that its hash chooses
    piece = max(1, 4 * max_chars // max_rows)
    h = F.xxhash64("t")
    place = F.pmod(F.shiftright(h, 31), F.greatest(F.length("t") - piece + 1, F.lit(1))) + 1
    drawn = (rows.where(F.pmod(h, F.lit(scale)) < share)
             .select("l", h.alias("h"), F.substr("t", place.cast("int"), F.lit(piece)).alias("t")).collect())
    samples: dict[str, list[str]] = {}
    for r in sorted(drawn, key=lambda r: (r["l"], r["h"], r["t"])):
        texts = samples.setdefault(r["l"], [])
        if len(texts) < max_rows and (not texts or texts[-1] != r["t"]):
            texts.append(r["t"])
    return fit_samples(samples, max_chars)


# -------------------------------------------------------------------- parsing

def parse(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases by text and language, symbols by text, has a letter)."""
    n, k = len(texts), len(model.langs)
    phrases, size, letters = np.zeros((n, k), np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    blocks: list[np.ndarray] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        if text:
            s = _squeezed(model.symbols[code_points(text)])
            size[i], letters[i] = len(s), bool((s > 0).any())
            if letters[i] and k:
                for a in range(0, len(s), BLOCK):
                    blocks.append(s[a:a + BLOCK])
                    owner.append(i)
    order = sorted(range(len(blocks)), key=lambda b: -len(blocks[b]))
    flat, width = model.table, model.widths[:, None]
    shift = (model.starts - model.roots * model.widths)[:, None]
    for lo in range(0, len(order), LANES):
        of = order[lo:lo + LANES]
        lengths = np.array([len(blocks[b]) for b in of])
        lanes = np.zeros((lengths[0], len(of)), np.int32)
        for j, b in enumerate(of):
            lanes[:lengths[j], j] = blocks[b]
        state = np.repeat(model.roots[:, None], len(of), axis=1)
        ended = np.zeros((k, len(of)), np.int64)
        alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        for t in range(lengths[0]):
            m = alive[t]
            step = flat[state[:, :m] * width + shift + model.local[:, lanes[t, :m]]]
            ended[:, :m] += step & 3
            state[:, :m] = step >> 2
        ended += state != model.roots[:, None]
        np.add.at(phrases, np.array([owner[b] for b in of]), ended.T)
    return phrases, size, letters


def decide(model: Model, texts: list[str | None]) -> dict[str, list]:
    phrases, size, letters = parse(model, texts)
    langs, scores, entropies, lengths = [], [], [], []
    for i in range(len(texts)):
        if not letters[i] or not model.langs:
            langs.append(UND), scores.append(0.0), entropies.append(None), lengths.append(None)
            continue
        bits = phrases[i] * model.bits / size[i]
        order = sorted(range(len(bits)), key=lambda k: (bits[k], model.langs[k]))
        best = order[0]
        langs.append(model.langs[best])
        scores.append(1.0 if len(order) == 1 else float(max(0.0, 1 - bits[best] / bits[order[1]])))
        entropies.append(float(bits[best]))
        lengths.append(float(size[i] / phrases[i, best]))
    return {"lang_pred": langs, "score": scores, "bits_per_char": entropies, "phrase_chars": lengths}


_ADDED = [("lang_pred", "string"), ("score", "double"), ("bits_per_char", "double"), ("phrase_chars", "double")]


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id) of every row and what its text is:
    lang_pred, score, bits_per_char, phrase_chars (mean phrase length)."""
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text__"))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]] + [f"{a} {b}" for a, b in _ADDED])
    schema, shared = arrow_schema(spark, ddl), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in (whole.slice(a, 2000) for a in range(0, whole.num_rows, 2000)):
                got = decide(m, b.column(b.num_columns - 1).to_pylist())
                cols = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(got[a]) for a, _ in _ADDED]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def clear_text(docs: DataFrame, model: Model, min_phrase_chars: float = MIN_PHRASE_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language:
    not ``und``, and phrases of the best language at least so long on average.
    Phrases grow with the logarithm of the training length, so for a language of
    less than ``MIN_LENGTH`` characters the bound falls with it, down to 1: texts of
    which no two letters stand together in the language's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[str | None]) -> list[bool]:
        m = shared.value
        got = decide(m, texts)
        share = np.minimum(1, np.log2(np.maximum(2, m.length)) / math.log2(MIN_LENGTH))
        least = {k: max(1 + 1e-9, min_phrase_chars * s) for k, s in zip(m.langs, share)}
        return [lang != UND and size >= least[lang] for lang, size in zip(got["lang_pred"], got["phrase_chars"])]

    return filter_texts(docs, keep)


def held_out():
    """True for the documents that nothing is learned from."""
    return F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))


def predict(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Learn from the rows that aren't held out, judge all rows."""
    model = fit(docs.where(~held_out()), max_rows, max_chars)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score",
                                        "bits_per_char", "phrase_chars")
