"""Vector codes, removal of repeated passages and token alignment against brute
force, and on nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers

import __spark_entry__ as E
from tablelab.llm import byte_bpe, substring_dedup, token_align, vector_codes
from tests.compare import duck_connect
from tests.conftest import SF_SMALL
from tests.llm.test_llm import BYTES, ODD, PIECES, clash

VEC = "vec_id long, embedding array<float>, label int"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# -------------------------------------------------------------- op11: vector codes

def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, components, label); Python integers throughout."""
    usual = Counter(len(x) for _, x, _ in rows if x and len(x) % parts == 0
                    and all(c is not None and math.isfinite(c) for c in x))
    width = min(usual, key=lambda d: (-usual[d], d)) if usual else 0
    kept = [(i, [math.floor(256 * c) for c in x], k) for i, x, k in rows
            if x and len(x) == width and all(c is not None and math.isfinite(c) for c in x)]
    w = width // parts
    cut = [[x[p * w:(p + 1) * w] for p in range(parts)] for _, x, _ in kept]
    seeds = sorted((j for j in range(len(kept)) if kept[j][0] is not None), key=lambda j: (kept[j][0], kept[j][1]))[:entries]
    books = [[cut[j][p] for j in seeds] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = defaultdict(list)
            for x in cut:
                of[near(x[p], books[p])[1]].append(x[p])
            new.append([[sum(c) // len(of[e]) for c in zip(*of[e])] if e in of else books[p][e] for e in range(len(seeds))])
        books = new
    found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, k), e in zip(kept, errors):
        by_label[k] += e
    digest = sha(",".join(str(v) for b in books for c in b for v in c))
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by_label[k], digest)
                   for (i, _, k), f, err in zip(kept, found, errors)), key=str)


def codes(df, **kw):
    return sorted((tuple(r) for r in vector_codes.encode(df, **kw).drop("label").collect()), key=str)


def test_vector_codes_match_sql(spark):
    got = E.queries()["op11_vector_codes"](spark, SF_SMALL)
    con = duck_connect(SF_SMALL)
    rel = con.execute(E.oracle_sql()["op11_vector_codes"])
    want = [tuple(r) for r in rel.fetchall()]
    cols = [c[0] for c in rel.description]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want) and len(want) > 100


def test_vector_codes_match_brute_force_on_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.5, -0.25, 0.0, 0.1, 2.0]) for _ in range(32)], rnd.choice([1, 2, None])) for i in range(150)]
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[5][1], 2), (200, None, 1), (201, [], 1),
             (202, [None] * 32, 1), (203, [float("nan")] * 32, 1), (204, [float("inf")] + [0.0] * 31, 2),
             (205, [1.0] * 16, 1), (206, [1.0] * 33, 1), (-5, [-0.001] * 32, None)]
    df = spark.createDataFrame(rows, VEC)
    exact = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], k) for i, x, k in rows]
    for name in ("code", "error", "v", "p", "e", "of"):
        df = df.withColumn(name, df["label"])
    assert codes(df) == brute_codes(exact)
    assert codes(df.limit(0)) == [] and codes(df.where("vec_id is null and label is null")) == []
    few = df.where("vec_id < 3")
    assert codes(few) == brute_codes([r for r in exact if r[0] is not None and r[0] < 3])


def test_vector_codes_of_large_components(spark):
    rnd = random.Random(4)
    for size in (2.0 ** 30, 2.0 ** 60):  # beyond one limb; beyond int64 distances
        rows = [(i, [rnd.uniform(-size, size) / 256 for _ in range(16)], i % 3) for i in range(90)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        want = [r if r[2] < 1 << 63 else (*r[:2], None, *r[3:]) for r in brute_codes(rows)]
        if size > 2.0 ** 40:  # sums of errors beyond a long are null
            assert [r[:2] for r in codes(df)] == [r[:2] for r in want]
        else:
            assert codes(df) == want


def test_limb_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (1, 1 << 20, 1 << 29, 1 << 30):
        x, c = rng.integers(-top, top + 1, (3, 50, 5)), rng.integers(-top, top + 1, (3, 7, 5))
        x[0, 0], c[0, 0] = top, -top
        want = np.array([[[sum(int(a) * int(b) for a, b in zip(r, s)) for s in cc] for r in xx] for xx, cc in zip(x, c)], object)
        assert (vector_codes.exact_products(x, c).astype(object) == want).all()


# ------------------------------------------------------- op12: repeated passages

def brute_repeats(rows, window=13):
    key = lambda i: math.inf if i is None else i
    first, out = {}, []
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            s = tuple(w[k:k + window])
            first[s] = min(first.get(s, math.inf), key(i))
    for i, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < key(i):
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def repeats(df, **kw):
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(df, **kw)
                   .select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def test_fm_index_matches_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        v, n = rnd.randint(1, 5), rnd.randint(1, 6)
        held = [[rnd.randrange(v) for _ in range(rnd.randint(1, 30))] for _ in range(rnd.randint(1, 8))]
        asked = [[rnd.randrange(-1, v + 1) for _ in range(rnd.randint(0, 30))] for _ in range(6)]
        edges = lambda x: np.concatenate([[0], np.cumsum([len(s) for s in x])])
        index = substring_dedup.FMIndex(np.array(sum(held, [])), edges(held), n)
        at = edges(asked)
        found = index.matches(np.array(sum(asked, []), np.int64), at, n)
        for k, s in enumerate(asked):
            for i in range(len(s)):
                want = {j for j, h in enumerate(held) for q in range(len(h) - n + 1) if h[q:q + n] == s[i:i + n] and len(s) >= i + n}
                f = found[at[k] + i]
                assert (set(index.owner[index.group == index.group[f]].tolist()) if f >= 0 else set()) == want


def test_repeats_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    got = E.queries()["op12_substring_dedup"](spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((*w[:3], sha(w[3])) for w in want)
    assert sum(w[2] for w in want) > 1000


def test_repeats_of_hot_passages_and_phrases(spark, monkeypatch):
    """A passage and a phrase in most rows; small bounds send their windows one by
    one and cut many chunks."""
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(40))
    passage = [word() for _ in range(30)]
    rows = [(i, " ".join([word() for _ in range(rnd.randint(0, 30))] + (passage if i % 3 else passage[:5])
                         + [word() for _ in range(rnd.randint(0, 30))])) for i in range(300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_repeats(rows)
    assert repeats(df) == want
    for name, value in (("HOT_LEAST", 20), ("HOT_MOST", 20), ("CHUNK_BYTES", 2000), ("STEP_BYTES", 3000), ("ROWS_TOGETHER", 100)):
        monkeypatch.setattr(substring_dedup, name, value)
    shared = substring_dedup.shared_anchors(substring_dedup._texts(df), 13)
    assert len(substring_dedup.frequent_anchors(shared)) > 0
    assert repeats(df) == want


def test_repeats_on_odd_rows(spark):
    long = "one word " * 30_000
    rows = [r[:2] for r in ODD] + [(20, "x " + long), (21, " ".join(map(str, range(13)))), (22, "\t".join(map(str, range(13))) + " 99"),
                                   (None, " ".join(map(str, range(13)))), (23, "a b"), (21, " ".join(map(str, range(13)))), (24, "é" * 50_000)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    assert repeats(df) == brute_repeats(rows) and repeats(df.limit(0)) == []
    assert repeats(df, window=2) == brute_repeats(rows, 2)
    spans = {r.doc_id: r.spans for r in substring_dedup.remove_repeats(df).where("doc_id = 22").collect()}
    assert [tuple(s) for s in spans[22]] == [(0, 12)]


# ------------------------------------------------------------ op13: token alignment

def brute_alignment(rows):
    tok, sp = tokenizers.Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tok.encode_special_tokens = True
    back = byte_bpe.byte_level_alphabet()
    docs, counts = [], Counter()
    for i, t in rows:
        groups, a, b = [], [], []
        if t:
            want = b" " + t.encode()
            a = [(x, bytes(back[c] for c in tok.id_to_token(x))) for x in tok.encode(" " + t, add_special_tokens=False).ids]
            b = [(x, bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode())
                 for x in sp.encode(t)]
            if b"".join(s for _, s in a) != want or b"".join(s for _, s in b) != want:
                a, b = [], []
            ends = []
            for side in (a, b):
                at, e = 0, []
                for _, s in side:
                    at += len(s)
                    e.append(at)
                ends.append(e)
            cuts = sorted(set(ends[0]) & set(ends[1]))
            for lo, hi in zip([0] + cuts, cuts):
                groups.append(tuple([x for (x, _), e in zip(s, es) if lo < e <= hi] for s, es in zip((a, b), ends)))
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(set(links))
        docs.append((i, len(a), len(b), groups, links))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return sorted(((i, na, nb, len(g), sum(ln.values()), sum(n for p, n in ln.items() if counts[p] == top[p[0]]),
                    sum(n * counts[p] for p, n in ln.items()),
                    sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)) if g else "")
                   for i, na, nb, g, ln in docs), key=str)


@pytest.mark.parametrize("special_is_text", [True, False])
def test_byte_bpe_equals_the_library(special_is_text):
    bpe, tok = byte_bpe.ByteBPE(BYTES, special_is_text), tokenizers.Tokenizer.from_file(BYTES)
    tok.encode_special_tokens = special_is_text
    assert bpe.fast is not None
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "the", "The", "é", "日", "▁", "\xa0", "\u2003", "\U0001f600", "'s", "'", ".", "!!", "12",
             "<|endoftext|>", "</s>", "\x00", "e\u0301", "ﬁ", "\u200b", "\u180e", "\r\n", "\x85", "\x1c", "word", "²", "\U0001e900", "ꟲ"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(25))) for _ in range(4000)]
    texts += [f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}  {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert bpe.encode(texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def alignment(df, **kw):
    return sorted((tuple(r) for r in token_align.alignment(df, BYTES, PIECES, **kw).drop("pairs", "links").collect()), key=str)


def test_alignment_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    got = E.queries()["op13_token_align"](spark, SF_SMALL)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    for most in (0, 100):  # all or most pairs by the join
        assert alignment(docs, frequent_pairs=most) == want


def test_alignment_on_odd_rows(spark):
    rows = [(r[0], r[1][:5000] if r[1] else r[1]) for r in ODD] + [
        (30, "a▁b"), (31, "<|endoftext|> </s> <s> <unk> <0x41>"), (32, "  two  spaces \r\n\t tabs "), (33, "x" * 3000),
        (34, "naïve \U0001f600\U0001f600 日本語の文章 ‫ ́"), (35, "\x00\x01 ﻿"), (36, "ab" * 1500), (37, " lead")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_alignment(rows)
    assert alignment(df) == want and alignment(df, frequent_pairs=3) == want
    assert alignment(df.limit(0)) == []
    assert alignment(df.where("text is null")) == [(1, 0, 0, 0, 0, 0, 0, "")]
