"""Training-data operators against brute force, round trips and held-out accuracy,
and on nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as E
from tablelab.llm import (components, decontaminate, html_extract, knn_join, language_id, licenses, maxent_lm,
                          near_dedup, sentencepiece_codec, token_file, url_filter)
from tests.compare import compare_frames, duck_connect, spark_rows
from tests.conftest import SF_SMALL

DOC = "doc_id long, text string, lang string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

#: Null, empty, blank, very long, repeated and foreign texts; a null and a repeated doc_id.
ODD = [(1, None, None), (2, "", "en"), (3, "  \n\t ", None), (4, "123 456 ?!", "en"), (5, "one word " * 30_000, "en"),
       (6, "Été à l'été où 日本語 😀 \x00 x", "fr"), (7, "same text here for all of us", "en"),
       (7, "same text here for all of us", "en"), (8, "same text here for all of us", None),
       (None, "no id but some text in it", "en"), (9, "short", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns named like internal ones."""
    return clash(spark.createDataFrame(ODD, DOC))


def clash(df):
    for name in ("word", "n", "score", "ids", "component", "key", "keys", "rep", "center", "item", "win", "task",
                 "hits", "text__", "print", "s0", "held_out", "kept", "a", "b", "block", "path", "rule", "v", "cell"):
        df = df.withColumn(name, F.lit("x"))
    return df


def alnum(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def spaced(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0D]+", low)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ------------------------------------------------------------------ registration

def test_every_operator_is_registered():
    names = E.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


# ------------------------------------------------------------------ op1: kNN join

def test_knn_matches_sql(spark):
    ok, msg = compare_frames(*spark_rows(E.queries()["op1_voronoi_knn"](spark, SF_SMALL)),
                             duck_connect(SF_SMALL), E.oracle_sql()["op1_voronoi_knn"])
    assert ok, msg


@pytest.mark.parametrize("slice_rows, block_queries, pivots", [(4096, 2048, 64), (7, 3, 5), (40, 1, 1)])
def test_knn_brute_force_with_ties_copies_and_bad_rows(spark, slice_rows, block_queries, pivots):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (150, 4)) / 2.0
    x[40:90] = x[40]  # a hot vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(3, rows[3][1]), (200, None), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan")] * 4),
             (203, [float("inf")] * 4), (204, []), (205, [1.0]), (None, [1.0] * 4)]
    table = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in knn_join.top_k(table, F.col("id") % 5 == 0, slice_rows=slice_rows, block_queries=block_queries,
                            pivots=pivots).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = np.floor(256 * x).astype(int)
    for q in range(0, 150, 5):
        want = sorted(((-int(v[q] @ v[d]), d) for d in range(150) if d != q))[:5]
        assert sorted(got[q]) == [(k + 1, d, -s) for k, (s, d) in enumerate(want)]
    assert len(got) == 30


def test_knn_empty_and_few(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn_join.top_k(table, F.col("id") % 50 == 0).count() == 0
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn_join.top_k(table, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, 131072)]
    assert knn_join.top_k(table.where("vec_id = 1"), F.col("id") % 50 == 0).count() == 0


# ------------------------------------------------------------ op2: language ID

def test_language_held_out_accuracy(spark, docs):
    rows = language_id.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 30 and sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_ignores_labels_of_held_out_rows(spark, docs):
    held = language_id.held_out()
    changed = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language_id.predict(docs).collect())) == sorted(map(tuple, language_id.predict(changed).collect()))


def test_language_odd_rows(spark, odd):
    rows = [tuple(r)[:4] for r in language_id.predict(odd).collect()]
    assert len(rows) == len(ODD)
    und = {r[0] for r in rows if r[2] == "und"}
    assert und == {1, 2, 3, 4} and all(r[3] == 0 for r in rows if r[2] == "und")
    empty = language_id.predict(odd.limit(0))
    assert empty.count() == 0
    untaught = language_id.predict(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_cross_parsing_counts_longest_matches():
    model = language_id.fit_samples({"a": ["abcabd abab"], "b": ["xyz xyz xyz"]})
    train = {k: " ".join(v) for k, v in {"a": ["abcabd abab "], "b": ["xyz xyz xyz "]}.items()}
    text = "abcab xyzab qabd"
    phrases, size, _ = language_id.parse(model, [text])
    shortest = min(len(t) for t in train.values())
    for k, lang in enumerate(model.langs):
        corpus, at, n = train[lang][:shortest], 0, 0
        while at < len(text):
            m = 1
            while at + m < len(text) and text[at:at + m + 1] in corpus and text[at:at + m] in corpus:
                m += 1
            at, n = at + m, n + 1
        assert phrases[0, k] == n
    assert size[0] == len(text)


def test_language_with_little_text_leaves_the_others_whole():
    rng = random.Random(0)
    texts = {k: [" ".join("".join(rng.choices(abc, k=5)) for _ in range(3000))] for k, abc in (("a", "abcdef"), ("b", "defghi"))}
    probe = [" ".join(texts["a"][0].split()[2000:2040]), texts["b"][0][-300:]]
    alone, joined = (language_id.fit_samples(x, 16_000) for x in (texts, texts | {"c": ["xyz xy"]}))
    assert joined.langs == ["a", "b", "c"] and (alone.bits == joined.bits[:2]).all()
    assert (language_id.parse(alone, probe)[0] == language_id.parse(joined, probe)[0][:, :2]).all()


@pytest.mark.parametrize("extra", ["s", "sho", "short text of a label", None])
def test_a_rare_label_takes_no_documents_of_others(spark, extra):
    """1, 3, 21 and 200 characters of one more label, the last in one of the languages."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect() if r.lang]
    held = {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    train = {}
    for d, t, k in rows:
        if d not in held:
            train.setdefault(k, []).append(t[:400])
    probe = [(t[:n], k) for d, t, k in rows if d in held for n in (40, 400)]
    more = {"zz": [extra or train[sorted(train)[0]][0][100:300]]}

    def right(samples):
        got = language_id.decide(language_id.fit_samples(samples), [t for t, _ in probe])["lang_pred"]
        return sum(a == k for a, (_, k) in zip(got, probe)) / len(probe)
    alone = right(train)
    assert alone > 0.95 and right(train | more) >= alone - 0.005


def test_language_model_is_bounded(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} word " * 50, f"l{i:03d}") for i in range(260)]
    df = spark.createDataFrame(rows + [(1000 + i, "ab word", "l007") for i in range(3)], DOC)
    assert len(language_id.fit(df).langs) == language_id.MAX_LANGUAGES and "l007" in language_id.fit(df).langs
    monkeypatch.setattr(language_id, "MAX_CELLS", 200_000)
    assert len(language_id.fit(df).table) <= 200_000


def test_language_alphabets_are_each_languages_own():
    many = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 300)) * 5
    greek, cyrillic = "αβγδε ζηθικ λμνξο", "абвгд ежзик лмноп"
    model = language_id.fit_samples({"el": [greek], "ru": [cyrillic], "zh": [many]})
    phrases, _, _ = language_id.parse(model, [greek, cyrillic])
    assert phrases[0].tolist()[0] == phrases[1].tolist()[1] == 1
    assert min(phrases[0][1], phrases[0][2], phrases[1][0], phrases[1][2]) >= 15
    assert language_id.decide(model, [greek, cyrillic, many[:40]])["lang_pred"] == ["el", "ru", "zh"]


# ------------------------------------------------------------ op3: language model

def check_lm(rows, source):
    docs = [(d, spaced(t) + [None], zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False) for d, t in source]
    c = Counter(w for _, words, held in docs if not held for w in words)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held, len(words), sum(c[w] > 0 for w in words), n,
                    round(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in words), 5)) for d, words, held in docs)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)


def test_lm_base_is_exact_and_model_beats_it(spark, docs, texts):
    rows = maxent_lm.score_documents(docs).collect()
    check_lm(rows, list(texts.items()))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_odd_rows_and_small_blocks(spark, odd):
    rows = maxent_lm.score(odd.select("doc_id", "text", maxent_lm.held_out().alias("held_out")), block_tokens=20).collect()
    check_lm(rows, [(d, t) for d, t, _ in ODD])
    assert maxent_lm.score_documents(odd.limit(0)).count() == 0


def test_lm_is_a_distribution():
    rng = np.random.default_rng(0)
    z = maxent_lm.log_softmax(rng.normal(size=(maxent_lm.BUCKETS, maxent_lm.CLASSES)).astype(np.float32),
                              np.zeros(maxent_lm.CLASSES, np.float32), [rng.integers(0, maxent_lm.BUCKETS, 50)] * 3)
    assert np.allclose(np.exp(z).sum(axis=1), 1, atol=1e-4)


def test_lm_has_a_feature_of_two_words_and_all_classes():
    # words of one class, so that no class pair tells the histories apart
    def last(a, b):
        t = maxent_lm.Tokens(np.array([a, b, 5], np.uint64), np.full(3, 7, np.uint8), np.arange(3))
        return [int(x[0]) for x in maxent_lm.features(t, 2, 3)]
    base, other_first, other_second = last(11, 12), last(13, 12), last(11, 14)
    assert sum(x != y and x != z for x, y, z in zip(base, other_first, other_second)) == 1
    assert len(base) == 6 and (maxent_lm.CLASSES, maxent_lm.TOP_WORDS, maxent_lm.TOP_ENDINGS) == (64, 24, 31)


# ------------------------------------------------------------- op4: HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head>
<body class="with-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies and the like on this site for you.</div>
<div id="layout"><article><h1>A &amp; B</h1><p>First  paragraph
 of the&nbsp;text, with <b>bold</b> and <a href=x>one link</a> in it.</p><p>Short.</p>
<div class="ad">Buy this now, it is the best of all.</div><ul><li>Item one</li><li>Item two</li></ul>
<form><label>Name</label><input></form><p>Line one<br>line two<!-- no > text --></p>
<section id="comments"><p>A reader says that it is good and that we should have more of it.</p></section></article>
<aside><p>In the side bar there is a text that is long enough to be taken for one of the article.</p></aside></div>
<footer>&copy; 2020 and all that is in the footer of it</footer></body></html>"""


def test_html_page_parts():
    text, _, _ = html_extract.main_text(PAGE)
    assert text.split("\n\n") == ["A & B", "First paragraph of the text, with bold and one link in it.", "Short.",
                                  "Item one", "Item two", "Line one line two"]


def test_html_without_article_inherits_labels():
    long = "This is the text of it and there is more of it than there was when we had it. " * 3
    page = f"<body><div><h2>Title</h2><p>{long}</p><p>Tiny.</p><p>{long}</p></div><div class=footer><p>{long}</p></div></body>"
    assert html_extract.main_text(page)[0].split("\n\n") == ["Title", long.strip(), "Tiny.", long.strip()]


@pytest.mark.parametrize("part, text", [
    ("<header class='entry-header'><h1>Title</h1></header>", "Title"), ("<h1 class='article-header'>Title</h1>", "Title"),
    ("<h2 id='related-work'>Related work</h2>", "Related work"),
    ("<section id='legal-history'><h2>History</h2><p>The law of the land was made in the year of the king.</p></section>",
     "History\n\nThe law of the land was made in the year of the king."),
    ("<p>It is known that <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is a solution.</p>", "It is known that x=1 is a solution."),
    ("<div class='related'><h3>Related</h3><ul><li><a href='/a'>A first one of the posts</a></li></ul></div>", ""),
    ("<div class='share-buttons'>Share it with all of your friends on the net.</div>", ""),
    ("<div class='newsletter'>Get all of our news in your mail box each week.</div>", ""),
    ("<section id='comments'><p>A reader says that it is good and that we should have more.</p></section>", ""),
    ("<div hidden>It is not seen by any of the readers of it.</div>", "")])
def test_html_weak_names_in_an_article_dont_decide_alone(part, text):
    first, last = "The first of the paragraphs is in here.", "The last of the paragraphs is in here."
    got = html_extract.main_text(f"<body><article><p>{first}</p>{part}<p>{last}</p></article></body>")[0]
    assert got == "\n\n".join(x for x in (first, text, last) if x)


def test_html_linked_text_of_an_article_stays():
    refs = ["A study of the sea", "On tides", "The report of the board on it"]
    page = ("<body><article><h1>Tides</h1><p><a href='/r'>The full text of the report is to be found here</a></p><ul>"
            + "".join(f"<li><a href='/{i}'>{t}</a></li>" for i, t in enumerate(refs)) + "</ul></article>"
            "<ul><li><a href='/m'>More of the stories that all of our readers have read on this site</a></li></ul></body>")
    assert html_extract.main_text(page)[0].split("\n\n") == ["Tides", "The full text of the report is to be found here", *refs]


@pytest.mark.parametrize("paragraph", [
    "Вода в заливе поднялась ночью, и к утру жители прибрежных улиц уже выносили мебель на верхние этажи домов. ",
    "Zalew podniósł się nocą, więc mieszkańcy nadbrzeżnych ulic wynosili rano meble na wyższe piętra domów. ",
    "夜のうちに湾の水位が上がり、朝には海沿いの通りに住む人々が家具を上の階へ運び出していた。市は避難所を開いた。"])
def test_html_pages_in_other_languages(paragraph):
    long, menu = (paragraph * 4).strip(), "".join(f"<li><a href='/{i}'>{paragraph[:12]}</a></li>" for i in range(6))
    page = (f"<body><nav><ul>{menu}</ul></nav><div><h1>{paragraph[:14].strip()}</h1><p>{long}</p><p>{long}</p></div>"
            f"<div><ul>{menu}</ul></div><footer><p>{long}</p></footer></body>")
    assert html_extract.main_text(page)[0].split("\n\n") == [paragraph[:14].strip(), long, long]


@pytest.mark.parametrize("unit, tail", [
    ('<a "', ""), ("<a '\"", ""), ("<!", ""), ("<a", ""), ("<a x=", ""), ("<div>", "</p>"), ("<p><article><div>", "</p>"),
    ("<article>", "</b>"), ("<script>", ""), ("<!--", ""), ("&amp", ""), ("<a href='", ">"), ("<br>", "<")])
def test_html_time_grows_with_the_page(unit, tail):
    import time
    half = 500_000 if tail else 1_000_000
    page = unit * (half // len(unit)) + (tail * (half // len(tail)) if tail else "")
    start = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - start < 5


def test_html_matches_structure_of_pages(spark):
    import html
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = by_id(html_extract.extract(pages), "page_id")
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_html_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<script>never closed"), (4, "u", "<!-- never closed <p>x"),
            (5, "u", "<" * 5000 + "<a <a \"<p"), (6, "u", "<article>" + "<p>Word and &lt;more&gt; of it all.</p>" * 20_000)]
    table = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html_extract.extract(table).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert [texts[k] for k in (1, 2, 3, 4)] == [""] * 4
    assert texts[6] == "\n\n".join(["Word and <more> of it all."] * 20_000)
    assert html_extract.extract(table.limit(0)).count() == 0


# --------------------------------------------------------------- op5: license scan

def check_licenses(rows, source):
    want = Counter()
    for d, t in source:
        words, places = alnum(t), []
        for phrase, label in licenses.BASE:
            p = phrase.split()
            places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        at = [i for i, _ in places]
        want[(d, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_license_base_phrases(spark, docs, odd, texts):
    check_licenses(licenses.digest(licenses.scan(docs)).collect(), list(texts.items()))
    check_licenses(licenses.digest(licenses.scan(odd)).collect(), [(d, t) for d, t, _ in ODD])
    assert licenses.scan(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("GNU Lesser General Public License v2.1 or later", {"lgpl-2.1"}),
    ("SPDX-License-Identifier: MIT License", {"mit"}),
    ("released under CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0"}),
    ("Creative Commons Attribution-ShareAlike 3.0", {"cc-by-sa-3.0"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
    ("see the mit license and the BSD 3-Clause license", {"mit", "bsd-3-clause"}),
    ("the apache tribe had no license", set()), ("nothing to see", set())])
def test_license_rules_and_suppression(text, labels):
    assert {d.label for d in licenses.scan_text(text)[2]} == labels


def test_license_rules_are_many_and_gated():
    assert len(licenses.RULES) >= 300 and all(r.keyword for r in licenses.RULES)


def alternatives(tree, most):
    """Texts of a parsed pattern: every branch, optional parts all in (most) or all out."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            got = [chr(arg)]
        elif op == "IN":
            got = [chr(x) for o, x in arg if str(o) == "LITERAL"] if str(arg[0][0]) == "LITERAL" else ["9"]
        elif op in ("ANY", "NOT_LITERAL"):
            got = ["x"]
        elif op == "BRANCH":
            got = [x for b in arg[1] for x in alternatives(b, most)]
        elif op == "SUBPATTERN":
            got = alternatives(arg[3], most)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            got = [x * (min(arg[1], 2) if most else arg[0]) for x in alternatives(arg[2], most)]
        else:
            assert op in ("ASSERT",), op
            got = [""]
        out = list(dict.fromkeys(x + y for x in out for y in got))
    return out


def test_license_prefilter_loses_no_alternative():
    seen = set()
    for rule in licenses.RULES:
        for most in (False, True):
            for text in alternatives(re._parser.parse(rule.pattern.pattern.decode()), most):
                line = f" {text} ".encode()
                assert rule.pattern.search(line), (rule.label, text)
                assert any(k in line for k in rule.keyword), (rule.label, text)
                seen.add(line)
    for line in random.Random(0).sample(sorted(seen), 1500):
        assert licenses.detections(line) == licenses.detections(line, prefilter=False), line


@pytest.mark.parametrize("text, label", [
    ("AGPLv3", "agpl-3.0"), ("GNU AGPLv3", "agpl-3.0"), ("AGPL-3.0", "agpl-3.0"), ("MS-PL", "ms-pl"), ("MS-RL", "ms-rl"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl-3.0"), ("same terms as Perl itself", "artistic-1.0"),
    ("PSF license", "python-2.0"), ("do what the fuck you want to public license", "wtfpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("released under the Foo license", "license-reference"), ("distributed under the Foo licence", "license-reference")])
def test_license_names_without_the_family_word(text, label):
    assert {d.label for d in licenses.scan_text(text)[2]} == {label}


# ----------------------------------------------------------------- op6: SentencePiece

def test_sentencepiece_matches_library(spark, docs, odd, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for table, source in ((docs, list(texts.items())), (odd, [(d, t) for d, t, _ in ODD])):
        want = Counter()
        for d, t in source:
            ids = sp.encode(t or "", add_bos=True, add_eos=True)
            want[(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
        assert Counter(map(tuple, sentencepiece_codec.round_trip(table, PIECES).collect())) == want
        ids = sentencepiece_codec.encode(table, PIECES).collect()
        assert Counter((r.doc_id, len(r.ids)) for r in ids) == Counter((k[0], k[1]) for k in want.elements())
    assert sentencepiece_codec.round_trip(odd.limit(0), PIECES).count() == 0


def test_sentencepiece_fuzz():
    enc, sp, rng = sentencepiece_codec.PrefixEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(1)
    parts = list("abeintshr  \n\t▁éßñ中ａ😀.,!?01-—\r;{}()\x00") + ["the", "ing", "  ", "    ", "tion", "://", "\n\n"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        ids = np.frombuffer(enc.encode(s), "<u4").tolist()
        assert ids == sp.encode(s, add_bos=True, add_eos=True) and enc.decode(enc.encode(s)) == sp.decode(ids)


# -------------------------------------------------------------------- op7: URL filter

def url_truth(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


def test_url_rules_and_model(spark):
    rows = [(i, u) for i, u in enumerate([
        None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x", "http://a.example.org/en/12?q", "http://xexample.org/es/",
        "https://site.com/de/?a://b", "https://site.com", "https://x.net/a#b/c", "a://b?c/d", "https://É.com/fr/ü"])]
    rows.append((11, "https://É.com/fr/ü"))
    model = url_filter.train(url_filter.seed_table(spark))
    table = clash(spark.createDataFrame(rows, "page_id long, url string"))
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    for df in (table, pages):
        source = dict(df.select("page_id", "url").collect())
        for r in url_filter.judge(df, model).collect():
            host, path, rule, verdict = url_truth(source[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict if rule else r.verdict == ("block" if r.block_probability >= 0.5 else "allow")
    assert url_filter.judge(table, model).count() == len(rows) and url_filter.judge(table.limit(0), model).count() == 0


def test_url_model_on_unseen_sites(spark):
    model = url_filter.train(url_filter.seed_table(spark))
    bad = ["mega-casino", "best-bets", "pills-cheap", "ads-network", "poker-win"]
    good = ["thertion", "ththre", "city-library", "historymuseum", "ering"]
    rows = [(i, f"https://www.{n}.example.net/en/77") for i, n in enumerate(bad + good)]
    got = by_id(url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), model, []), "page_id")
    assert [got[i].verdict for i in range(10)] == ["block"] * 5 + ["allow"] * 5


def test_url_query_runs_no_python(spark):
    plan = E.queries()["op7_url_filter"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --------------------------------------------------------------------- op8: near copies

def exact_components(rows):
    sets = {}
    for d, t in rows:
        w = spaced(t)
        s = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        sets.setdefault(d, []).append(s)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if find(a) != find(b) and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: {len(s) for s in v} for d, v in sets.items()}


def check_dedup(rows, source):
    known = [(d, t) for d, t in source if d is not None]
    want, sizes = exact_components(known)
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in source)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]) and r.n_shingles in sizes[r.doc_id]


def test_dedup_matches_brute_force(spark, docs, texts):
    check_dedup(near_dedup.near_duplicates(docs).collect(), list(texts.items()))


def test_dedup_chains_hot_groups_and_borders(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows, n = [], 0
    for _ in range(60):  # near copies of one text, all different
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(120)] = rng.choice(words)
        rows.append((n := n + 1, " ".join(t)))
    t = [rng.choice(words) for _ in range(60)]
    for _ in range(25):  # a chain that drifts
        t = list(t)
        t[rng.randrange(60)] = rng.choice(words)
        rows.append((n := n + 1, " ".join(t)))
    passage = [rng.choice(words) for _ in range(40)]
    for _ in range(40):  # a shared passage, not alike enough
        rows.append((n := n + 1, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(5, 60))])))
    for k in range(1, 30):  # short texts around the threshold
        rows.append((n := n + 1, " ".join(words[:k])))
    rows += [(n + i, rows[0][1].upper()) for i in range(1, 20)]
    rng.shuffle(rows)
    check_dedup(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_dedup_odd_rows(spark, odd):
    check_dedup(near_dedup.near_duplicates(odd).collect(), [(d, t) for d, t, _ in ODD])
    kept = near_dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(
        (d is None, d or 0) for d in (1, 2, 3, 4, 5, 6, 7, 9, None))
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_odd_sketch_counts_differences_and_never_hides_a_link(spark):
    rng = np.random.default_rng(2)
    rows, truth = [], []
    for n in (1, 4, 30, 200, 1500, 2500, 9000):
        for share in (0.5, 0.65, 0.75, 0.76, 0.9, 1.0):
            x = rng.permutation(np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64)))
            common = int(np.ceil(len(x) * share))
            a, b = np.sort(np.concatenate([x[:common], x[common::2]])), np.sort(np.concatenate([x[:common], x[common + 1::2]]))
            p, q = near_dedup.odd_sketch(a), near_dedup.odd_sketch(b)
            if max(len(a), len(b)) <= near_dedup.SAMPLE:
                assert np.bitwise_count(p ^ q).sum() <= len(x) - common
            rows.append((len(truth), len(a), len(b), p.view(np.int64).tolist(), q.view(np.int64).tolist()))
            truth.append((near_dedup.linked(a, b), common / len(x)))
    df = spark.createDataFrame(rows, "i int, n long, m long, p array<long>, q array<long>")
    side = lambda n, v: df.select("i", F.col(n).alias("n_shingles"), *[F.col(v)[k].alias(f"s{k}") for k in range(near_dedup.SKETCH_WORDS)])
    got = dict(side("n", "p").alias("l").join(side("m", "q").alias("r"), F.expr("l.i = r.i"))
               .select("l.i", near_dedup.may_link("l", "r", 75)).collect())
    assert all(got[i] for i, (link, _) in enumerate(truth) if link)
    exact = lambda i: 200 <= max(rows[i][1:3]) <= near_dedup.SAMPLE
    assert not any(got[i] for i, (_, share) in enumerate(truth) if share < 0.66 and exact(i) or share < 0.51 and rows[i][1] >= 200)


def test_components_of_a_path_and_a_star(spark):
    rng, edges = random.Random(3), [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(40)] + [(7, 7)]
    rng.shuffle(edges)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(51)} | {100 + k: 100 for k in range(40)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -------------------------------------------------------------------- op9: token files

def library_ids(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTES)
    return [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def check_files(rows, source):
    order = sorted(source, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    start, want = 0, []
    for (d, _), ids in zip(order, library_ids([t for _, t in order])):
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_token_files(spark, docs, odd, texts):
    check_files(token_file.write_and_read(docs, BYTES).collect(), list(texts.items()))
    check_files(token_file.write_and_read(odd, BYTES).collect(), [(d, t) for d, t, _ in ODD])
    assert token_file.write_and_read(odd.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31])
def test_bit_packing_and_random_access(bits, tmp_path):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 1, 5, 700, 3, 0, 129)]
    path = tmp_path / "x.tkbp"
    with path.open("wb") as out:
        w = token_file.Writer(out, bits, block_ids=64)
        for k, d in enumerate(docs):
            w.add(k * 10, d)
        assert w.close() == sum(map(len, docs))
    with path.open("rb") as source:
        r = token_file.Reader(source, path.stat().st_size)
        assert r.doc_ids == [k * 10 for k in range(len(docs))]
        for k in reversed(range(len(docs))):
            assert np.array_equal(r.document(k), docs[k])
        assert np.array_equal(r.ids(3, 500), np.concatenate(docs)[3:503])


def test_token_file_encoding_equals_library():
    enc, rng = token_file.encoder(BYTES), random.Random(4)
    parts = list("abet  \n\t'sé,.?!1-  \r\x1c\x85　中") + ["the", "'ll", " the", "n't", "\n\n", " 's", "<|endoftext|>"]
    some = ["".join(rng.choice(parts[:rng.choice([12, 19, len(parts)])]) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    assert [x + [0] for x in enc.encode(some)] == library_ids(some)


def test_token_files_of_other_ids(spark):
    rows = [("b", "two words"), ("a", "one"), (None, None), ("b", "a b c")]
    for kind in ("string", "smallint", "decimal(9,2)"):
        df = spark.createDataFrame(rows, "doc_id string, text string")
        if kind != "string":
            df = df.withColumn("doc_id", F.ascii("doc_id").cast(kind))
        got = sorted(token_file.write_and_read(df, BYTES).collect(), key=lambda r: r.start)
        assert [r.n_tokens for r in got] == [1, 2, 4, 3] and got[0].doc_id is None
        assert [r.doc_id for r in got[1:]] == {"string": ["a", "b", "b"], "smallint": [97, 98, 98]}.get(kind, ["97.00", "98.00", "98.00"])


# --------------------------------------------------------------- op10: decontamination

def check_hits(rows, source, bench):
    wins = {}
    for item, text in bench:
        w = alnum(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[i:i + 10]), set()).update([] if item is None else [item])
    sizes, want = {len(k) for k in wins}, Counter()
    for d, t in source:
        w, hit, items = alnum(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i:i + size])) in wins:
                    hit.update(range(i, i + size))
                    items |= wins[key]
        want[(d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit))] += 1
    assert Counter(map(tuple, rows)) == want


def test_decontamination_matches_brute_force(spark, docs, texts):
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    rows = decontaminate.digest(decontaminate.decontaminate(docs, bench)).collect()
    check_hits(rows, list(texts.items()), [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert any(r.contaminated for r in rows)


@pytest.mark.parametrize("block_windows", [100_000, 3])
def test_decontamination_random_small_vocabulary(spark, block_windows):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcé") for _ in range(n))
    bench = [(i, text(rng.choice([1, 2, 3, 5, 10, 12]) if i > 4 else 11)) for i in range(9)]
    bench += [(0, bench[0][1]), (50, bench[1][1]), (None, text(4)), (60, None), (61, ""), (62, "?!")]
    source = [(i, text(rng.randint(0, 80))) for i in range(60)] + [(d, t) for d, t, _ in ODD]
    docs = clash(spark.createDataFrame(source, "doc_id long, text string"))
    table = clash(spark.createDataFrame(bench, "item_id long, text string"))
    rows = decontaminate.digest(decontaminate.decontaminate(docs, table, block_windows=block_windows)).collect()
    check_hits(rows, source, bench)
    clean = Counter(r.doc_id for r in decontaminate.clean(docs, table, block_windows=block_windows).collect())
    assert clean == Counter(r.doc_id for r in rows if not r.contaminated)


def test_decontamination_empty_tables(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.digest(decontaminate.decontaminate(odd, bench)).collect()
    check_hits(rows, [(d, t) for d, t, _ in ODD], [])
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(odd.limit(0), some).count() == 0
