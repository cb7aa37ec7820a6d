"""The corpus pipeline against a brute-force version of its stages."""

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from tablelab.llm import language_id
from tests.conftest import SF_SMALL
from tests.llm.test_llm import DOC, ODD, PIECES, alnum, clash, exact_components


def brute(rows, langs, bench):
    rows = [(d, t) for d, t in rows if d in langs]
    want, _ = exact_components(rows)
    rows = [(d, t) for d, t in rows if want[d] == d]
    wins = {tuple(w[i:i + 10]) for w in map(alnum, bench) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(k) for k in wins}

    def dirty(t):
        w = alnum(t)
        return any(tuple(w[i:i + n]) in wins for n in sizes for i in range(len(w) - n + 1))
    return {d: t for d, t in rows if not dirty(t)}


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("phrase_chars") >= 2)).collect()
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], {r.doc_id for r in found}, bench)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert got == {d: sp.encode(t, add_bos=True, add_eos=True) for d, t in want.items()}
    assert len(found) == docs.count()  # clean documents stay


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = clash(spark.createDataFrame(ODD, DOC).withColumn("source", F.lit(None).cast("string")))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF_SMALL)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF_SMALL).count() == table.count()
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF_SMALL).collect()}
    assert not kept & {1, 2, 3, 4} and {5, 7, None} <= kept
