"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelab.llm import (decontaminate, html_extract, knn_join, language_id, licenses, maxent_lm, near_dedup,
                          sentencepiece_codec, substring_dedup, token_align, token_file, url_filter, vector_codes)
from tablelab.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_voronoi_knn(spark, sf_dir):
    return knn_join.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLES["op1_voronoi_knn"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score
           FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op2_language_id(spark, sf_dir):
    return language_id.predict(read_table(spark, sf_dir, "documents"))


@query
def op3_maxent_lm(spark, sf_dir):
    return maxent_lm.score_documents(read_table(spark, sf_dir, "documents"))


@query
def op4_html_extract(spark, sf_dir):
    return html_extract.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op5_license_scan(spark, sf_dir):
    return licenses.digest(licenses.scan(read_table(spark, sf_dir, "documents")))


@query
def op6_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.round_trip(read_table(spark, sf_dir, "documents"),
                                          public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_url_filter(spark, sf_dir):
    model = url_filter.train(url_filter.seed_table(spark))
    return url_filter.judge(read_table(spark, sf_dir, "pages"), model)


@query
def op8_odd_sketch_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op9_token_file(spark, sf_dir):
    return token_file.write_and_read(read_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.decontaminate(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


@query
def op11_vector_codes(spark, sf_dir):
    return vector_codes.encode(read_table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


def _vector_codes_sql(rounds: int = 2) -> str:
    """One common table expression per step: parts of the vectors, then by turns
    the nearest entries (near) and the entries moved to their means (book)."""
    near = """near{k} AS (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT t.vec_id, t.p, b.e, sum((t.x - b.x) * (t.x - b.x)) AS d
    FROM part t JOIN book{k} b ON t.p = b.p AND t.j = b.j GROUP BY t.vec_id, t.p, b.e) GROUP BY vec_id, p)"""
    book = """book{n} AS (
  SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT t.p, a.e, t.j, CAST(sum(t.x) AS BIGINT) // count(*)
           - CASE WHEN CAST(sum(t.x) AS BIGINT) % count(*) < 0 THEN 1 ELSE 0 END AS x
    FROM part t JOIN near{k} a ON t.vec_id = a.vec_id AND t.p = a.p GROUP BY t.p, a.e, t.j) m
  ON b.p = m.p AND b.e = m.e AND b.j = m.j)"""
    steps = [near.format(k=0)]
    for k in range(rounds):
        steps += [book.format(k=k, n=k + 1), near.format(k=k + 1)]
    return """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x,
                  len(embedding) // 16 AS w
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, (i - 1) // w AS p, (i - 1) % w AS j, x[i] AS x
         FROM v, LATERAL (SELECT unnest(range(1, len(v.x) + 1)) AS i)),
book0 AS (SELECT p, s.e, j, x FROM part JOIN (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v) s USING (vec_id) WHERE s.e < 64),
""" + ",\n".join(steps) + f""",
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM near{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), book"""


ORACLES["op11_vector_codes"] = _vector_codes_sql()


@query
def op12_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_token_align(spark, sf_dir):
    return token_align.alignment(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model")).drop("pairs", "links")
