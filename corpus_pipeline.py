"""Corpus pipeline: the stages of a training-data run over ``documents``.

``STAGES`` are applied in order, each to all that its predecessor kept; each is
written as Parquet in the shared folder and read again.  All but the last
return the columns of documents.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tablelab.llm import decontaminate, language_id, near_dedup, sentencepiece_codec  # noqa: E402
from tablelab.llm.common import read_table, written  # noqa: E402


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without
    letters and texts that parse into no language's phrases go."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.clear_text(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, SentencePiece ids (with begin and end ids) and their number."""
    ids = sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", identify_language), ("near copies", drop_near_copies),
          ("benchmark", drop_benchmark), ("sentencepiece", encode)]

#: Not expressible in SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
