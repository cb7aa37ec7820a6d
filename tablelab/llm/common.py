"""Helpers shared by the training-data operators.

Word rules (both lower-case only A-Z, on UTF-8 bytes):

* ``alnum_words``  maximal runs of 0-9, a-z and every non-ASCII character;
* ``space_words``  maximal runs of characters other than space and TAB..CR.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelab.session import ensure_checkpoint_dir


def _alnum_table() -> bytes:
    table = bytearray(b" " * 256)
    for c in range(256):
        if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80:
            table[c] = c
        elif 0x41 <= c <= 0x5A:
            table[c] = c + 32
    return bytes(table)


ALNUM_TABLE = _alnum_table()


def alnum_words(text: str | None) -> list[bytes]:
    return text.encode().translate(ALNUM_TABLE).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_bucket(id_column: str, buckets: int) -> Column:
    """crc32 of the id written as text, modulo ``buckets`` (null id: null)."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(buckets)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, **options) -> DataFrame:
    """Cut the lineage with a table in the shared folder and read it again;
    any executor can read it after another one is lost."""
    path = scratch_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(dict of column lists) -> dict of column lists`` per Arrow batch."""
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs``, columns unchanged, for which ``keep(texts)`` says True."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(a, 2000) for a in range(0, whole.num_rows, 2000)):
                yield b.filter(pa.array(keep(b.column(b.schema.names.index("text")).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))
