"""Append-only tables of runs (M33 model registry, E26 history).

A run's rows are written to a folder of their own attempt; a marker file that
names the attempt commits the run.  Only committed attempts are read, and a run
that is committed already is left as it is, so a retried job or a run given
twice never doubles rows, and a broken attempt is never seen.  Files go through
Spark's own file systems, so any executor reads them.

Defined results: an unknown folder has no runs; rows of a run without rows are
none, but the run counts as committed; run ids are letters, digits, ``.``, ``_``
and ``-``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "COMMITTED"


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _committed(spark: SparkSession, root: str, run_id: str) -> str | None:
    fs, path = _files(spark, root)
    marker = path(f"{root}/{run_id}/{MARKER}")
    if not fs.exists(marker) or fs.getFileStatus(marker).getLen() == 0:   # empty: its writer was lost
        return None
    stream = fs.open(marker)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def append(rows: DataFrame, root: str, run_id: str) -> bool:
    """Commit ``rows`` as run ``run_id``; False if the run had been committed before."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run_id):
        raise ValueError(f"run id {run_id!r}")
    spark = rows.sparkSession
    if _committed(spark, root, run_id) is not None:
        return False
    attempt = f"data-{uuid.uuid4().hex}"
    rows.withColumn("run_id", F.lit(run_id)).write.parquet(f"{root}/{run_id}/{attempt}")
    fs, path = _files(spark, root)
    marker = path(f"{root}/{run_id}/{MARKER}")
    if fs.exists(marker) and fs.getFileStatus(marker).getLen() == 0:
        fs.delete(marker, False)
    try:
        stream = fs.create(marker, False)   # fails if another attempt was first
    except Exception:
        if _committed(spark, root, run_id) is None:
            raise
        fs.delete(path(f"{root}/{run_id}/{attempt}"), True)
        return False
    try:
        stream.writeUTF(attempt)
    finally:
        stream.close()
    return True


def runs(spark: SparkSession, root: str) -> dict[str, str]:
    """Committed run -> folder of its rows."""
    fs, path = _files(spark, root)
    if not fs.exists(path(root)):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path(root)) if s.isDirectory()]
    got = {n: _committed(spark, root, n) for n in sorted(names)}
    return {n: f"{root}/{n}/{a}" for n, a in got.items() if a is not None}


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of all committed runs with their ``run_id``; ``schema`` is that of the rows given to ``append``."""
    folders = list(runs(spark, root).values())
    schema = f"{schema}, run_id string"
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
