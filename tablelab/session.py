"""Spark session helpers.

The library never creates a cluster-wide policy on its own: it reads what the
session already carries (``spark.checkpoint.dir``, shuffle partitions) and only
fills gaps, which is what happens in local tests.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Explicit broadcast sizes are checked by the operators themselves.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "tablelab",
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: the cluster's
    ``spark.checkpoint.dir``, else the folder that the caller gave to
    ``setCheckpointDir``.  Only a local session (tests) gets a scratch folder of
    its own; on a cluster a missing folder is an error, since a driver's disk
    can't be read by executors."""
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and given.isDefined():
        return given.get()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tablelab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not given.isDefined():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor
    loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


TASK_ROWS = 16384   # fewer rows than this are not worth a task of their own


def even_out(df: DataFrame) -> DataFrame:
    """A checkpointed frame whose rows lie in few of its partitions (a table of few row
    groups), dealt evenly over all cores; any other frame is returned as it is."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]   # one row per partition
    rows, cores = sum(sizes), df.sparkSession.sparkContext.defaultParallelism
    wanted = min(max(cores, len(sizes)), -(-rows // TASK_ROWS))
    if not sizes or max(sizes) <= 2 * rows / max(1, wanted):
        return df
    return cut_lineage(df.repartition(wanted))


def rounds(sizes: list[int], cores: int) -> int:
    """Rows of the busiest core when tasks of these sizes are given to the next free one."""
    busy = [0] * cores
    for n in sizes:
        busy[busy.index(min(busy))] += n
    return max(busy)


def ended_together(blocks: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Blocks made of ``rows``, task by task; dealt anew, a task for each core, if every core has
    ``least`` rows or more and the tasks would not end together."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]   # one row per partition
    uneven = sum(sizes) >= cores * least and rounds(sizes, cores) > 1.2 * sum(sizes) / cores
    return blocks.repartition(cores) if uneven else blocks
