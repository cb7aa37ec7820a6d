"""Scoring a stream of files with a saved pipeline (Structured Streaming).

The request path that scored one row at a time becomes a file stream: new
files landing in a folder are read incrementally, aligned to the training
features, transformed by the ``PipelineModel`` and appended to a sink.  The
query is stateless, so exactly-once output only needs the checkpoint
location (in the shared checkpoint folder) and a file sink.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablelab.operators.score import align_features, predict


def score_stream(spark: SparkSession, model: PipelineModel, source_dir: str, schema: T.StructType,
                 features: list[str], key: list[str], sink_dir: str, checkpoint_dir: str,
                 glob: str | None = None, classes: list[str] | None = None, available_now: bool = True,
                 max_files_per_trigger: int | None = None):
    """Start the stream; with ``available_now`` it processes what is there and
    stops.  Returns the StreamingQuery."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    scored = predict(model, align_features(stream, features, key), classes)
    cols = [*key, "prediction"] + [c for c in ("confidence", "predicted_class") if c in scored.columns]
    writer = (scored.select(*cols).writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def run_to_completion(spark: SparkSession, *args, **kwargs) -> DataFrame:
    """Run :func:`score_stream` with ``availableNow`` and read the sink back."""
    kwargs["available_now"] = True
    query = score_stream(spark, *args, **kwargs)
    query.awaitTermination()
    sink_dir = kwargs.get("sink_dir") or args[5]
    return spark.read.parquet(sink_dir)
