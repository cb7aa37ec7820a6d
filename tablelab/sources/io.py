"""Sources and sinks.

Readers return lazy DataFrames; nothing is materialised on the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions.fixed import NA_TOKENS
from tablelab.functions.stats import q

SUPPORTED_SUFFIXES = (".csv", ".parquet", ".json", ".jsonl")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S1. Header CSV with pandas-style NA tokens and inferred column types.

    With a schema the file is read once.  Without one, every column is read as a
    string, NA tokens become null, and the type of each column is decided by a
    single aggregate (long if every non-null value casts to long, else double
    if every one casts to double, else string) -- one distributed pass instead
    of Spark's row-sampling ``inferSchema``.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.option("inferSchema", False).csv(path)
    tokens = F.array(*[F.lit(t) for t in NA_TOKENS])
    cleaned = raw.select(*[
        F.when(F.array_contains(tokens, F.col(f"`{c}`")), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
        for c in raw.columns])
    checks = []
    for i, c in enumerate(cleaned.columns):
        col = q(c)
        checks += [F.count(col).alias(f"n{i}"), F.count(as_long(col)).alias(f"l{i}"), F.count(as_double(col)).alias(f"d{i}"),
                   F.count_if(F.lower(F.trim(col)).isin("true", "false")).alias(f"b{i}")]
    row = cleaned.agg(*checks).first() if checks else None
    out = []
    for i, c in enumerate(cleaned.columns):
        n, nl, nd, nb = (row[f"{k}{i}"] for k in "nldb")
        if n > 0 and nl == n:
            out.append(as_long(q(c)).alias(c))
        elif n > 0 and nd == n:
            out.append(as_double(q(c)).alias(c))
        elif n > 0 and nb == n:
            out.append((F.lower(F.trim(q(c))) == "true").alias(c))
        else:
            out.append(q(c))
    return cleaned.select(*out)


def as_long(c: Column) -> Column:
    """Decimal integers only, else null."""
    return F.when(F.trim(c).rlike("^[+-]?[0-9]+$"), F.trim(c).try_cast("bigint"))


def as_double(c: Column) -> Column:
    """Decimal numbers, inf and nan, else null (a cast alone also takes "1d")."""
    number = r"(?i)^[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)$"
    return F.when(F.trim(c).rlike(number), F.trim(c).try_cast("double"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              lines: bool | None = None) -> DataFrame:
    """S3. ``.json`` holds one document (array of records) and is read by one
    task per file; ``.jsonl`` (or ``lines=True``) holds one record per line:
    splittable, the form to use at scale."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if path.endswith(".jsonl") if lines is None else lines:
        return reader.json(path)
    return reader.option("multiLine", True).json(path)


def load_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """S4. Dispatch on the file suffix (or an explicit ``fmt``); anything else
    is rejected."""
    kind = fmt or os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, lines=kind == "jsonl")
    raise ValueError(f"unsupported format {kind!r}; expected one of {SUPPORTED_SUFFIXES}")


def rows_frame(spark: SparkSession, rows: list[dict], schema: T.StructType | str | None = None) -> DataFrame:
    """S5. A list of records as a frame.  Keys missing from a record are null."""
    if schema is None:
        keys: list[str] = []
        for r in rows:
            for k in r:
                if k not in keys:
                    keys.append(k)
        rows = [{k: r.get(k) for k in keys} for r in rows]
    return spark.createDataFrame(rows, schema=schema)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S6 / S7. Distributed CSV write (one file per partition) with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_text_lines(lines: DataFrame, path: str, order_col: str = "seq", text_col: str = "line") -> None:
    """S9. Write an ordered (seq, line) frame as one text document.  The frame
    is a report (bounded size), so a single output partition is acceptable."""
    (lines.repartition(1).sortWithinPartitions(order_col)
     .select(text_col).write.mode("overwrite").text(path))


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """S10. Keep a named handle on a frame (raw beside processed)."""
    df.createOrReplaceTempView(name)
    return df


def effective_frame(raw: DataFrame, processed: DataFrame | None) -> DataFrame:
    """Processed frame if one exists, else the raw one (fixes the truth-test
    defect of the CSV export)."""
    return processed if processed is not None else raw
