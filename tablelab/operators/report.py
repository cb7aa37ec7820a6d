"""Markdown report (R1-R6) as an ordered ``(section, seq, line)`` frame built
from the profile frames; every line is a Spark expression over small
aggregate results, and the assembled document is written with the text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.stats import attach
from tablelab.operators import profile as P

def _lines(section: int, arr) -> DataFrame:
    return arr.select(F.posexplode(F.col("_lines")).alias("seq", "line")).select(
        F.lit(section).alias("section"), F.col("seq").cast("int").alias("seq"), "line")


def summary_section(df: DataFrame, filename: str, roles: dict | None = None) -> DataFrame:
    """Shape, health, role counts, missing total, duplicates."""
    roles = roles or P.infer_roles(df)
    hs = P.health_score(df, roles)
    miss = df.agg(F.count(F.lit(1)).alias("n_rows"),
                  sum((F.count(F.lit(1)) - F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0)).alias("missing"))
    dup = P.duplicate_rows(df)
    row = attach(attach(miss, hs), dup)
    lines = F.array(
        F.lit(f"# Profile of {filename}"),
        F.lit("| measure | value |"),
        F.lit("|---|---|"),
        F.format_string("| rows | %d |", "n_rows"),
        F.lit(f"| columns | {len(df.columns)} |"),
        F.lit(f"| numeric columns | {len(roles['numeric'])} |"),
        F.lit(f"| categorical columns | {len(roles['categorical'])} |"),
        F.format_string("| empty cells | %d |", "missing"),
        F.format_string("| repeated rows | %d |", "n_duplicates"),
        F.format_string("| health | %d of 100 (%s) |", "health_score", "health_label"))
    return _lines(1, row.select(lines.alias("_lines")))


def issues_section(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """R2: one line per issue (or a no-issue line) and per detected PII type."""
    roles = roles or P.infer_roles(df)
    iss = P.health_issues(df, roles).select(F.format_string(
        "- %s %s: %s (%s)", "kind", F.coalesce("column", F.lit("*")), F.col("value").cast("string"), "severity")
        .alias("l"))
    pii = P.pii_detection(df).where("detected").select(
        F.format_string("- %s: possible %s", "column", F.upper("pii_type")).alias("l"))
    agg = attach(iss.agg(F.array_sort(F.collect_list("l")).alias("i")),      # one line per issue
                 pii.agg(F.array_sort(F.collect_list("l")).alias("p")))       # one per (column, type)
    lines = F.concat(
        F.array(F.lit("# Findings")),
        F.when(F.size("i") > 0, F.col("i")).otherwise(F.array(F.lit("- none"))),
        F.when(F.size("p") > 0, F.concat(F.array(F.lit("# Personal data")), F.col("p"))).otherwise(F.array()))
    return _lines(2, agg.select(lines.alias("_lines")))


def columns_section(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """Markdown table, one row per column: type, missing, unique, mean and
    std for numerics, else the top value.  Built from the column profile (two
    scans of the input for all columns)."""
    prof = P.column_profile(df, digits=12)
    summ = F.when(F.col("role") == "numeric",
                  F.format_string("mean=%.2f, std=%.2f", F.coalesce("mean", F.lit(float("nan"))),
                                  F.coalesce("std", F.lit(float("nan"))))
                  ).otherwise(F.concat(F.lit("Top: "), F.coalesce("top", F.lit("N/A"))))
    body = prof.select((F.col("ordinal") + 1).cast("int").alias("seq"), F.format_string(
        "| %s | %s | %d | %d | %s |", "column", "dtype", "n_missing", "n_unique", summ).alias("line"))
    head = df.sparkSession.createDataFrame(
        [(-2, "# Columns"), (-1, "| column | type | empty | distinct | center or most frequent |"),
         (0, "|---|---|---|---|---|")], "seq int, line string")
    return head.unionByName(body).select(F.lit(3).alias("section"), (F.col("seq") + 2).alias("seq"), "line")


def history_section(history: DataFrame) -> DataFrame:
    """``history(run int, at timestamp, type string, n_results long, insights array<string>)``
    -> a heading per run and its first five insights."""
    per = history.select("run", F.concat(
        F.array(F.format_string("## Run %d (%s), %s", "run", "type", F.date_format("at", "yyyy-MM-dd HH:mm:ss")),
                F.format_string("- results: %d", "n_results")),
        F.transform(F.slice("insights", 1, 5), lambda s: F.concat(F.lit("  - "), s))).alias("ls"))
    ex = per.select("run", F.posexplode("ls").alias("i", "line"))
    body = ex.select((F.col("run") * 100 + F.col("i") + 1).cast("int").alias("seq"), "line")
    head = history.sparkSession.createDataFrame([(0, "# Runs")], "seq int, line string")
    return head.unionByName(body).select(F.lit(4).alias("section"), "seq", "line")


def models_section(registry: DataFrame) -> DataFrame:
    """Registry rows ``(name, type, framework, scores string, cv_mean, cv_std)``."""
    lines = F.array(F.concat(F.lit("## "), F.col("name")),
                    F.concat(F.lit("- problem: "), F.col("type")),
                    F.concat(F.lit("- library: "), F.col("framework")),
                    F.concat(F.lit("- scores: "), F.col("scores")),
                    F.format_string("- folds: mean %s, deviation %s", F.col("cv_mean").cast("string"),
                                    F.col("cv_std").cast("string")))
    from pyspark.sql import Window
    w = Window.orderBy("name")   # one row per registered model
    ex = registry.withColumn("_m", F.row_number().over(w)).select("_m", F.posexplode(lines).alias("i", "line"))
    body = ex.select((F.col("_m") * 10 + F.col("i")).cast("int").alias("seq"), "line")
    head = registry.sparkSession.createDataFrame([(0, "# Models")], "seq int, line string")
    return head.unionByName(body).select(F.lit(5).alias("section"), "seq", "line")


def next_steps_section(df: DataFrame, roles: dict | None = None, registry: DataFrame | None = None,
                       skew: float = 1.0, unstable: float = 0.1) -> DataFrame:
    """What the data themselves ask for: a line per column or table issue, per
    skewed numeric column, and per registered model whose folds deviate by more
    than ``unstable`` of their mean.  Bounded by columns, issues and models."""
    roles = roles or P.infer_roles(df)
    todo = {"missing": "fill or drop the empty cells", "duplicates": "drop the repeated rows",
            "imbalance": "weight the classes or split by stratum"}
    action = F.lit("look into it")
    for kind, text in todo.items():
        action = F.when(F.col("kind").contains(kind), F.lit(text)).otherwise(action)
    lines = P.health_issues(df, roles).select(F.concat(
        F.lit("- "), F.coalesce("column", F.lit("table")), F.lit(": "), "kind", F.lit(", "), action).alias("line"))
    if roles["numeric"]:
        skews = df.agg(*[F.skewness(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(roles["numeric"])])
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"s{i}").alias("s")) for i, c in enumerate(roles["numeric"])])
        lines = lines.unionByName(skews.select(F.explode(pairs).alias("p")).where(F.abs("p.s") > skew).select(
            F.format_string("- %s: skewness %.2f, try a logarithm", "p.c", "p.s").alias("line")))
    if registry is not None:
        lines = lines.unionByName(registry.where(F.col("cv_std") > unstable * F.abs("cv_mean")).select(
            F.format_string("- model %s: folds deviate by %.2f", "name", "cv_std").alias("line")))
    all_lines = lines.agg(F.array_sort(F.collect_list("line")).alias("l"))  # a line per issue, column or model
    out = F.concat(F.array(F.lit("# Next steps")), F.when(F.size("l") > 0, F.col("l")).otherwise(F.array(F.lit("- none"))))
    return _lines(6, all_lines.select(out.alias("_lines")))


def assemble(*sections: DataFrame) -> DataFrame:
    """The sections as one frame, in the order of their numbers."""
    out = sections[0].select("section", "seq", "line")
    for s in sections[1:]:
        out = out.unionByName(s.select("section", "seq", "line"))
    return out


def to_markdown_lines(report: DataFrame) -> DataFrame:
    """Global line order for the text sink: (n, line)."""
    return report.select(((F.col("section") * 1_000_000) + F.col("seq")).alias("n"), "line")
