"""Name -> (Spark query, DuckDB oracle SQL) registry behind ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None, *operators: str):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.
    ``oracle`` is DuckDB SQL over the driver views, or None when the result is
    not reproducible in SQL (rows-only check)."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, oracle, tuple(operators))
        return fn
    return deco


# ---------------------------------------------------------------- SQL helpers

def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def per_column(cols: list[str], template: str, source: str) -> str:
    """One SELECT per column joined by UNION ALL; ``template`` uses {c} (name),
    {i} (ordinal) and is the select list."""
    return union_all([f"SELECT {template.format(c=c, i=i)} FROM {source}" for i, c in enumerate(cols)])
