"""Base parquet tables (read with column pruning and filter pushdown)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in BASE_TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_FROM = re.compile(r"\b(from|join)\s+(" + "|".join(BASE_TABLES) + r")\b", re.IGNORECASE)


def run_sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run Spark SQL whose FROM/JOIN names base tables or given frames.

    Table names are bound to DataFrames through the SQL formatter, so no
    session-global view is created and two scale factors never collide.
    """
    escaped = text.replace("{", "{{").replace("}", "}}")
    used: dict[str, DataFrame] = dict(frames)

    def bind(m: re.Match) -> str:
        name = m.group(2).lower()
        if name not in used:
            used[name] = table(spark, sf_dir, name)
        return f"{m.group(1)} {{{name}}}"

    escaped = _FROM.sub(bind, escaped)
    for name in frames:
        escaped = re.sub(r"\b(from|join)\s+" + re.escape(name) + r"\b",
                         lambda m: f"{m.group(1)} {{{name}}}", escaped, flags=re.IGNORECASE)
    return spark.sql(escaped, **used)
