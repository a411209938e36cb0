"""Registry of named queries: name -> (Spark builder, DuckDB oracle SQL or None).

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame. The oracle
is ANSI SQL DuckDB runs over the same base tables; queries that cannot be
expressed in SQL register ``None`` and get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    survey_id: str


REGISTRY: dict[str, Query] = {}


def query(name: str, survey_id: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle.strip() if oracle else None, survey_id)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from . import q_aggregates, q_chunks, q_events, q_giant, q_merge, q_report, q_retrieval, q_reviewers, q_streaming  # noqa: F401
    return REGISTRY
