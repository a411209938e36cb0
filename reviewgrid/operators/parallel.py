"""Parallelism guard for per-row heavy operators.

Per-row text work (chunking, tokenising, scoring) is as parallel as the
scan, and a scan is as parallel as its row groups: a file is cut into splits by
its size, but a split that holds the start of no row group is an empty
task. A table of fewer files than the session has cores, and fewer bytes than
that many row groups, is dealt by its key into as many partitions as there are cores; a larger one already
has more row groups and is left alone (no shuffle).

Use it on plain table scans, before texts are widened.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP_BYTES = 128 << 20  # Parquet's default


def spread(df: DataFrame, key: list[str]) -> DataFrame:
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= want or row_groups(spark, tuple(sorted(files))) >= want:
        return df
    return df.repartition(want, *key)


@lru_cache(maxsize=64)
def row_groups(spark: SparkSession, files: tuple[str, ...]) -> int:
    """How many row groups the files hold at most when written in the default size (a few files: their
    lengths are listed, their content is not read)."""
    sizes = spark.read.format("binaryFile").load(list(files)).select("length").collect()
    return sum(-(-r["length"] // ROW_GROUP_BYTES) for r in sizes)
