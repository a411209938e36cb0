"""One commit for the many tables of a micro-batch (K2-K5).

A batch writes its findings, reviews, comments and outcomes into folders of its own and
then, last, one row into the manifest. Readers that are given the manifest see the rows of
committed batches only, so a batch that dies half way is invisible until its replay is
through; a batch that is committed already is not run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "batch_id bigint, run_id string"
NONE = -1  # the empty entry that makes the folder readable


def init_manifest(spark: SparkSession, folder: str) -> None:
    spark.createDataFrame([], MANIFEST_SCHEMA).write.mode("ignore").parquet(f"{folder}/entry={NONE}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed batches, one row each."""
    return spark.read.schema(f"{MANIFEST_SCHEMA}, entry bigint").parquet(folder)


def is_committed(spark: SparkSession, folder: str, batch: int) -> bool:
    return bool(manifest(spark, folder).filter(F.col("entry") == batch).limit(1).count())


def commit(spark: SparkSession, folder: str, batch: int, run_id: str) -> None:
    """Make a batch visible: one row in one file, so it is there whole or not at all."""
    (spark.createDataFrame([(batch, run_id)], MANIFEST_SCHEMA).coalesce(1)
     .write.mode("overwrite").parquet(f"{folder}/entry={batch}"))


def committed(rows: DataFrame, folder: str | None, key: str = "batch_id") -> DataFrame:
    """The rows of committed batches (all rows if there is no manifest)."""
    if folder is None:
        return rows
    return rows.join(manifest(rows.sparkSession, folder).select(key), key, "left_semi")
