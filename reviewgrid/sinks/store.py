"""Findings and comment tables on shared storage (K1-K5).

The reviews table is parquet with one folder per run (``run_id=<run>``), rows
sorted by ``repo`` inside each file, so row groups are pruned by repo and the
number of folders follows the runs, not the repos. Its key replaces the serial
id: ``(repo, pr_number, run_id, seq)``; ``created_at`` is the batch timestamp
passed in. A run overwrites its own folder, so a replayed run leaves the table
as it was.

Comments are a log: every batch writes the comments it posts and the PRs whose
marked comments it removes, each in its own folder. ``current_comments`` is the
table that results; nothing written before is ever rewritten.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (IntegerType, LongType, StringType, StructField, StructType,
                               TimestampType)

from .commits import committed

EMPTY_RUN = "none"

REVIEWS_SCHEMA = StructType([
    StructField("pr_number", IntegerType(), False),
    StructField("severity", StringType()),
    StructField("category", StringType()),
    StructField("file_path", StringType()),
    StructField("line_number", IntegerType()),
    StructField("description", StringType()),
    StructField("suggested_fix", StringType()),
    StructField("created_at", TimestampType()),
    StructField("run_id", StringType()),
    StructField("seq", LongType()),
    StructField("repo", StringType(), False),
])

COMMENTS_SCHEMA = StructType([
    StructField("pr_number", IntegerType(), False),
    StructField("comment_id", LongType()),
    StructField("body", StringType()),
    StructField("repo", StringType(), False),
])


def init_reviews(spark: SparkSession, path: str) -> None:
    """K1: create the table if missing (an empty run; existing data stays)."""
    (spark.createDataFrame([], REVIEWS_SCHEMA).drop("run_id")
     .write.mode("ignore").parquet(f"{path}/run_id={EMPTY_RUN}"))


def read_reviews(spark: SparkSession, path: str, latest_run_only: bool = False,
                 commits: str | None = None) -> DataFrame:
    """The stored findings, read with the fixed schema; with a manifest
    (``commits``), only those of committed runs.

    ``latest_run_only`` (off by default, parity) is the opt-in repair of
    SURVEY note 17: a re-review appends a new run, and readers keep only the
    latest run of each PR (an aggregation per PR, then a semi-join).
    """
    reviews = committed(spark.read.schema(REVIEWS_SCHEMA).parquet(path), commits, "run_id")
    if not latest_run_only:
        return reviews
    latest = reviews.groupBy("repo", "pr_number").agg(
        F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    return reviews.join(latest, ["repo", "pr_number", "run_id"], "left_semi")


def conform_reviews(findings: DataFrame, created_at: dt.datetime, run_id: str,
                    seq_col: str = "seq") -> DataFrame:
    """Cast a findings frame to the reviews schema, stamping the batch time and run."""
    cols = []
    for f in REVIEWS_SCHEMA.fields:
        if f.name == "created_at":
            cols.append(F.lit(created_at).cast("timestamp").alias(f.name))
        elif f.name == "run_id":
            cols.append(F.lit(run_id).alias(f.name))
        elif f.name == "seq":
            cols.append(F.col(seq_col).cast("bigint").alias("seq"))
        elif f.name in findings.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return findings.select(*cols)


def append_reviews(findings: DataFrame, path: str, created_at: dt.datetime, run_id: str,
                   seq_col: str = "seq") -> None:
    """K2: add a run's findings (error rows included); writing the run again replaces it."""
    (conform_reviews(findings, created_at, run_id, seq_col).drop("run_id").sortWithinPartitions("repo", "pr_number")
     .write.mode("overwrite").parquet(f"{path}/run_id={run_id}"))


def write_rows(df: DataFrame, path: str) -> DataFrame:
    """Write a comment-row table (K3, K4) and return it read back with its own schema."""
    df.sortWithinPartitions("repo", "pr_number").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def comment_id(batch: int) -> Column:
    """Id of a comment posted by a batch: the same on a replay, never null.

    60 bits of the md5 of batch, repo, PR and body; ids assigned by a host are small numbers.
    """
    text = F.concat_ws("/", F.lit(str(batch)), "repo", F.col("pr_number").cast("string"), "body")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def post_comments(new: DataFrame, replaced: DataFrame, log: str, batch: int) -> None:
    """K4 + K5 of one batch: comments to post and PRs whose earlier marked comments go."""
    rows = new.select("repo", "pr_number", comment_id(batch).alias("comment_id"), "body")
    rows.write.mode("overwrite").parquet(f"{log}/posted/batch_id={batch}")
    replaced.select("repo", "pr_number").distinct().write.mode("overwrite").parquet(f"{log}/removed/batch_id={batch}")


def current_comments(existing: DataFrame, log: str, marker: str, commits: str | None = None) -> DataFrame:
    """The comments table after all batches of ``log`` (with a manifest, all committed ones).

    A batch removes the marked comments of its replaced PRs that were there before
    it: those of ``existing`` and of earlier batches.
    """
    spark = existing.sparkSession
    batch = StructField("batch_id", LongType())
    posted = committed(spark.read.schema(StructType([*COMMENTS_SCHEMA.fields, batch])).parquet(f"{log}/posted"), commits)
    gone_from = spark.read.schema("repo string, pr_number int, batch_id bigint").parquet(f"{log}/removed")
    removed = (committed(gone_from, commits)
               .groupBy("repo", "pr_number").agg(F.max("batch_id").alias("_last")))
    cols = ["repo", "pr_number", "comment_id", "body"]
    every = existing.select(*cols, F.lit(-1).cast("bigint").alias("batch_id")).unionByName(posted.select(*cols, "batch_id"))
    gone = F.col("body").contains(marker) & (F.col("_last") > F.col("batch_id"))
    return every.join(removed, ["repo", "pr_number"], "left").filter(~F.coalesce(gone, F.lit(False))).select(*cols)


def replace_stale(existing: DataFrame, new_summaries: DataFrame, targets: DataFrame, marker: str, log: str,
                  batch: int = 0) -> DataFrame:
    """K5: the marked comments of ``targets`` (PRs reviewed again, with findings or not) are
    removed and the new summaries added; returns the table that results."""
    post_comments(new_summaries, targets, log, batch)
    return current_comments(existing, log, marker)
