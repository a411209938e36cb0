"""Diffs stored so that a micro-batch reads only the part it needs.

The table is partitioned by a bucket of (repo, pr_number), so one busy repo spreads over all
buckets; files are cut to the advisory size (``rebalance``) and sorted by PR inside. A batch
of events joins on the bucket too: the buckets of the batch prune the partitions at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import REVIEW_ACTIONS
from ..plans.review import SCOPE

DIFF_SCHEMA = "repo string, pr_number int, commit_sha string, diff string, bucket int"


@dataclass(frozen=True)
class DiffStore:
    """A folder of diffs; ``buckets`` stays the same for the life of the folder."""

    path: str
    buckets: int = 1024

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("repo", "pr_number"), F.lit(self.buckets)).cast("int")

    def append(self, diffs: DataFrame) -> None:
        """Add diffs (repo, pr_number, commit_sha, diff); other columns are left out."""
        rows = diffs.select(*SCOPE, "diff", self.bucket().alias("bucket"))
        (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *SCOPE)
         .write.mode("append").partitionBy("bucket").parquet(self.path))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(DIFF_SCHEMA).parquet(self.path)

    def of(self, events: DataFrame) -> DataFrame:
        """The diffs of the events' revisions (``events``: accepted events with their action).

        The condition on the action holds for every accepted event; it tells Catalyst that
        the events are worth pruning the buckets by.
        """
        keys = events.filter(F.col("action").isin(*REVIEW_ACTIONS)).select(*SCOPE, self.bucket().alias("bucket"))
        return self.read(events.sparkSession).join(keys, ["bucket", *SCOPE], "left_semi").drop("bucket")


def diffs_of(diffs: DataFrame | DiffStore, events: DataFrame) -> DataFrame:
    """The diffs of the events' revisions, from a store or a plain table."""
    if isinstance(diffs, DiffStore):
        return diffs.of(events)
    return diffs.join(events.select(*SCOPE), SCOPE, "left_semi")
