"""Pull-request events (S1, F1, P1) and commits (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (IntegerType, LongType, StringType, StructField, StructType,
                               TimestampType)

from ..constants import PR_EVENT, REVIEW_ACTIONS
from ..functions.signature import signature_ok

# One delivered event.
EVENT_SCHEMA = StructType([
    StructField("delivery_id", LongType()),
    StructField("event", StringType()),
    StructField("payload", StringType()),
    StructField("received_at", TimestampType()),
    StructField("signature", StringType()),
])

# The payload fields the review needs, parsed with an explicit schema.
PAYLOAD_SCHEMA = StructType([
    StructField("action", StringType()),
    StructField("repository", StructType([StructField("full_name", StringType())])),
    StructField("pull_request", StructType([
        StructField("number", IntegerType()),
        StructField("head", StructType([StructField("sha", StringType())])),
    ])),
])


def event_fields(events: DataFrame) -> DataFrame:
    """Action, repo, PR number and head sha from the JSON payload."""
    p = F.from_json(F.col("payload"), PAYLOAD_SCHEMA)
    return events.withColumn("_p", p).select(
        "*", F.col("_p.action").alias("action"),
        F.col("_p.repository.full_name").alias("repo"),
        F.col("_p.pull_request.number").alias("pr_number"),
        F.col("_p.pull_request.head.sha").alias("commit_sha")).drop("_p")


def accepted(events: DataFrame) -> DataFrame:
    """pull-request events whose action starts a review (payload parsed first)."""
    return event_fields(events.filter(F.col("event") == F.lit(PR_EVENT))).filter(
        F.col("action").isin(*REVIEW_ACTIONS))


def verified(events: DataFrame, secret: str) -> DataFrame:
    """events whose signature matches the HMAC of the raw payload."""
    return events.filter(signature_ok(F.col("payload"), F.col("signature"), secret))


def intake(events: DataFrame, secret: str) -> DataFrame:
    """T1 body: verify (F2), keep review actions (F1), extract fields."""
    return accepted(verified(events, secret)).select(
        "delivery_id", "received_at", "action", "repo", "pr_number", "commit_sha")
