"""Streaming intake and review.

* T1 ``start_intake``: files of webhook events -> verify (F2) -> keep review
  actions (F1) -> typed fields (P1) -> parquet sink (exactly-once file sink).
* T2 ``start_review``: ``foreachBatch``: the latest event of each PR -> the diff
  of its head sha -> ``review`` -> findings, the reviews table (K2), inline
  comments (K3) and the outcome's comment (K4, G8): the summary, or the
  no-issues body. Every table is written under the batch's own folder with
  overwrite, so a replayed batch replaces its own output; a row in the manifest
  (``sinks.commits``), written last, makes the batch visible as a whole. Diffs may
  lie in a ``DiffStore``, of which a batch reads only its PRs' buckets, and are cut
  into chunks once.
* T3 (inside T2): only the latest event per PR in a batch counts (an
  aggregation, ``max_by``, not a window); for ``synchronize`` the PR's earlier
  marked comments are removed (K5), also when the new review finds nothing.
  Comments are a log over batches (``store.current_comments``).
  ``start_ordered_review`` keeps that order across batches too (``pr_order``).
* T4: a failing item is a row in ``review_errors``, not an exception that stops
  the stream: a response that cannot be parsed (``start_quarantine``), and a PR
  whose review fails (the batch is halved until the failing PRs are alone; the
  others are reviewed).
"""

from __future__ import annotations

import datetime as dt
import inspect
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report, reviewers as rv
from ..plans.review import SCOPE, chunk_diffs, review
from ..sinks.commits import commit, init_manifest, is_committed
from ..sinks.diff_store import DiffStore, diffs_of
from ..sinks.store import append_reviews, post_comments
from ..sources.events import EVENT_SCHEMA, intake
from .pr_order import newest_events

EPOCH = dt.datetime(1970, 1, 1)


def _run(writer, available_now: bool = True):
    q = writer.trigger(availableNow=True).start() if available_now else writer.start()
    if available_now:
        q.awaitTermination()
    return q


def event_stream(spark: SparkSession, src_dir: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(src_dir)


def start_intake(spark: SparkSession, src_dir: str, sink_dir: str, checkpoint: str, secret: str,
                 available_now: bool = True):
    """T1."""
    accepted = intake(event_stream(spark, src_dir), secret)
    w = (accepted.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return _run(w, available_now)


def latest_per_pr(events: DataFrame) -> DataFrame:
    """The last accepted event of each PR in a batch (ties by delivery id)."""
    order = F.struct("received_at", "delivery_id")
    return events.groupBy("repo", "pr_number").agg(
        F.max_by(F.struct("delivery_id", "received_at", "action", "commit_sha"), order).alias("_l")).select(
        "repo", "pr_number", "_l.delivery_id", "_l.received_at", "_l.action", "_l.commit_sha")


PR = ["repo", "pr_number"]


def review_or_errors(diffs: DataFrame | DiffStore, events: DataFrame, work: str,
                     review_fn: Callable[..., DataFrame] = review) -> tuple[list[str], list[str], list[tuple]]:
    """Review the diffs of ``events``; (paths of findings, paths of chunks, (repo, pr_number, reason) of failing PRs).

    One job in the usual case. Only if it fails are the PRs halved by a hash, and so
    on until a failing PR is alone. A review function that takes ``chunk_table``
    leaves its chunks there; for others they are cut here.
    """
    paths: list[str] = []
    chunk_paths: list[str] = []
    errors: list[tuple] = []
    keeps_chunks = "chunk_table" in inspect.signature(review_fn).parameters
    todo: list[tuple[DataFrame, int, str]] = [(events, 0, "all")]
    while todo:
        part, depth, name = todo.pop()
        try:
            path, chunk_path = f"{work}/{name}", f"{work}-chunks/{name}"
            mine = diffs_of(diffs, part)
            found = review_fn(mine, chunk_table=chunk_path) if keeps_chunks else review_fn(mine)
            found.write.mode("overwrite").parquet(path)
            if not keeps_chunks:
                chunk_diffs(mine).select(*SCOPE).distinct().write.mode("overwrite").parquet(chunk_path)
            paths.append(path)
            chunk_paths.append(chunk_path)
        except PySparkException as e:
            rows = part.select(*PR).limit(2).collect()
            if len(rows) < 2:
                errors += [(r["repo"], r["pr_number"], str(e).split("\n")[0][:500]) for r in rows]
                continue
            half = F.pmod(F.xxhash64(*PR, F.lit(depth)), F.lit(2))
            todo += [(part.filter(half == k), depth + 1, f"{name}-{depth}{k}") for k in (0, 1)]
    return paths, chunk_paths, errors


def accepted_latest(secret: str) -> Callable[[DataFrame], DataFrame]:
    """A batch of raw events -> the accepted event of each PR that counts in it."""
    return lambda batch: latest_per_pr(intake(batch, secret))


def review_batch_fn(diffs: DataFrame | DiffStore, sink_dir: str, secret: str | None,
                    review_fn: Callable[..., DataFrame] = review) -> Callable[[DataFrame, int], None]:
    """T2/T3 body for ``foreachBatch``: a committed batch id is not run again.

    ``secret`` verifies raw events; without one the batch holds accepted events already,
    one of each PR at most.
    """
    select = accepted_latest(secret) if secret is not None else (lambda batch: batch)
    commits = f"{sink_dir}/commits"

    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at, run = f"batch_id={batch_id}", f"batch-{batch_id}"
        init_manifest(spark, commits)
        if is_committed(spark, commits, batch_id):
            return

        def stored(df: DataFrame, table: str) -> DataFrame:
            path = f"{sink_dir}/{table}/{at}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        events = stored(select(batch), "latest")
        paths, chunk_paths, errors = review_or_errors(diffs, events, f"{sink_dir}/work/{at}", review_fn)
        found = spark.read.parquet(*paths) if paths else review_fn(diffs_of(diffs, events.limit(0)))
        found = stored(found, "findings")
        failed = stored(spark.createDataFrame(errors, "repo string, pr_number int, reason string"), "review_errors")
        events = events.join(failed, PR, "left_anti")
        when = events.agg(F.max("received_at")).first()[0] or EPOCH
        append_reviews(found.withColumn("seq", F.col("position")), f"{sink_dir}/reviews", when, run)
        stored(report.inline_comments(found, F.col("commit_sha"), PR), "inline")
        chunked = (spark.read.parquet(*chunk_paths) if chunk_paths else events.limit(0)).select(*SCOPE).distinct()
        outcome = stored(report.pr_outcome(events, chunked, report.summary_markdown(found, SCOPE), SCOPE), "outcome")
        post_comments(outcome.filter(F.col("body").isNotNull()), events.filter(F.col("action") == "synchronize"),
                      f"{sink_dir}/comments", batch_id)
        commit(spark, commits, batch_id, run)

    return fn


def start_review(spark: SparkSession, src_dir: str, diffs: DataFrame | DiffStore, sink_dir: str, checkpoint: str,
                 secret: str, available_now: bool = True, review_fn: Callable[[DataFrame], DataFrame] = review):
    """T2 (+T3): review every PR that receives an accepted event."""
    w = (event_stream(spark, src_dir).writeStream
         .foreachBatch(review_batch_fn(diffs, sink_dir, secret, review_fn))
         .option("checkpointLocation", checkpoint))
    return _run(w, available_now)


def start_ordered_review(spark: SparkSession, src_dir: str, diffs: DataFrame | DiffStore, sink_dir: str,
                         checkpoint: str, secret: str, horizon: str = "7 days", available_now: bool = True,
                         review_fn: Callable[..., DataFrame] = review):
    """T2 + T3 with order kept across batches: a late older event or a redelivery reviews nothing."""
    new = newest_events(intake(event_stream(spark, src_dir), secret), horizon)
    w = (new.writeStream.foreachBatch(review_batch_fn(diffs, sink_dir, None, review_fn))
         .option("checkpointLocation", checkpoint))
    return _run(w, available_now)


RESPONSE_SCHEMA = "call_id bigint, file_path string, agent string, response string"


def start_quarantine(spark: SparkSession, src_dir: str, sink_dir: str, checkpoint: str,
                     available_now: bool = True):
    """T4: parse reviewer responses; failures become ``review_errors`` rows."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        parsed = rv.parse_responses(batch)
        rv.response_findings(parsed, ["call_id", "agent"]).write.mode("overwrite").parquet(
            f"{sink_dir}/findings/batch_id={batch_id}")
        errors = parsed.filter(F.col("status") == "error").select(
            "call_id", "agent", "file_path", F.lit("response is not a JSON array of findings").alias("reason"))
        errors.write.mode("overwrite").parquet(f"{sink_dir}/review_errors/batch_id={batch_id}")

    stream = spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", 1000).parquet(src_dir)
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return _run(w, available_now)
