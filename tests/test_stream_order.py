"""Order across batches, the commit manifest and the diff store."""

import pytest
from pyspark.sql import functions as F
from test_stream import BAD, CLEAN, diffs, events

from reviewgrid.constants import DEFAULT_MARKER
from reviewgrid.session import work_path
from reviewgrid.sinks import commits, store
from reviewgrid.sinks.diff_store import DiffStore
from reviewgrid.sources.events import intake
from reviewgrid.sources.fixtures import FIXTURE_SECRET
from reviewgrid.streaming import review_stream as rs
from reviewgrid.streaming.pr_order import newest_events


def feed(spark, base, batches, horizon):
    """Run ``newest_events`` over the batches; the delivery ids that came through in each."""
    came, seen = [], set()
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{base}/events")
        new = newest_events(intake(rs.event_stream(spark, f"{base}/events"), FIXTURE_SECRET), horizon)
        rs._run(new.writeStream.format("parquet").option("path", f"{base}/sink").option("checkpointLocation", f"{base}/cp"))
        now = {r.delivery_id for r in spark.read.parquet(f"{base}/sink").collect()}
        came.append(now - seen)
        seen = now
    return came


def at(df, seconds):
    return df.withColumn("received_at", F.timestamp_seconds(F.lit(seconds)))


def test_late_and_repeated_events_review_nothing(spark):
    first = events(spark, [(1, "b", "opened"), (2, "x", "opened")], first=100)
    older = events(spark, [(1, "a", "opened")], first=50)
    again = at(events(spark, [(1, "b", "opened")], first=100), 500)  # redelivered: same id, later
    newer = events(spark, [(1, "c", "synchronize"), (1, "d", "synchronize")], first=200)
    came = feed(spark, work_path(spark, "t_order"), [first, older.union(again), newer], "1 hour")
    assert came == [{100, 101}, set(), {201}]


def test_state_may_go_when_the_watermark_has_passed(spark):
    hour = 3600
    a = events(spark, [(1, "a", "opened")], first=10)
    far = at(events(spark, [(2, "x", "opened")], first=20), 10 * hour)
    late = at(events(spark, [(1, "b", "opened")], first=30), 20)  # behind the horizon: not reviewed
    back = at(events(spark, [(1, "c", "opened")], first=40), 10 * hour)  # PR 1 rested, its state is gone
    came = feed(spark, work_path(spark, "t_expire"), [a, far, late, back], "1 hour")
    assert came == [{10}, {20}, set(), {40}]


def test_events_without_an_id_are_kept_apart(spark):
    none = events(spark, [(1, "a", "opened"), (2, "a", "opened")], first=10).withColumn("delivery_id", F.lit(None).cast("bigint"))
    base = work_path(spark, "t_noid")
    feed(spark, base, [none], "1 hour")
    got = {(r.pr_number, r.delivery_id, r.commit_sha) for r in spark.read.parquet(f"{base}/sink").collect()}
    assert got == {(1, None, "a"), (2, None, "a")}


def test_ordered_review_keeps_the_head(spark):
    base = work_path(spark, "t_ordered")
    table = diffs(spark, [(1, "old", BAD), (1, "new", CLEAN), (2, "x", BAD)])
    for batch in (events(spark, [(1, "new", "opened"), (2, "x", "opened")], first=100), events(spark, [(1, "old", "opened")])):
        batch.coalesce(1).write.mode("append").parquet(f"{base}/events")
        rs.start_ordered_review(spark, f"{base}/events", table, f"{base}/sink", f"{base}/cp", FIXTURE_SECRET, "1 hour")
    got = spark.read.parquet(f"{base}/sink/latest")
    assert {(r.pr_number, r.commit_sha) for r in got.collect()} == {(1, "new"), (2, "x")}
    reviews = store.read_reviews(spark, f"{base}/sink/reviews", commits=f"{base}/sink/commits")
    assert {r.pr_number for r in reviews.collect()} == {2}


def test_a_batch_without_its_manifest_is_invisible(spark, monkeypatch):
    base = work_path(spark, "t_commit")
    table = diffs(spark, [(1, "a", BAD), (1, "b", BAD + "\n+    exec(x)")])
    fn = rs.review_batch_fn(table, base, FIXTURE_SECRET)
    none = spark.createDataFrame([], store.COMMENTS_SCHEMA)

    def seen():
        reviews = store.read_reviews(spark, f"{base}/reviews", commits=f"{base}/commits")
        comments = store.current_comments(none, f"{base}/comments", DEFAULT_MARKER, f"{base}/commits")
        return (sorted(map(tuple, reviews.collect()), key=str), sorted(map(tuple, comments.collect()), key=str))

    fn(events(spark, [(1, "a", "opened")]), 0)
    before = seen()
    second = events(spark, [(1, "b", "synchronize")], first=10)
    with monkeypatch.context() as m:
        m.setattr(rs, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            fn(second, 1)
    assert seen() == before and before[0] and before[1]
    fn(second, 1)  # the replay
    after = seen()
    assert len(after[0]) > len(before[0]) and len(after[1]) == 1 and after[1] != before[1]
    fn(diffs_never_read(spark), 1)  # committed: not run again
    assert seen() == after
    assert commits.manifest(spark, f"{base}/commits").count() == 2


def diffs_never_read(spark):
    return events(spark, [(9, "z", "opened")], first=99)


def test_a_batch_reads_only_its_buckets(spark):
    table = spark.range(400).select(
        F.concat(F.lit("org/r"), F.col("id") % 3).alias("repo"), F.col("id").cast("int").alias("pr_number"),
        F.lit("s").alias("commit_sha"), F.lit(BAD).alias("diff"))
    kept = DiffStore(work_path(spark, "t_store"), buckets=32)
    kept.append(table)
    kept.append(table.limit(0))
    assert kept.read(spark).count() == 400
    path = work_path(spark, "t_store_events")
    spark.createDataFrame([("org/r1", 4, "s", "opened"), ("org/r2", 5, "s", "opened"), ("org/r2", 5, "other", "opened")],
                          "repo string, pr_number int, commit_sha string, action string").write.parquet(path)
    got = kept.of(spark.read.parquet(path))
    assert {(r.repo, r.pr_number, r.commit_sha) for r in got.collect()} == {("org/r1", 4, "s"), ("org/r2", 5, "s")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    scans = [line for line in plan.split("\n") if "dynamicpruning" in line and "Scan" in line]
    assert scans and all("bucket" in line for line in scans)


def test_empty_batches_leave_readable_tables(spark):
    base = work_path(spark, "t_empty")
    kept = DiffStore(f"{base}/diffs", buckets=4)
    kept.append(diffs(spark, [(1, "a", BAD)]))
    rs.review_batch_fn(kept, base, FIXTURE_SECRET)(events(spark, [(1, "a", "opened")]).limit(0), 0)
    assert spark.read.parquet(f"{base}/findings").count() == 0 and commits.is_committed(spark, f"{base}/commits", 0)
