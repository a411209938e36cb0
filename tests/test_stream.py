"""The review stream (T2-T4) against the batch review, replays, re-reviews and failing PRs."""

import json

from pyspark.sql import functions as F

from reviewgrid.constants import DEFAULT_MARKER
from reviewgrid.functions.signature import signature_header
from reviewgrid.operators import report
from reviewgrid.plans.review import SCOPE, review
from reviewgrid.session import work_path
from reviewgrid.sinks import store
from reviewgrid.sources.events import EVENT_SCHEMA, intake
from reviewgrid.sources.fixtures import FIXTURE_SECRET, view
from reviewgrid.streaming import review_stream as rs

SF = "/root/testdata/sf0.001"
BAD = "+++ b/a.py\n+def f(x=[]):\n+    eval(x)"
CLEAN = "+++ b/a.py\n+def add_one(value: int) -> int:\n+    \"\"\"Sum.\"\"\"\n+    return value + 1"


def rows(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def events(spark, items, first=0):
    """(pr, sha, action) -> signed events."""
    made = [(first + k, "pull_request", json.dumps({
        "action": a, "repository": {"full_name": "org/r"}, "pull_request": {"number": p, "head": {"sha": s}}}))
        for k, (p, s, a) in enumerate(items)]
    df = spark.createDataFrame(made, "delivery_id bigint, event string, payload string")
    df = df.withColumn("received_at", F.timestamp_seconds(F.col("delivery_id"))).withColumn(
        "signature", signature_header(F.col("payload"), FIXTURE_SECRET))
    return df.select(*[f.name for f in EVENT_SCHEMA.fields])


def diffs(spark, items):
    return spark.createDataFrame([("org/r", p, s, d) for p, s, d in items],
                                 "repo string, pr_number int, commit_sha string, diff string")


def test_stream_equals_batch_and_replay_is_idempotent(spark):
    base = work_path(spark, "t_stream")
    ev = view(spark, SF, "v_pr_events")
    table = view(spark, SF, "v_diffs")
    fn = rs.review_batch_fn(table, f"{base}/sink", FIXTURE_SECRET)
    fn(ev, 0)
    tables = ("findings", "inline", "outcome", "reviews", "comments/posted", "comments/removed", "latest")
    read = lambda t: (lambda d: rows(d, sorted(d.columns)))(spark.read.parquet(f"{base}/sink/{t}"))
    once = {t: read(t) for t in tables}
    heads = rs.latest_per_pr(intake(ev, FIXTURE_SECRET)).select(*SCOPE)
    want = review(table.join(heads, SCOPE, "left_semi"))
    assert rows(spark.read.parquet(f"{base}/sink/findings"), want.columns) == rows(want, want.columns)
    assert once["findings"]
    fn(ev, 0)
    assert {t: read(t) for t in tables} == once


def test_only_the_head_revision_is_reviewed(spark):
    base = work_path(spark, "t_head")
    table = diffs(spark, [(1, "s1", BAD), (1, "s2", BAD)])
    rs.review_batch_fn(table, base, FIXTURE_SECRET)(events(spark, [(1, "s2", "opened")]), 0)
    assert {r.commit_sha for r in spark.read.parquet(f"{base}/findings").collect()} == {"s2"}


def test_two_rounds_leave_one_summary_and_a_clean_round_none_of_the_old(spark):
    base = work_path(spark, "t_rounds")
    table = diffs(spark, [(1, "a", BAD), (1, "b", BAD + "\n+    exec(x)"), (1, "c", CLEAN), (2, "a", BAD)])
    old = spark.createDataFrame([(1, 5, f"{DEFAULT_MARKER} old", "org/r"), (1, 6, "human", "org/r"), (2, 7, f"{DEFAULT_MARKER} other", "org/r")],
                                store.COMMENTS_SCHEMA)
    fn = rs.review_batch_fn(table, base, FIXTURE_SECRET)
    now = lambda: {(r.pr_number, r.comment_id): r.body for r in store.current_comments(old, f"{base}/comments", DEFAULT_MARKER).collect()}
    fn(events(spark, [(1, "a", "synchronize"), (2, "a", "opened")]), 0)
    first = now()
    assert (1, 5) not in first and (1, 6) in first and (2, 7) in first  # opened removes nothing
    assert sum(p == 1 and DEFAULT_MARKER in b for (p, _), b in first.items()) == 1
    fn(events(spark, [(1, "b", "synchronize")], first=10), 1)
    second = now()
    assert sum(p == 1 and DEFAULT_MARKER in b for (p, _), b in second.items()) == 1
    assert {k for k in second if k[0] == 2} == {k for k in first if k[0] == 2}
    fn(events(spark, [(1, "c", "synchronize")], first=20), 2)
    third = [b for (p, _), b in now().items() if p == 1 and DEFAULT_MARKER in b]
    assert len(third) == 1 and "Nothing to report" in third[0]
    assert all(k[1] is not None for k in now())


def test_a_failing_pr_is_an_error_row_and_the_others_finish(spark):
    base = work_path(spark, "t_fail")
    table = diffs(spark, [(p, "s", BAD) for p in range(6)])

    def broken(d):
        bad = F.when(F.col("pr_number") == 3, F.raise_error(F.lit("cannot review"))).otherwise(F.col("diff"))
        return review(d.withColumn("diff", bad))

    rs.review_batch_fn(table, base, FIXTURE_SECRET, broken)(events(spark, [(p, "s", "opened") for p in range(6)]), 0)
    assert [r.pr_number for r in spark.read.parquet(f"{base}/review_errors").collect()] == [3]
    assert {r.pr_number for r in spark.read.parquet(f"{base}/findings").collect()} == {0, 1, 2, 4, 5}


def test_reports_are_per_revision_by_scope(spark):
    found = review(diffs(spark, [(1, "a", BAD), (1, "b", BAD)]))
    md = report.summary_markdown(found, SCOPE).collect()
    assert len(md) == 2 and all(r.markdown.count("### 1. ") == 1 for r in md)


def test_replayed_run_is_stored_once(spark):
    path = work_path(spark, "t_reviews")
    found = review(diffs(spark, [(1, "a", BAD)])).withColumn("seq", F.col("position")).withColumn("repo", F.lit("007"))
    store.init_reviews(spark, path)
    for _ in range(2):
        store.append_reviews(found, path, rs.EPOCH, "r1")
    store.init_reviews(spark, path)
    got = store.read_reviews(spark, path)
    assert got.count() == found.count() and {r.repo for r in got.collect()} == {"007"}
