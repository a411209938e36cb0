"""Opt-in repairs: off by default, each with its own test."""

import datetime as dt

from conftest import diff_frame

from reviewgrid.operators.aggregates import severity_category_counts
from reviewgrid.plans.review import review
from reviewgrid.session import work_path
from reviewgrid.sinks import store


def test_module_level_secrets_only_when_asked(spark):
    diff = '+++ b/c.py\n+API_KEY = "abcdef123456"\n+def f():\n+    token = "zyxwvu987654"\n'
    d = diff_frame(spark, [diff])
    default = {(r.line_number, r.category) for r in review(d).filter("category = 'security'").collect()}
    repaired = {(r.line_number, r.category) for r in
                review(d, secrets_outside_chunks=True).filter("category = 'security'").collect()}
    assert default == {(3, "security")}
    assert repaired == {(1, "security"), (3, "security")}     # line 3 found twice, merged once


def test_latest_run_only_undoes_double_counting(spark):
    rows = [("org/r", 1, "high", "security", "a.py", 1, "d", None)]
    f = spark.createDataFrame(rows, "repo string, pr_number int, severity string, category string, "
                                    "file_path string, line_number int, description string, suggested_fix string")
    f = f.withColumn("seq", f.pr_number.cast("bigint"))
    path = work_path(spark, "reviews_repair")
    store.append_reviews(f, path, dt.datetime(2024, 1, 1), "run-1")
    store.append_reviews(f, path, dt.datetime(2024, 1, 2), "run-2")
    assert store.read_reviews(spark, path).count() == 2
    latest = store.read_reviews(spark, path, latest_run_only=True).collect()
    assert [r.run_id for r in latest] == ["run-2"]


def test_error_rows_excluded_only_when_asked(spark):
    rows = [("low", "style", 0, "Style agent error: bad json"), ("low", "style", 3, "long line")]
    f = spark.createDataFrame(rows, "severity string, category string, line_number int, description string")
    assert severity_category_counts(f).collect()[0]["count"] == 2
    assert severity_category_counts(f, exclude_errors=True).collect()[0]["count"] == 1
