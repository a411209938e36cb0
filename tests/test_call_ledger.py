"""The call ledger (A2): equal calls once, answered calls never again, a crash costs one slice."""

import os
import uuid

import pytest
from conftest import diff_frame

from reviewgrid.operators.call_ledger import ledger_calls, read_ledger
from reviewgrid.plans.review import review
from reviewgrid.session import work_path


def tasks(spark, n, agent="style"):
    return spark.createDataFrame([(i, agent, f"f{i}.py", f"prompt {i}") for i in range(n)],
                                 "id int, agent string, file_path string, prompt string")


def counting(folder, then=lambda prompt: "[]"):
    def scorer(agent, path, prompt):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{agent}|{path}|{prompt}")
        return then(prompt)
    return scorer


def made(folder):
    return [open(os.path.join(folder, f)).read() for f in os.listdir(folder)]


def test_each_call_is_made_once_over_runs(spark, tmp_path):
    path, folder = work_path(spark, "t_ledger"), str(tmp_path)
    ledger_calls(tasks(spark, 30), counting(folder), path, "a", slice_rows=7)
    assert len(made(folder)) == 30
    again = tasks(spark, 50).union(tasks(spark, 50))
    got = ledger_calls(again, counting(folder), path, "b", slice_rows=7)
    assert got.columns == again.columns + ["response", "error"]
    assert [r.response for r in got.collect()] == ["[]"] * 100
    assert len(made(folder)) == 50 and len(set(made(folder))) == 50
    assert ledger_calls(tasks(spark, 0), counting(folder), path, "c").count() == 0


def test_a_crash_costs_the_open_slice_only(spark, tmp_path):
    path, folder = work_path(spark, "t_crash"), str(tmp_path / "calls")
    os.makedirs(folder)
    flag = str(tmp_path / "crashed")

    def crash_once(prompt):
        if len(os.listdir(folder)) > 25 and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        return "[]"

    with pytest.raises(Exception):
        ledger_calls(tasks(spark, 60), counting(folder, crash_once), path, "a", slice_rows=10, concurrency=2).collect()
    kept = read_ledger(spark, path).count()
    first = len(made(folder))
    got = ledger_calls(tasks(spark, 60), counting(folder, crash_once), path, "a", slice_rows=10, concurrency=2)
    assert got.filter("response = '[]'").count() == 60
    assert kept > 0 and len(made(folder)) == first + 60 - kept
    repeated = len(made(folder)) - len(set(made(folder)))
    assert repeated == first - kept <= 20  # one slice: about slice_rows calls, dealt by hash


def test_failed_calls_are_made_again_by_the_next_run(spark, tmp_path):
    path, folder = work_path(spark, "t_failed"), str(tmp_path)

    def broken(prompt):
        raise ValueError("no model")

    bad = ledger_calls(tasks(spark, 3), counting(folder, broken), path, "a")
    assert [(r.response, r.error) for r in bad.collect()] == [(None, "no model")] * 3
    good = ledger_calls(tasks(spark, 3), counting(folder), path, "b")
    assert [(r.response, r.error) for r in good.collect()] == [("[]", None)] * 3
    assert len(made(folder)) == 6


def test_nulls_and_parts_are_told_apart(spark, tmp_path):
    path, folder = work_path(spark, "t_nulls"), str(tmp_path)
    odd = spark.createDataFrame([("a", "b", "c"), ("ab", "", "c"), ("a", None, "c"), ("a", "", "c")],
                                "agent string, file_path string, prompt string")
    assert ledger_calls(odd, counting(folder), path, "a").filter("response = '[]'").count() == 4
    assert len(made(folder)) == 4


def test_a_review_over_a_ledger_calls_once(spark, tmp_path):
    path, folder = work_path(spark, "t_review_ledger"), str(tmp_path)
    diffs = diff_frame(spark, ["+++ b/a.py\n+def f(x):\n+    return x"])
    finding = '[{"line_number": 1, "severity": "low", "description": "d"}]'
    runs = [review(diffs, counting(folder, lambda p: finding), ledger=(path, r)).collect() for r in ("a", "b")]
    assert runs[0] == runs[1] and runs[0] and len(made(folder)) == 3


def test_the_number_of_jobs_does_not_grow_with_the_calls(spark, tmp_path):
    sc, jobs = spark.sparkContext, []
    for n in (4, 60):
        path, folder = work_path(spark, "t_jobs"), str(tmp_path / str(n))
        os.makedirs(folder)
        sc.setJobGroup(f"ledger-{n}", "")
        got = ledger_calls(tasks(spark, n), counting(folder), path, "a", slice_rows=4)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"ledger-{n}")))
        assert got.filter("response = '[]'").count() == n == len(made(folder)) == len(set(made(folder)))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2  # fifteen slices, or one


def test_finished_tasks_outlive_the_job(spark, tmp_path):
    path, folder = work_path(spark, "t_outlive"), str(tmp_path / "calls")
    os.makedirs(folder)
    flag = str(tmp_path / "crashed")

    def crash_once(prompt):
        if len(os.listdir(folder)) > 40 and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        return "[]"

    with pytest.raises(Exception):
        ledger_calls(tasks(spark, 80), counting(folder, crash_once), path, "a", slice_rows=10).collect()
    kept, first = read_ledger(spark, path).count(), len(made(folder))
    got = ledger_calls(tasks(spark, 80), counting(folder, crash_once), path, "a", slice_rows=10)
    assert got.filter("response = '[]'").count() == 80
    assert kept > 0 and len(made(folder)) == first + 80 - kept and first - kept <= 30  # the open tasks, four at a time
