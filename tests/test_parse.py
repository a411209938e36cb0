"""Strict response parsing equals json.loads + item assignment."""

import json

from reviewgrid.operators import reviewers as rv

CASES = ["[]", "{}", '""', "", "   ", "null", "3", "true", '"x"', '{"a": 1}', "[1]", "[null]",
         "[] hello", "[] []", '[{"a": 1}] trailing', "```json\n[]\n```", "Sure: [1]",
         '[{"line_number": 3, "severity": "high"}]', '[{"line_number": "3"}, {"severity": null}]',
         '[{}, {"category": "style"}]', '[{"a": 1}, null]', '[{"a": 1}, [2]]', '  [ {"x": 1} ]  ',
         '{"a": 1} {"b": 2}', "[[]]", '["s"]', "[{]", "nope"]


def python_status(text):
    try:
        v = json.loads(text)
    except Exception:  # noqa: BLE001
        return "error", 0
    try:
        n = 0
        for f in v:
            f["file_path"] = "p"
            n += 1
    except Exception:  # noqa: BLE001
        return "error", 0
    return ("rows", n) if n else ("none", 0)


def test_strict_parsing_matches_python(spark):
    df = spark.createDataFrame([(i, "p.py", "security", t) for i, t in enumerate(CASES)],
                               "call_id bigint, file_path string, agent string, response string")
    parsed = rv.parse_responses(df)
    rows = rv.response_findings(parsed, ["call_id"]).groupBy("call_id").count().collect()
    counts = {r.call_id: r["count"] for r in rows}
    status = {r.call_id: r.status for r in parsed.select("call_id", "status").collect()}
    for i, t in enumerate(CASES):
        want, n = python_status(t)
        got = "rows" if status[i] == "rows" else status[i]
        assert (got, counts.get(i, 0)) == (want, n), t


def test_error_finding_shape(spark):
    df = spark.createDataFrame([(1, "a.py", "performance", "not json")],
                               "call_id bigint, file_path string, agent string, response string")
    e = rv.error_findings(rv.parse_responses(df), ["call_id"]).collect()[0]
    assert (e.category, e.severity, e.line_number, e.file_path, e.suggested_fix) == \
        ("performance", "low", 0, "a.py", "")
    assert e.description.startswith("Performance agent error: ")


def test_model_seam_retries_rate_limits(spark):
    calls = {"n": 0}

    def flaky(agent, path, content):
        calls["n"] += 1
        if calls["n"] < 3:
            raise RuntimeError("rate_limit exceeded")
        return "[]"

    assert rv.call_with_retry(flaky, "style", "a.py", "x", attempts=3, backoff=0.0) == ("[]", None)
    resp, err = rv.call_with_retry(lambda *a: (_ for _ in ()).throw(ValueError("boom")), "style", "a", "x",
                                   backoff=0.0)
    assert resp is None and err == "boom"
