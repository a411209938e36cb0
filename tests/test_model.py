"""The model seam (A2): prompts reach the scorer, and each call is made once."""

import os
import uuid

from conftest import diff_frame

from reviewgrid.plans.review import chunk_diffs, review


def test_three_calls_per_chunk_and_the_prompt_is_sent(spark, tmp_path):
    diffs = diff_frame(spark, ["+++ b/a.py\n+def f(x):\n+    return x\n+def g(y):\n+    return y", "+++ b/b.txt\n+plain"])
    folder = str(tmp_path)

    def scorer(agent, path, prompt):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        if agent == "style":
            return "not json"
        return '[{"line_number": 1, "severity": "low", "description": "d"}]' if agent == "security" else "[]"

    found = review(diffs, scorer)
    findings = found.collect()
    found.count()
    chunks = chunk_diffs(diffs).count()
    calls = [open(os.path.join(folder, f)).read() for f in os.listdir(folder)]
    assert chunks == 3 and len(calls) == 3 * chunks
    assert all(c.startswith("File: ") and c.count("\n- ") == 3 and "```python" in c for c in calls)
    assert sum(r.agent == "security" for r in findings) >= 2 and any("Style agent error" in r.description for r in findings)
