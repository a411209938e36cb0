"""The line-table form equals the array form, whatever the block size."""

import random

from conftest import diff_frame
from pyspark.sql import functions as F

from reviewgrid.operators import chunkers, diff_lines as dl, line_scan as ls, reviewers as rv, sections

KEYS = ["repo", "pr_number", "commit_sha"]
LINES = ["def f{}():", "async def g{}(a,", "class C{}:", "for x in y:", "while go(x): go(x)", "db.execute(q)", "print(x)", "print(x); print(x)", '"""doc"""',
         "def _h{}(", "):", ")", "]", "", "   ", "# note", "x = 1", "return f(x)", "# end:"]


def code_diffs(n=60, seed=5):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for f in range(rnd.randint(0, 3)):
            path = rnd.choice([f"a{f}.py", "same.py", "b.txt", ""])
            parts += [rnd.choice([f"diff --git a/{path} b/{path}", "diff --git broken", f"diff --git a/x b/{path} more"]), "index 1..2", f"--- a/{path}", f"+++ b/{path}", "@@ -1 +1 @@"]
            for _ in range(rnd.randint(0, 40)):
                body = rnd.choice(["", "    ", "    ", "        ", "\t", "            "]) + rnd.choice(LINES).format(rnd.randint(0, 9))
                parts.append(rnd.choice(["+", "+", "+", "+", " ", "-"]) + body)
            if rnd.random() < 0.3:
                parts.append("+")
        if rnd.random() < 0.3:
            parts.insert(0, "+stray")
        out.append("\n".join(parts))
    long = ["+def long_one():", *["+    " + ("    " * (k % 3)) + "for x in y:" for k in range(30)], "+y = 1"]
    return [*out, "\n".join(["diff --git a/l.py b/l.py", "+++ b/l.py", *long])]


def rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_equals_the_array_form(spark):
    df = diff_frame(spark, code_diffs()).cache()
    lines = dl.diff_lines(df)
    array = sections.sections_a(df)
    source = sections.added_source(array)
    cols = [*KEYS, "file_ord", "header_pos", "file_path", "n_body_lines", "n_added"]
    counts = rows(array.withColumn("n_body_lines", F.size("body")).withColumn("n_added", F.size("added")), cols)
    numbered = rows(sections.chunk_lines(source), [*ls.SECTION, "line_no", "line"])
    nested = rows(chunkers.nested_blocks(source, ls.SECTION), [*ls.SECTION, "chunk_ord", "chunk_type", "name", "start_line", "end_line"])
    hits = rows(rv.block_rule_hits(source, ls.SECTION), [*ls.SECTION, "line_no", "rule_id", "severity"])
    assert len(nested) > 100 and {h[-2] for h in hits} == {"R9", "R10", "R11", "R17", "R18"}
    for block in (1, 3, 4096):
        part = ls.section_lines(lines, block=block)
        assert rows(ls.section_counts(part), cols) == counts
        added = ls.added_lines(part, block=block).cache()
        assert rows(added, [*ls.SECTION, "line_no", "line"]) == numbered
        assert rows(ls.nested_blocks(added, block=block), [*ls.SECTION, "chunk_ord", "chunk_type", "name", "start_line", "end_line"]) == nested
        assert rows(ls.block_rule_hits(added, block=block), [*ls.SECTION, "line_no", "rule_id", "severity"]) == hits


def test_sections_b(spark):
    df = diff_frame(spark, code_diffs(seed=8))
    want = sections.sections_b(df).select(*KEYS, "file_ord", "file_path", F.posexplode("body").alias("k", "line"))
    want = rows(want, [*KEYS, "file_ord", "file_path", "k", "line"])
    for block in (2, 4096):
        got = ls.sections_b_lines(dl.diff_lines(df), block=block)
        by = {}
        for r in sorted(got.collect(), key=lambda r: r.pos):
            by.setdefault((r.repo, r.pr_number, r.commit_sha, r.file_ord, r.file_path), []).append(r.line)
        assert sorted([(*k, i, x) for k, v in by.items() for i, x in enumerate(v)], key=str) == want


def test_no_task_holds_the_giant_file(spark):
    n, block = 6000, 64
    body = ["class Top:"] + ["    " * (1 + k % 4) + ("for x in y:" if k % 5 else f"def f{k}():") for k in range(n)]
    giant = spark.createDataFrame([("org/r", 1, "s", 0, "g.py", i + 1, line) for i, line in enumerate(body)],
                                  "repo string, pr_number int, commit_sha string, file_ord int, file_path string, line_no int, line string")
    held = ls.significant(giant).groupBy(*ls.SECTION, F.floor(F.col("line_no") / block)).count()
    assert held.agg(F.max("count")).first()[0] <= block
    got = ls.nested_blocks(giant, block=block)
    assert got.filter("start_line = 1").first().end_line == n + 1
    source = giant.groupBy(*ls.SECTION).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x")).select(*ls.SECTION, F.col("x.line").alias("src_lines"))
    cols = [*ls.SECTION, "chunk_ord", "name", "start_line", "end_line"]
    assert rows(got, cols) == rows(chunkers.nested_blocks(source, ls.SECTION), cols)
