"""Lexed top-level chunks against Python's parser; true line numbers against rebuilt files."""

import ast
import difflib
import random
import re
from pathlib import Path

import pytest
from conftest import diff_frame
from pyspark.sql import functions as F

from reviewgrid.operators import diff_lines as dl, hunks, lexer, line_scan as ls
from reviewgrid.session import ensure_checkpoint_dir

KEYS = ["repo", "pr_number", "commit_sha"]
PIECES = [
    ["def f{}(a,", "b):", '    """doc', "def not_code():", '"""', "    return a"], ['x{} = """', "text # no comment", "class NotCode:", '""" + "tail"'],
    ["class C{}:", "    y = (", "1,", ")", "    # trailing", "", "# column 0"], ["@dec", "def g{}(): pass"],
    ["z{} = 1 + \\", "2", "s = '''", "def no(): it\\'s", "'''"], ["async def h{}():", '    return "# no comment" # yes', ""],
    ["@dec(", "1", ")", "class D{}(", "object", "):", "    pass"], ["if z:", "    def inner{}():", "        return '''a", "", "b'''"],
    ["def k{}():", "    return {{", "'a': [1,", "2]", "}}", "    # end"], ["v{} = 'it\\'s' + \"'''\" + '\"\"\"'"], ["def q{}(): return r'''\\", "class X:", "'''"],
    ["class Page{}:", '    html = f"""', "<p>'''</p>", "def x(): '", '    """', "    n = 1"],
]


def sources(n=120, seed=3):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        text = "\n".join(line.format(k) for _ in range(rnd.randint(1, 12)) for line in rnd.choice(PIECES))
        ast.parse(text)
        out.append(text)
    return out


def by_parser(text):
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    return [(n.name, n.lineno, n.end_lineno) for n in ast.parse(text).body if isinstance(n, kinds) and not n.decorator_list]


def test_lexed_chunks_equal_the_parser(spark):
    texts = sources()
    rows = [(k, i + 1, line) for k, t in enumerate(texts) for i, line in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "f int, line_no int, line string").repartition(4)
    for block in (5, 4096):
        got = {}
        for r in lexer.toplevel_extents(lines, ["f"], block).orderBy("f", "chunk_ord").collect():
            got.setdefault(r.f, []).append((r.name, r.start_line, r.end_line))
        for k, t in enumerate(texts):
            assert got.get(k, []) == by_parser(t), t
    assert sum(len(v) for v in got.values()) > 200


def test_lines_of_any_length_are_lexed(spark):
    long = "word 'x' \" \\\\ y " * 10_000
    texts = [["def f():", '    """' + long, long, "def no(): pass", long + '"""', "    return a"], ["v = 'it" + "\\'s" * 20_000 + "'", "w = '''", long, "'''", "class A: pass"]]
    lines = spark.createDataFrame([(k, i + 1, x) for k, t in enumerate(texts) for i, x in enumerate(t)], "f int, line_no int, line string")
    got = {(r.f, r.name, r.start_line, r.end_line) for r in lexer.toplevel_extents(lines, ["f"]).collect()}
    assert got == {(0, "f", 1, 6), (1, "A", 5, 5)} == {(k, *d) for k, t in enumerate(texts) for d in by_parser("\n".join(t))}


def test_no_text_is_written_and_null_keys_meet(spark):
    """Tables of the lexer must not hold the lines again and again; what they hold goes when nothing reads it any more."""
    text = sources(60, seed=8)
    long = "\n".join("# " + "".join(random.Random(k).choice("abcdefgh") for _ in range(4000)) for k in range(60))
    texts = ["\n".join([t, long]) for t in text]
    rows = [(k or None, i + 1, line) for k, t in enumerate(texts) for i, line in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "f int, line_no int, line string").repartition(4)
    base = Path(ensure_checkpoint_dir(spark).removeprefix("file:"), "reviewgrid")
    before, most, discard = set(base.glob("*")), [], lexer.discard

    def size():
        return sum(f.stat().st_size for d in set(base.glob("*")) - before for f in d.rglob("*.parquet"))

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lexer, "discard", lambda *tables: (most.append(size()), discard(*tables)))
        got = {(r.f, r.name, r.start_line, r.end_line) for r in lexer.toplevel_extents(lines, ["f"], 50).collect()}
    assert got == {(k or None, *d) for k, t in enumerate(texts) for d in by_parser(t)}
    assert most and most[0] < sum(map(len, texts)) // 20
    assert {d.name.rpartition("-")[0] for d in set(base.glob("*")) - before} == {"lexed-heads"}


def test_lexed_lines_keep_what_is_asked(spark):
    text = ["x = (1,", "  \\", "2)", "s = '''", "(", "'''", "y = 1"]
    lines = spark.createDataFrame([(1, i + 1, line) for i, line in enumerate(text)], "f int, line_no int, line string")
    for block in (2, 4096):
        got = lexer.lexed(lines, ["f"], block).orderBy("line_no").collect()
        assert [(r.line, r.state, r.depth, r.continued) for r in got] == [
            ("x = (1,", 0, 0, False), ("  \\", 0, 1, False), ("2)", 0, 1, True), ("s = '''", 0, 0, False), ("(", 1, 0, False), ("'''", 1, 0, False), ("y = 1", 0, 0, False)]
    assert lexer.lexed(lines, ["f"], 2, {"size": F.length("line")}).columns == ["f", "line_no", "size", "state", "depth", "continued"]


def test_patterns_that_loop_find_what_the_plain_ones_find():
    rnd = random.Random(1)
    for _ in range(20_000):
        t = "".join(rnd.choice(['"', "'", "\\", "a", "#", '"""', "'''", "("]) for _ in range(rnd.randrange(14)))
        for plain, loops in [(lexer.TOKENS, lexer._J_TOKENS), *((lexer.CLOSE[k], lexer._J_CLOSE[k]) for k in (1, 2))]:
            assert [m.span() for m in re.finditer(plain, t)] == [m.span() for m in re.finditer(loops, t)], t
        for token in re.findall(lexer.TOKENS, t):
            assert bool(re.fullmatch(lexer._CLOSED, token)) == bool(re.fullmatch(lexer._J_CLOSED, token)), token


def file_pairs(n=40, seed=6):
    rnd = random.Random(seed)
    for _ in range(n):
        old = [rnd.choice(["a", "b", "++ c", "-- d", "", "e" * 3, "@@ x"]) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 60))]
        new = [x for x in old if rnd.random() > 0.15]
        for _ in range(rnd.randint(0, 6)):
            new.insert(rnd.randint(0, len(new)), f"new {rnd.randint(0, 99)}")
        yield old, new


def test_true_lines_rebuild_the_file(spark):
    diffs, files = [], []
    for k, (old, new) in enumerate(file_pairs()):
        body = list(difflib.unified_diff(old, new, f"a/f{k}.py", f"b/f{k}.py", lineterm="", n=k % 4))
        diffs.append("\n".join([f"diff --git a/f{k}.py b/f{k}.py", *body, "diff --git a/g.py b/g.py", "--- a/g.py", "+++ b/g.py", "@@ -1 +1 @@", "-x", "+y"]))
        files.append((old, new))
    lines = dl.diff_lines(diff_frame(spark, diffs))
    for block in (4, 4096):
        rows = hunks.hunk_lines(lines, block=block).collect()
        seen = set()
        for r in rows:
            old, new = files[r.pr_number]
            if r.line in ("-x", "+y") and (r.old_line or 1, r.new_line or 1) == (1, 1) and r.pos > len(diffs[r.pr_number].split("\n")) - 3:
                continue
            if r.new_line:
                assert new[r.new_line - 1] == r.line[1:]
            if r.old_line:
                assert old[r.old_line - 1] == r.line[1:]
            seen.add((r.pr_number, r.kind, r.line))
        want = {(k, {"+": "add", "-": "del"}[x[0]], x) for k, (old, new) in enumerate(files)
                for x in difflib.unified_diff(old, new, lineterm="", n=0) if x[0] in "+-" and x not in ("+++ ", "--- ")}
        assert want <= seen


def test_findings_get_their_file_line(spark):
    diff = "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -10,2 +20,3 @@\n a\n+b\n c\n@@ -30 +41,2 @@\n-x\n+y\n+z"
    lines = dl.diff_lines(diff_frame(spark, [diff]))
    positions = hunks.added_positions(lines)
    assert sorted((r.line_no, r.file_line) for r in positions.collect()) == [(1, 21), (2, 41), (3, 42)]
    found = ls.added_lines(ls.section_lines(lines)).filter("line = 'z'").withColumn("rule", F.lit("R"))
    assert [(r.rule, r.file_line) for r in hunks.with_file_line(found, positions).collect()] == [("R", 42)]
