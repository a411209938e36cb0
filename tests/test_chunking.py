"""Chunking semantics on hand-written diffs."""

from conftest import diff_frame

from reviewgrid.operators import chunkers, sections

K = ["repo", "pr_number", "commit_sha"]


def chunks_of(spark, diff):
    src = sections.added_source(sections.sections_a(diff_frame(spark, [diff])))
    rows = chunkers.dispatch_chunks(src).orderBy("file_ord", "chunk_ord").collect()
    return [(r.file_path, r.content, r.start_line, r.end_line, r.method) for r in rows]


def test_preamble_dropped_and_dev_null_not_a_header(spark):
    diff = "+stray\n+++ b/a.txt\n+one\n+++ /dev/null\n+two\n"
    assert chunks_of(spark, diff) == [("a.txt", "one\ntwo", 1, 2, "whole_file")]


def test_double_plus_line_loses_first_char_only(spark):
    diff = "+++ b/a.txt\n++x\n"
    # "++x" is not "+++", so it is added with one "+" stripped
    assert chunks_of(spark, diff) == [("a.txt", "+x", 1, 1, "whole_file")]


def test_boundary_chunks_drop_line_before_next_boundary(spark):
    diff = "+++ b/m.txt\n+pre\n+def a():\n+  x\n+  y\n+class B:\n+  z\n"
    assert chunks_of(spark, diff) == [
        ("m.txt", "def a():\n  x", 2, 3, "boundary"),   # end = next boundary index - 1
        ("m.txt", "class B:\n  z", 5, 6, "boundary"),
    ]


def test_adjacent_boundaries_give_empty_content(spark):
    diff = "+++ b/m.txt\n+def a(): pass\n+def b(): pass\n"
    assert chunks_of(spark, diff) == [
        ("m.txt", "", 1, 0, "boundary"),
        ("m.txt", "def b(): pass", 2, 2, "boundary"),
    ]


def test_repeated_path_kept_in_variant_a(spark):
    diff = "+++ b/x.md\n+a\n+++ b/x.md\n+b\n"
    assert [c[1] for c in chunks_of(spark, diff)] == ["a", "b"]


def test_whole_file_keeps_trailing_empty_line_in_content(spark):
    diff = "+++ b/n.txt\n+a\n+\n"
    # source "a\n" re-splits to one line; content is the source itself
    assert chunks_of(spark, diff) == [("n.txt", "a\n", 1, 1, "whole_file")]


def test_toplevel_skips_decorated_and_module_code(spark):
    diff = ("+++ b/p.py\n+X = 1\n+@dec\n+def hidden():\n+    pass\n+\n"
            "+def shown(a,\n+          b):\n+    return a\n+\n+\n+class K:\n+    def m(self):\n+        pass\n+Y = 2\n")
    got = chunks_of(spark, diff)
    assert got == [
        ("p.py", "def shown(a,\n          b):\n    return a", 6, 8, "ast"),
        ("p.py", "class K:\n    def m(self):\n        pass", 11, 13, "ast"),
    ]


def test_exotic_line_separators_split_like_splitlines(spark):
    diff = "+++ b/s.txt\r\n+a\x0b+b\u2028+c"
    assert chunks_of(spark, diff) == [("s.txt", "a\nb\nc", 1, 3, "whole_file")]


def test_variant_b_sections_and_named_blocks(spark):
    diff = ("diff --git a/x y.py b/x y.py\n+def f():\n+  pass\n"
            "diff --git a/q.py b/q.py\n+class A:\n"
            "diff --git a/q.py b/q.py\n+class C(Base):\n+    x = 1\n \n+class D\n")
    secs = sections.sections_b(diff_frame(spark, [diff]))
    got = [(r.file_ord, r.file_path) for r in secs.orderBy("file_ord").collect()]
    # token 3 of a header whose path has a space is the tail of the a/ path;
    # a repeated path keeps its first position and the last text
    assert got == [(0, "y.py"), (1, "q.py")]
    blocks = chunkers.standalone_b(secs).orderBy("file_ord", "chunk_ord").collect()
    assert [(b.file_path, b.chunk_type, b.name, b.start_line, b.end_line) for b in blocks] == [
        ("y.py", "function", "f", 1, 2),
        ("q.py", "class", "C", 1, 4),
    ]
    # the context line keeps its space; "class D" (no colon) is not a boundary
    assert blocks[1].code == "class C(Base):\n    x = 1\n \nclass D"


def test_nested_blocks_extents(spark):
    src = ["class A:", "    def m(self,", "    ):", "        return 1", "", "    x = 2", "def f():", "    pass"]
    df = spark.createDataFrame([("r", 1, "s", 0, src)],
                               "repo string, pr_number int, commit_sha string, file_ord int, src_lines array<string>")
    got = [(r.chunk_type, r.name, r.start_line, r.end_line)
           for r in chunkers.nested_blocks(df, K + ["file_ord"]).orderBy("chunk_ord").collect()]
    assert got == [("class", "A", 1, 6), ("function", "m", 2, 4), ("function", "f", 7, 8)]


def test_python_parser_hook_agrees_with_line_rules_on_valid_code(spark):
    code = ["import os", "X = 1", "@dec", "def hidden():", "    pass", "", "def shown(a,", "          b):",
            "    return a", "", "", "class K:", "    def m(self):", "        '''doc", "def not_top():", "'''",
            "        pass", "async def run():", "    await x", "Y = 2"]
    diff = "+++ b/p.py\n" + "".join("+" + c + "\n" for c in code) + "+++ b/bad.py\n+def broken(:\n+  pass\n"
    src = sections.added_source(sections.sections_a(diff_frame(spark, [diff])))
    rules = {(r.file_path, r.start_line, r.end_line, r.content)
             for r in chunkers.toplevel_chunks(src).collect()}
    ast_rows = {(r.file_path, r.start_line, r.end_line, r.content)
                for r in chunkers.ast_toplevel_chunks(src).collect()}
    # column-0 text inside a triple-quoted string is where line rules and a parser differ
    assert ("p.py", 12, 17, "\n".join(code[11:17])) in ast_rows
    assert ("p.py", 12, 14, "\n".join(code[11:14])) in rules
    same = {r for r in ast_rows if r[1] != 12}
    assert same == {r for r in rules if r[1] not in (12, 15)}
    assert ("bad.py", 1, 2, "def broken(:\n  pass") in ast_rows      # does not parse: line-rule fallback
