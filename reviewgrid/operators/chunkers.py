"""Chunkers over section lines (C4-C10), all per row and shuffle-free.

Each section's lines are an array; boundary positions are found with
``filter(transform(...))`` and each chunk is a ``slice`` between two
boundaries. ``try_element_at(boundaries, k + 2)`` (the next boundary) is a
constant-time lookup, so a section costs time linear in its lines.

Line rules used instead of a parser (see README, "Re-aimed"):

* top-level (C6): a column-0 ``def``/``async def``/``class`` line whose
  previous non-blank line is not a decorator; its block runs over the
  following blank, comment, indented and column-0 ``)]}`` lines, trailing
  blank and comment lines cut.
* nested (C8): every ``def``/``class`` at any depth; its block ends before
  the first later significant line indented no deeper that does not start
  with a closing bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diff_lines import DIFF_KEY, is_blank, split_lines, word_count

# A significant line: has a non-space character and is not a column-0 comment.
_SIGNIFICANT = "(l rlike '(?U)[^\\\\s\\\\x1c-\\\\x1f]' and not startswith(l, '#'))"
_INDENTED = "(l rlike '^[ \\\\t\\\\f]')"
_CLOSER = "(l rlike '^[ \\\\t\\\\f]*[)\\\\]}]')"
_NAME = "regexp_extract({l}, '(?U)^[ \\\\t\\\\f]*(?:async\\\\s+)?(?:def|class)\\\\s+(\\\\w+)', 1)"


def _sub(expr: str, var: str) -> str:
    return expr.replace("l rlike", f"{var} rlike").replace("(l,", f"({var},").replace(
        "startswith(l,", f"startswith({var},")


# C4 + C5: boundaries at column-0 "def " / "class ". A non-last chunk ends
# one line before the next boundary (the line just before it is dropped).
_BOUNDARY_EXTENTS = """if(size(_b) = 0,
   array(named_struct('chunk_ord', 0, 'start_line', 1, 'end_line', size(src_lines), 'method', 'whole_file', 'head', '')),
   transform(_b, (s, k) -> named_struct('chunk_ord', k, 'start_line', s + 1,
     'end_line', coalesce(try_element_at(_b, k + 2) - 1, size(src_lines)), 'method', 'boundary', 'head', '')))"""


def _chunk_text() -> Column:
    """The text of extent ``c``: its lines, or the whole source."""
    return F.when(F.col("c.method") == "whole_file", F.col("source")).otherwise(F.expr(
        "array_join(slice(src_lines, c.start_line, greatest(c.end_line - c.start_line + 1, 0)), '\\n')"))


def boundary_chunks(sources: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """C4 and C5 on ``added_source`` rows (method ``boundary`` / ``whole_file``)."""
    b = F.expr("filter(transform(src_lines, (l, i) -> "
               "if(startswith(l, 'def ') or startswith(l, 'class '), i, -1)), i -> i >= 0)")
    out = sources.withColumn("_b", b).select(
        *keys, "file_ord", "file_path", "source", "src_lines", F.explode_outer(F.expr(_BOUNDARY_EXTENTS)).alias("c"))
    return out.filter(F.col("c").isNotNull()).select(
        *keys, "file_ord", "file_path", F.col("c.chunk_ord").alias("chunk_ord"), _chunk_text().alias("content"),
        F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), F.col("c.method").alias("method"))


# Positions in the significant-line array _n (1-based) of column-0 lines
# that are not closers; top-level openers are among them and each block
# ends at the significant line before the next one.
# A block whose previous such line opens a decorator (which may run over
# indented and closing lines) is left out.
_TOP_OPENERS = """
  filter(transform(_t, (p, m) -> named_struct('p', p, 'm', m)),
         x -> element_at(_n, x.p).l rlike '^(async\\\\s+def|def|class)\\\\s'
              and (x.m = 0 or not startswith(element_at(_n, element_at(_t, x.m)).l, '@')))"""
# Extents of C6 chunks: start and end line (1-based) and the opening line.
_TOP_EXTENTS = f"""transform({_TOP_OPENERS},
  (x, k) -> named_struct('chunk_ord', k, 'start_line', element_at(_n, x.p).i + 1,
    'end_line', element_at(_n, coalesce(try_element_at(_t, x.m + 2), size(_n) + 1) - 1).i + 1,
    'method', 'ast', 'head', element_at(_n, x.p).l))"""


def toplevel_chunks(sources: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """Top-level function/class chunks with exact block ends.

    Also returns the chunk-log columns: ``name``, ``chunk_type``,
    ``original_tokens`` (words of the section's added source),
    ``chunk_tokens`` and ``reduction_pct``.
    """
    n = F.expr(f"filter(transform(src_lines, (l, i) -> named_struct('i', i, 'l', l)), "
               f"x -> {_sub(_SIGNIFICANT, 'x.l')})")
    t = F.expr("filter(transform(_n, (x, p) -> if("
               f"not ({_sub(_INDENTED, 'x.l')} or {_sub(_CLOSER, 'x.l')}), p + 1, -1)), p -> p > 0)")
    df = sources.withColumn("_n", n).withColumn("_t", t)
    out = df.select(*keys, "file_ord", "file_path", "source", "src_lines",
                    F.explode_outer(F.expr(_TOP_EXTENTS)).alias("c"))
    out = out.filter(F.col("c").isNotNull()).select(
        *keys, "file_ord", "file_path", F.col("c.chunk_ord").alias("chunk_ord"),
        F.expr("array_join(slice(src_lines, c.start_line, c.end_line - c.start_line + 1), '\n')").alias("content"),
        F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), F.col("c.method").alias("method"),
        F.expr(_NAME.format(l="c.head")).alias("name"),
        F.when(F.col("c.head").startswith("class"), F.lit("class")).otherwise(F.lit("function"))
        .alias("chunk_type"),
        word_count("source").alias("original_tokens"))
    out = out.withColumn("name", F.when(F.col("name") == "", F.lit("unknown")).otherwise(F.col("name")))
    out = out.withColumn("chunk_tokens", word_count("content"))
    return out.withColumn("reduction_pct", F.bround(
        (F.lit(1.0) - F.col("chunk_tokens") / F.greatest(F.col("original_tokens"), F.lit(1))) * 100, 1))


CHUNK_COLS = ["file_ord", "chunk_ord", "file_path", "content", "start_line", "end_line", "method"]

def dispatch_chunks(sources: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """``.py`` sections -> top-level chunks (C6), others -> C4/C5.

    One pass: each section row picks its chunker with ``if`` and a single
    generator emits the chunks, so the sections are read once.
    """
    is_py = F.col("file_path").endswith(".py")
    empty_n = "filter(array(named_struct('i', 0, 'l', '')), x -> false)"
    n = F.when(is_py, F.expr(f"filter(transform(src_lines, (l, i) -> named_struct('i', i, 'l', l)), "
                             f"x -> {_sub(_SIGNIFICANT, 'x.l')})")).otherwise(F.expr(empty_n))
    t = F.expr("filter(transform(_n, (x, p) -> if("
               f"not ({_sub(_INDENTED, 'x.l')} or {_sub(_CLOSER, 'x.l')}), p + 1, -1)), p -> p > 0)")
    b = F.when(~is_py, F.expr("filter(transform(src_lines, (l, i) -> "
                              "if(startswith(l, 'def ') or startswith(l, 'class '), i, -1)), i -> i >= 0)")) \
        .otherwise(F.array().cast("array<int>"))
    df = sources.withColumn("_n", n).withColumn("_t", t).withColumn("_b", b)
    ext = F.when(is_py, F.expr(_TOP_EXTENTS)).otherwise(F.expr(_BOUNDARY_EXTENTS))
    out = df.select(*keys, "file_ord", "file_path", "source", "src_lines", F.explode_outer(ext).alias("c"))
    out = out.filter(F.col("c").isNotNull())
    content = _chunk_text()
    return out.select(*keys, "file_ord", F.col("c.chunk_ord").alias("chunk_ord"), "file_path",
                      content.alias("content"), F.col("c.start_line").alias("start_line"),
                      F.col("c.end_line").alias("end_line"), F.col("c.method").alias("method"))


# The standalone regex chunker. Blocks run from a match to the line
# before the next top-level match (or the end); no off-by-one.
_FUNC = "'(?U)^def\\\\s+(\\\\w+)\\\\s*\\\\('"
_CLASS = "'(?U)^class\\\\s+(\\\\w+)[\\\\s:(]'"
_NAMED_BLOCKS = f"""
transform(_m, (s, k) -> named_struct(
  'chunk_ord', k,
  'chunk_type', if(element_at(_l, s + 1) rlike {_FUNC}, 'function', 'class'),
  'name', if(element_at(_l, s + 1) rlike {_FUNC},
             regexp_extract(element_at(_l, s + 1), {_FUNC}, 1),
             regexp_extract(element_at(_l, s + 1), {_CLASS}, 1)),
  'code', array_join(slice(_l, s + 1, coalesce(try_element_at(_m, k + 2), size(_l)) - s), '\n'),
  'start_line', s + 1,
  'end_line', coalesce(try_element_at(_m, k + 2), size(_l))))
"""


def named_blocks(code: DataFrame, keys: list[str], code_col: str = "changed_code") -> DataFrame:
    """C7 on a text column: type, name and block of each top-level def/class."""
    df = code.withColumn("_l", split_lines(code_col))
    df = df.withColumn("_m", F.expr(
        f"filter(transform(_l, (l, i) -> if(l rlike {_FUNC} or l rlike {_CLASS}, i, -1)), i -> i >= 0)"))
    out = df.select(*keys, F.explode_outer(F.expr(_NAMED_BLOCKS)).alias("c"))
    return out.filter(F.col("c").isNotNull()).select(*keys, "c.*")


# For each indent level d that has an opener, the significant lines at
# indent <= d (not closers) form the terminator list of that level; an
# opener's block ends at the significant line before the next terminator.
# Cost is linear per distinct opener level.
_NESTED = """
sort_array(flatten(transform(
  array_distinct(transform(filter(_n, x -> x.l rlike '^[ \\\\t\\\\f]*(async\\\\s+def|def|class)\\\\s'), x -> x.ind)),
  d -> element_at(transform(
    array(filter(transform(_n, (x, p) -> if(x.ind <= d and not (x.l rlike '^[ \\\\t\\\\f]*[)\\\\]}]'), p + 1, -1)), p -> p > 0)),
    t -> transform(
      filter(transform(t, (p, m) -> named_struct('p', p, 'm', m)),
             y -> element_at(_n, y.p).ind = d
                  and element_at(_n, y.p).l rlike '^[ \\\\t\\\\f]*(async\\\\s+def|def|class)\\\\s'),
      y -> named_struct(
        'start', element_at(_n, y.p).i,
        'end', element_at(_n, coalesce(try_element_at(t, y.m + 2), size(_n) + 1) - 1).i,
        'head', element_at(_n, y.p).l))), 1))))
"""


def nested_blocks(sources: DataFrame, keys: list[str], lines_col: str = "src_lines") -> DataFrame:
    """Every definition at any depth with its extent, in start order."""
    n = F.expr(f"filter(transform({lines_col}, (l, i) -> named_struct('i', i, 'l', l, "
               f"'ind', length(regexp_extract(l, '^[ \\\\t\\\\f]*', 0)))), x -> {_sub(_SIGNIFICANT, 'x.l')})")
    df = sources.withColumn("_n", n)
    out = df.select(*keys, lines_col, F.posexplode_outer(F.expr(_NESTED)).alias("chunk_ord", "c"))
    return out.filter(F.col("c").isNotNull()).select(
        *keys, "chunk_ord",
        F.when(F.ltrim(F.col("c.head")).startswith("class"), F.lit("class")).otherwise(F.lit("function"))
        .alias("chunk_type"),
        F.expr(_NAME.format(l="c.head")).alias("name"),
        F.expr(f"array_join(slice({lines_col}, c.start + 1, c.end - c.start + 1), '\n')").alias("code"),
        (F.col("c.start") + 1).alias("start_line"), (F.col("c.end") + 1).alias("end_line"))


def standalone_b(sections_b_df: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """The standalone path: ``.py`` sections (F3) -> added+context code (F8)
    -> drop blank code (F4) -> regex named blocks (C7)."""
    from .sections import changed_code_b
    py = sections_b_df.filter(F.col("file_path").endswith(".py"))
    code = changed_code_b(py, keys).filter(~is_blank("changed_code"))
    return named_blocks(code, keys + ["file_ord", "file_path"])


def _ast_extents(batches):
    """Per section: top-level, undecorated def/class extents from Python's parser.

    Emits one row per chunk, or one row with ``parsed = False`` when the
    section does not parse (the caller falls back to the line rules).
    """
    import ast

    import pandas as pd
    cols = ["_sid", "parsed", "chunk_ord", "start_line", "end_line", "name", "chunk_type"]
    for pdf in batches:
        out = []
        for sid, source in zip(pdf["_sid"], pdf["source"]):
            try:
                tree = ast.parse(source)
            except (SyntaxError, ValueError):
                out.append((sid, False, None, None, None, None, None))
                continue
            k = 0
            for node in tree.body:
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) \
                        and not node.decorator_list:
                    kind = "class" if isinstance(node, ast.ClassDef) else "function"
                    out.append((sid, True, k, node.lineno, node.end_lineno, node.name, kind))
                    k += 1
        yield pd.DataFrame(out, columns=cols)


def ast_toplevel_chunks(sources: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """C6 with a real parser plugged in through ``mapInPandas``.

    Same output columns as ``toplevel_chunks`` (without the chunk-log
    columns). Only the section id and source cross into Python; the chunk
    text is cut back in the JVM. Sections Python cannot parse use the line
    rules.
    """
    from ..session import ship_package
    ship_package(sources.sparkSession)
    ids = sources.withColumn("_sid", F.xxhash64(*keys, "file_ord"))
    ext = ids.select("_sid", "source").mapInPandas(
        _ast_extents, "_sid long, parsed boolean, chunk_ord int, start_line int, end_line int, "
                      "name string, chunk_type string")
    good = ext.filter("parsed").drop("parsed")
    bad = ext.filter(~F.col("parsed")).select("_sid")
    parsed = ids.join(good, "_sid").select(
        *keys, "file_ord", "chunk_ord", "file_path",
        F.expr("array_join(slice(src_lines, start_line, end_line - start_line + 1), '\\n')").alias("content"),
        "start_line", "end_line", F.lit("ast").alias("method"))
    fallback = toplevel_chunks(ids.join(bad, "_sid").drop("_sid"), keys).select(*keys, *CHUNK_COLS)
    return parsed.unionByName(fallback)
