"""Diff text -> positioned, classified lines.

All of it is per row: a diff is one value, and ``split`` + ``posexplode``
turn it into lines inside the task that read it, so nothing is shuffled.

Generators are always the ``_outer`` form followed by an explicit null
filter: for a plain ``explode`` the optimizer infers ``size(array) > 0`` and
pushes it below the projections, inlining the whole array expression —
lambdas included — into the scan filter, which recomputes it and can turn
linear per-row work quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SPLITLINES_REGEX, WORD_REGEX

DIFF_KEY = ["repo", "pr_number", "commit_sha"]


def split_lines(text: Column | str) -> Column:
    """Python ``str.splitlines()``: all its separators, no trailing empty line."""
    t = F.col(text) if isinstance(text, str) else text
    raw = F.split(t, SPLITLINES_REGEX, -1)
    return F.when(F.element_at(raw, -1) == F.lit(""),
                  F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)


def drop_trailing_empty(arr: Column) -> Column:
    """Lines of ``"\\n".join(arr)`` re-split: one trailing empty element is lost."""
    return F.when(F.try_element_at(arr, F.lit(-1)) == F.lit(""),
                  F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)


def word_count(text: Column | str) -> Column:
    """Python ``len(s.split())`` (Unicode whitespace)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(t, F.lit(WORD_REGEX)), F.lit(0)).cast("int")


def is_blank(text: Column | str) -> Column:
    """``not s.strip()`` with Python's whitespace set."""
    t = F.col(text) if isinstance(text, str) else text
    return ~F.coalesce(t.rlike(WORD_REGEX), F.lit(False))


LINE_KIND_SQL = """case
 when startswith({l}, 'diff --git') then 'diff_header'
 when startswith({l}, '+++ b/') then 'new_path'
 when startswith({l}, '+++') or startswith({l}, '---') then 'file_header'
 when startswith({l}, '@@') then 'hunk'
 when startswith({l}, '+') then 'add'
 when startswith({l}, '-') then 'del'
 else 'context' end"""


def line_kind(line: str = "line") -> Column:
    """Header / hunk / add / del / context, tested in the standalone parser's order."""
    return F.expr(LINE_KIND_SQL.format(l=line))


def diff_lines(diffs: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """One row per diff line with its 0-based position."""
    out = diffs.select(*keys, F.posexplode_outer(split_lines("diff")).alias("pos", "line"))
    return out.filter(F.col("pos").isNotNull())


def classified_lines(diffs: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """P3 over P2."""
    return diff_lines(diffs, keys).withColumn("kind", line_kind("line"))


def added_lines(lines: DataFrame) -> DataFrame:
    """lines the pipeline keeps (``+`` but not ``+++``), marker stripped."""
    return (lines.filter(F.col("kind") == "add")
            .withColumn("code", F.substring("line", 2, 1 << 30)))


def added_context_lines(lines: DataFrame) -> DataFrame:
    """F8: added and context lines (the standalone parser's view); context keeps its space."""
    return (lines.filter(F.col("kind").isin("add", "context"))
            .withColumn("code", F.when(F.col("kind") == "add", F.substring("line", 2, 1 << 30))
                        .otherwise(F.col("line"))))


def path_from_new_header(line: str = "line") -> Column:
    """``+++ b/<path>`` -> path (everything after the six-character prefix)."""
    return F.substring(F.col(line), 7, 1 << 30)


def path_from_git_header(line: str = "line") -> Column:
    """P5: token 3 of ``diff --git a/x b/x`` split on one space, ``b/`` removed.

    Null when the line has fewer than four tokens (the previous path stays).
    """
    tok = F.try_element_at(F.split(F.col(line), " ", -1), F.lit(4))
    return F.when(tok.startswith("b/"), F.substring(tok, 3, 1 << 30)).otherwise(tok)
