"""True file line numbers from hunk headers (opt-in; the reference counts added lines, SURVEY note 2).

A hunk header ``@@ -a,b +c,d @@`` opens a hunk of ``b`` old and ``d`` new lines. Running counts of old and new
lines minus those at the last header give a line's place in its hunk; a line belongs to
it while either side is unfinished, so the headers of the next file are not mistaken for changes and a
changed line that begins ``++`` or ``--`` is. Counts and headers are segmented scans over the line
table, so a diff of any size is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .diff_lines import DIFF_KEY
from .line_scan import BLOCK, _joined, block_scan, section_lines

HEADER = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def hunk_lines(lines: DataFrame, keys: list[str] = DIFF_KEY, block: int = BLOCK) -> DataFrame:
    """Each line inside a hunk: ``keys, pos, line, kind`` (add, del, context), ``old_line``, ``new_line``."""
    first = F.substring("line", 1, 1)
    new, old = first.isin("+", " ", ""), first.isin("-", " ", "")
    counted = written(block_scan(lines.select(*keys, "pos", "line"), keys, "pos", {
        "_new": ("sum", new.cast("long")), "_old": ("sum", old.cast("long"))}, block), "hunk-counts")

    def group(i: int):
        return F.regexp_extract("line", HEADER, i)

    def length(i: int):
        return F.when(group(i) == "", 1).otherwise(group(i).cast("long"))

    header = F.when(F.col("line").rlike(HEADER), F.struct(
        group(1).cast("long").alias("a"), length(2).alias("b"), group(3).cast("long").alias("c"), length(4).alias("d"),
        F.col("_new").alias("new"), F.col("_old").alias("old")))
    # a new file's header closes the hunk before it, finished or not
    header = header.when(F.col("line").startswith("diff --git"), F.struct(
        *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "c", "d")], F.col("_new").alias("new"), F.col("_old").alias("old")))
    found = block_scan(counted, keys, "pos", {"_h": ("last", header)}, block).filter("_h is not null")
    n, o = F.col("_new") - F.col("_h.new"), F.col("_old") - F.col("_h.old")
    inside = (n - new.cast("long") < F.col("_h.d")) | (o - old.cast("long") < F.col("_h.b"))
    return found.filter((new | old) & inside).select(
        *keys, "pos", "line", F.when(new & old, "context").when(new, "add").otherwise("del").alias("kind"),
        F.when(old, F.col("_h.a") + o - 1).alias("old_line"), F.when(new, F.col("_h.c") + n - 1).alias("new_line"))


def added_positions(lines: DataFrame, keys: list[str] = DIFF_KEY, block: int = BLOCK) -> DataFrame:
    """``keys, file_ord, line_no, file_line``: the true line of each line of the added sources."""
    sections = section_lines(lines, keys, block)
    added = sections.filter(F.col("line").startswith("+") & ~F.col("line").startswith("+++"))
    numbered = block_scan(added.select(*keys, "file_ord", "pos"), [*keys, "file_ord"], "pos", {"line_no": ("sum", F.lit(1).cast("long"))}, block)
    true = hunk_lines(lines, keys, block).filter("kind = 'add'").select(*keys, "pos", F.col("new_line").alias("file_line"))
    return _joined(numbered, true, [*keys, "pos"]).select(*keys, "file_ord", F.col("line_no").cast("int").alias("line_no"), F.col("file_line").cast("int").alias("file_line"))


def with_file_line(findings: DataFrame, positions: DataFrame, keys: list[str] = DIFF_KEY, line: str = "line_no") -> DataFrame:
    """Findings on added sources with ``file_line``, null where the diff's hunks don't say (then the position stands alone)."""
    return _joined(findings, positions.withColumnRenamed("line_no", line), [*keys, "file_ord", line], "left")
