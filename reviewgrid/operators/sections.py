"""File sections of a diff (C1, C2) and the added source per section.

Sections are cut inside each diff row: the header positions are found with
``filter(transform(lines, (l, i) -> ...))``, and each section is a
``slice`` of the line array between two headers, so the cost is linear in
the diff and no line ever leaves the task that read its diff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diff_lines import DIFF_KEY, drop_trailing_empty, split_lines

# Variant A: a section starts at each "+++ b/" line; repeats are kept.
_SECTIONS_A = """
transform(_hdr, (h, k) -> named_struct(
  'file_ord', k,
  'header_pos', h,
  'file_path', substring(element_at(_lines, h + 1), 7),
  'body', slice(_lines, h + 2, coalesce(try_element_at(_hdr, k + 2), size(_lines)) - h - 1)))
"""


def sections_a(diffs: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """One row per ``+++ b/`` header, with its body lines and added lines.

    Lines before the first header are dropped; ``+++ /dev/null`` is neither
    a header nor an added line.
    """
    lined = diffs.select(*keys, split_lines("diff").alias("_lines"))
    lined = lined.withColumn("_hdr", F.expr(
        "filter(transform(_lines, (l, i) -> if(startswith(l, '+++ b/'), i, -1)), i -> i >= 0)"))
    secs = lined.select(*keys, F.expr(_SECTIONS_A).alias("_s"))
    out = secs.select(*keys, F.explode_outer("_s").alias("s")).filter(F.col("s").isNotNull())
    out = out.select(*keys, "s.*")
    return out.withColumn("added", F.expr(
        "transform(filter(body, l -> startswith(l, '+') and not startswith(l, '+++')), l -> substring(l, 2))"))


def added_source(sections: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """Sections that are flushed (non-empty path, at least one added line).

    ``source`` is the added lines joined by newline; ``src_lines`` are the
    lines a chunker sees after re-splitting it (one trailing empty line lost).
    """
    kept = sections.filter((F.col("file_path") != "") & (F.size("added") > 0))
    return kept.select(*keys, "file_ord", "file_path",
                       F.array_join("added", "\n").alias("source"),
                       drop_trailing_empty(F.col("added")).alias("src_lines"))


def chunk_lines(sources: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """V_chunk_lines: 1-based line numbers of each section's added source."""
    return sources.select(*keys, "file_ord", "file_path",
                          F.posexplode_outer("src_lines").alias("line_no", "line")) \
        .filter(F.col("line_no").isNotNull()).withColumn("line_no", (F.col("line_no") + 1).cast("int"))


# Variant B: sections start at "diff --git" lines; a header with fewer than
# four space-separated tokens keeps the previous path.
_SECTIONS_B = """
transform(_hdr, (h, k) -> named_struct(
  'sec_ord', k,
  'raw_path', h.path,
  'body', slice(_lines, h.pos + 2, coalesce(try_element_at(_hdr, k + 2).pos, size(_lines)) - h.pos - 1)))
"""


def sections_b(diffs: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """``path -> text`` with dict semantics.

    Every ``diff --git`` line starts a section. Its path is token 3 without
    ``b/``; with fewer than four tokens the current path continues. A path
    seen again overwrites the text but keeps its first position
    (``file_ord``). Sections with no path yet are dropped.
    """
    lined = diffs.select(*keys, split_lines("diff").alias("_lines"))
    hdr = F.expr("""filter(transform(_lines, (l, i) -> if(startswith(l, 'diff --git'),
        named_struct('pos', i, 'path',
          case when startswith(try_element_at(split(l, ' ', -1), 4), 'b/')
               then substring(try_element_at(split(l, ' ', -1), 4), 3)
               else try_element_at(split(l, ' ', -1), 4) end),
        null)), x -> x is not null)""")
    lined = lined.withColumn("_hdr", hdr)
    secs = lined.select(*keys, F.expr(_SECTIONS_B).alias("_s"))
    # A header without a path inherits the nearest earlier header's path.
    # Only malformed headers pay for the backward search.
    secs = secs.withColumn("_s", F.expr("""transform(_s, s -> named_struct(
        'sec_ord', s.sec_ord,
        'file_path', coalesce(s.raw_path,
            try_element_at(filter(slice(_s, 1, s.sec_ord + 1), x -> x.raw_path is not null), -1).raw_path),
        'body', s.body))"""))
    # Dict semantics without a shuffle: distinct paths in first-seen order,
    # each with the text of its last section. A diff without repeated paths
    # (the usual case) passes through unchanged.
    secs = secs.withColumn("_s", F.expr("filter(_s, s -> s.file_path is not null)"))
    secs = secs.withColumn("_o", F.expr("sort_array(transform(_s, (s, k) -> named_struct('p', s.file_path, 'k', k)))"))
    # sorted by (path, place): a path's first and last sections are the ends of its run
    secs = secs.withColumn("_ends", F.expr("""sort_array(zip_with(
        filter(_o, (x, i) -> not (get(_o, i - 1).p <=> x.p)), filter(_o, (x, i) -> not (get(_o, i + 1).p <=> x.p)),
        (f, l) -> named_struct('first', f.k, 'last', l.k)))"""))
    secs = secs.withColumn("_s", F.expr("""transform(_ends, (e, k) -> named_struct(
        'file_ord', k, 'file_path', get(_s, e.last).file_path, 'body', get(_s, e.last).body))"""))
    out = secs.select(*keys, F.explode_outer("_s").alias("s")).filter(F.col("s").isNotNull())
    out = out.select(*keys, "s.*")
    return out.withColumn("text", F.array_join("body", "\n"))


def changed_code_b(sections: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """F8 on a B section: keep added (marker stripped) and context lines.

    ``+++``/``---``/``@@``/``-`` lines are skipped; everything else, including
    ``index`` lines and the context lines' leading space, is kept.
    """
    code = F.expr("""array_join(transform(filter(split_body, l ->
        not (startswith(l, '+++') or startswith(l, '---') or startswith(l, '@@') or
             (startswith(l, '-')))),
        l -> if(startswith(l, '+'), substring(l, 2), l)), '\n')""")
    return (sections.withColumn("split_body", drop_trailing_empty(F.col("body")))
            .withColumn("changed_code", code).drop("split_body"))
