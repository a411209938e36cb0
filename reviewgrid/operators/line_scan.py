"""C1-C3, C8 and A6 over a line table, for files and diffs too large for one row.

``lines`` has one row per diff line (keys, ``pos``, ``line``; positions are distinct and need not be
dense). Running values come from a segmented scan: a window inside each block of ``block``
positions, a summary row per block, a window over the summaries, and a join that hands each
block what the others carry to it. A block is bounded, so no task holds a file; a
file or diff of one block has no carry and takes no part in the join.

Block ends (C8) need the next line indented no deeper. Inside a block an array expression finds
it. Definitions still open at a block's end form a stack of strictly increasing indents; they
meet the lines of later blocks that are indented less than all before them in their block. For
each indent level the next such line is one more scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import reviewers as rv
from .diff_lines import DIFF_KEY

BLOCK = 4096
SECTION = [*DIFF_KEY, "file_ord", "file_path"]
_DEFINITION = r"^[ \t\f]*(async\s+def|def|class)\s"
_CLOSER = r"^[ \t\f]*[)\]}]"


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null, each kept once."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(other, cond, how).drop(*[f"_r_{c}" for c in on])


def block_scan(rows: DataFrame, group: list[str], pos: str, scans: dict[str, tuple[str, Column]], block: int = BLOCK) -> DataFrame:
    """Add running values per group in the order of ``pos``. Kinds of scan:

    ``sum``   the sum up to and with the row
    ``last``  the last value that is not null, up to and with the row
    ``next``  the first value that is not null, after the row
    ``least`` the least value after the row
    """
    src = rows.withColumn("_b", F.floor(F.col(pos) / block)).withColumns({f"_v_{n}": c for n, (_, c) in scans.items()})
    here = Window.partitionBy(*group, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy(*group, "_b").orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    local, total, carry, out = {}, [], {}, {}
    for n, (kind, _) in scans.items():
        v, t = F.col(f"_v_{n}"), f"_t_{n}"
        inner, block_value, outer, joined = {
            "sum": (F.sum(v).over(here), F.sum(v), F.sum(t).over(before), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
            "last": (F.last(v, True).over(here), F.max_by(v, F.when(v.isNotNull(), F.col(pos))), F.last(t, True).over(before), F.coalesce),
            "next": (F.last(v, True).over(beyond), F.min_by(v, F.when(v.isNotNull(), F.col(pos))), F.last(t, True).over(after), F.coalesce),
            "least": (F.min(v).over(beyond), F.min(v), F.min(t).over(after), F.least),
        }[kind]
        local[f"_l_{n}"], carry[f"_c_{n}"] = inner, outer
        total.append(block_value.alias(t))
        out[n] = joined(F.col(f"_l_{n}"), F.col(f"_c_{n}"))
    summary = src.groupBy(*group, "_b").agg(*total)
    carries = summary.select(*group, "_b", *[c.alias(n) for n, c in carry.items()]).filter(
        reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in carry]))
    both = _joined(src.withColumns(local), carries, [*group, "_b"], "left")
    return both.select(*rows.columns, *[c.alias(n) for n, c in out.items()])


def section_lines(lines: DataFrame, keys: list[str] = DIFF_KEY, block: int = BLOCK) -> DataFrame:
    """Each line after the first ``+++ b/`` header of its diff, with the section it lies in
    (``file_ord``, ``header_pos``, ``file_path``); headers themselves have ``is_header``."""
    header = F.col("line").startswith("+++ b/")
    scanned = block_scan(lines.select(*keys, "pos", "line"), keys, "pos", {
        "_n": ("sum", header.cast("long")),
        "_h": ("last", F.when(header, F.struct(F.col("pos").alias("pos"), F.substring("line", 7, 1 << 30).alias("path"))))}, block)
    return written(scanned.filter("_n > 0").select(
        *keys, "pos", "line", (F.col("_n") - 1).cast("int").alias("file_ord"), F.col("_h.pos").alias("header_pos"),
        F.col("_h.path").alias("file_path"), (F.col("pos") == F.col("_h.pos")).alias("is_header")), "section-lines")


def section_counts(sections: DataFrame, keys: list[str] = DIFF_KEY) -> DataFrame:
    """C1's summary: body and added lines of every section."""
    return sections.groupBy(*keys, "file_ord", "header_pos", "file_path").agg(
        (F.count(F.lit(1)) - 1).cast("int").alias("n_body_lines"), F.sum(_added().cast("int")).cast("int").alias("n_added"))


def _added() -> Column:
    return F.col("line").startswith("+") & ~F.col("line").startswith("+++")


def added_lines(sections: DataFrame, keys: list[str] = DIFF_KEY, block: int = BLOCK) -> DataFrame:
    """The added source of every section line by line, numbered from 1; a last line that is empty goes."""
    section = [*keys, "file_ord", "file_path"]
    adds = sections.filter(_added() & (F.col("file_path") != "")).select(*section, "pos", F.substring("line", 2, 1 << 30).alias("line"))
    numbered = block_scan(adds, section, "pos", {"line_no": ("sum", F.lit(1).cast("long")), "_more": ("next", F.lit(True))}, block)
    return written(numbered.filter(F.col("_more").isNotNull() | (F.col("line") != "")).select(
        *section, F.col("line_no").cast("int").alias("line_no"), "line"), "added-lines")


def sections_b_lines(lines: DataFrame, keys: list[str] = DIFF_KEY, block: int = BLOCK) -> DataFrame:
    """Body lines of the sections by ``diff --git``: of a path seen again the last text, at its first place."""
    header = F.col("line").startswith("diff --git")
    token = F.try_element_at(F.split("line", " ", -1), F.lit(4))
    path = F.when(token.startswith("b/"), F.substring(token, 3, 1 << 30)).otherwise(token)
    scanned = block_scan(lines.select(*keys, "pos", "line"), keys, "pos", {
        "_sec": ("sum", header.cast("long")), "_path": ("last", F.when(header, path))}, block)
    body = scanned.filter(~header & F.col("_path").isNotNull())
    heads = scanned.filter(header & F.col("_path").isNotNull()).groupBy(*keys, "_path").agg(F.min("_sec").alias("_first"), F.max("_sec").alias("_last"))
    ordered = block_scan(heads, keys, "_first", {"_ord": ("sum", F.lit(1).cast("long"))}, block)
    kept = ordered.select(*keys, "_path", F.col("_last").alias("_sec"), (F.col("_ord") - 1).cast("int").alias("file_ord"))
    return body.join(kept, [*keys, "_path", "_sec"]).select(*keys, "file_ord", F.col("_path").alias("file_path"), "pos", "line")


def _indent(line: str = "line") -> Column:
    return F.length(F.regexp_extract(line, r"^[ \t\f]*", 0))


def significant(lines: DataFrame) -> DataFrame:
    """Lines with a character that is no space, column-0 comments aside, with ``ind`` and ``closer``."""
    kept = lines.filter(F.col("line").rlike(r"(?U)[^\s\x1c-\x1f]") & ~F.col("line").startswith("#"))
    return kept.withColumn("ind", _indent()).withColumn("closer", F.col("line").rlike(_CLOSER))


# Per block: openers with the end of their block, null where it lies in a later block.
_IN_BLOCK = """flatten(transform(array_distinct(transform(filter(_n, x -> x.opener), x -> x.ind)),
  d -> element_at(transform(
    array(filter(transform(_n, (x, p) -> if(x.ind <= d and not x.closer, p + 1, -1)), p -> p > 0)),
    t -> transform(
      filter(transform(t, (p, m) -> named_struct('p', p, 'm', m)), y -> element_at(_n, y.p).ind = d and element_at(_n, y.p).opener),
      y -> named_struct('start_line', element_at(_n, y.p).line_no, 'ind', d,
        'end_line', element_at(_n, try_element_at(t, y.m + 2) - 1).line_no))), 1)))"""


def extents(lines: DataFrame, opener: str, group: list[str] = SECTION, block: int = BLOCK) -> DataFrame:
    """C8's search: ``group, start_line, end_line`` of the block of every line that matches ``opener``.
    ``lines`` needs ``group``, line_no and line."""
    sig = significant(lines.select(*group, "line_no", "line")).withColumn("opener", F.col("line").rlike(opener)).drop("line")
    sig = sig.withColumn("_b", F.floor(F.col("line_no") / block))
    entry = F.struct("line_no", "ind", "closer", "opener")
    packed = sig.groupBy(*group, "_b").agg(F.sort_array(F.collect_list(entry)).alias("_n"))
    packed = written(packed.withColumn("_found", F.expr(_IN_BLOCK)), "line-blocks")
    found = packed.select(*group, F.explode_outer("_found").alias("x")).filter("x is not null").select(*group, "x.*")
    closed, open_ = found.filter("end_line is not null"), found.filter("end_line is null")

    # later blocks: non-closers indented less than all before them in their block, with the significant line before
    earlier = Window.partitionBy(*group, "_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    flat = packed.select(*group, "_b", F.explode("_n").alias("x")).select(*group, "_b", "x.*")
    low = flat.withColumn("_m", F.min(F.when(~F.col("closer"), F.col("ind"))).over(earlier)).withColumn("_in", F.max("line_no").over(earlier))
    low = low.filter(~F.col("closer") & (F.col("_m").isNull() | (F.col("ind") < F.col("_m")))).select(*group, "line_no", "ind", "_in", "_b")
    tails = packed.select(*group, "_b", F.element_at("_n", -1)["line_no"].alias("_last"))
    past = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("_prev", F.max("_last").over(past)).withColumn("_end", F.max("_last").over(Window.partitionBy(*group)))
    low = _joined(low, tails, [*group, "_b"]).withColumn("_before", F.coalesce("_in", "_prev")).filter("_before is not null")

    levels = open_.select(*group, F.col("ind").alias("_d")).distinct()
    marks = _joined(low, levels, group).filter("ind <= _d").select(*group, "_d", "line_no", "_before", F.lit(True).alias("_mark"))
    asked = open_.select(*group, F.col("ind").alias("_d"), F.col("start_line").alias("line_no"), F.lit(None).cast("int").alias("_before"), F.lit(False).alias("_mark"))
    # a line can be both the next one for earlier lines and open itself
    merged = marks.union(asked).groupBy(*group, "_d", "line_no").agg(F.max("_before").alias("_before"), F.max("_mark").alias("_mark"), F.min("_mark").alias("_asked"))
    nxt = block_scan(merged, [*group, "_d"], "line_no", {"_end_line": ("next", F.when(F.col("_mark"), F.col("_before")))}, block).filter("not _asked")
    ends = tails.select(*group, "_end").distinct()
    late = _joined(nxt, ends, group).select(*group, F.col("line_no").alias("start_line"), F.coalesce("_end_line", "_end").alias("end_line"))
    return written(closed.select(*group, "start_line", "end_line").union(late), "extents")


def nested_blocks(lines: DataFrame, group: list[str] = SECTION, block: int = BLOCK) -> DataFrame:
    """C8 over ``added_lines``: every definition with its extent, kind and name, in start order (``chunk_ord``)."""
    found = extents(lines, _DEFINITION, group, block)
    named = _joined(found, lines.withColumnRenamed("line_no", "start_line"), [*group, "start_line"])
    named = block_scan(named, group, "start_line", {"_k": ("sum", F.lit(1).cast("long"))}, block)
    return named.select(
        *group, (F.col("_k") - 1).cast("int").alias("chunk_ord"),
        F.when(F.ltrim("line").startswith("class"), "class").otherwise("function").alias("chunk_type"),
        F.regexp_extract("line", r"(?U)^[ \t\f]*(?:async\s+)?(?:def|class)\s+(\w+)", 1).alias("name"), "start_line", "end_line")


def block_rule_hits(lines: DataFrame, group: list[str] = SECTION, block: int = BLOCK) -> DataFrame:
    """A6 over ``added_lines``: loop and function rules as running counts and next values.

    R9: query calls counted up to a loop's last line and up to its first differ. R10: loops begun minus loops
    ended before a loop's first line. R11: the least line of a call, among calls whose previous equal call
    follows the loop's first line, lies in the loop. R18: the significant line after the next one that ends with
    a colon is a string inside the function.
    """
    loops = extents(lines, rv.LOOP_OPENER, group, block)
    defs = extents(lines, rv.DEF_OPENER, group, block)

    call = F.posexplode(F.regexp_extract_all("line", F.lit(rv.CALL_TEXT), F.lit(0))).alias("_i", "_text")
    calls = lines.select(*group, "line_no", call).withColumn("_b", F.floor(F.col("line_no") / block))
    inside = Window.partitionBy(*group, "_text", "_b").orderBy("line_no", "_i")
    calls = calls.withColumn("_prev", F.lag("line_no").over(inside))
    ends = calls.groupBy(*group, "_text", "_b").agg(F.max("line_no").alias("_last"))
    ends = ends.withColumn("_earlier", F.max("_last").over(Window.partitionBy(*group, "_text").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    first = _joined(calls.filter("_prev is null"), ends.filter("_earlier is not null").drop("_last"), [*group, "_text", "_b"])
    pairs = calls.filter("_prev is not null").select(*group, "_prev", "line_no").union(first.select(*group, F.col("_earlier"), "line_no"))
    again = written(pairs.groupBy(*group, F.col("_prev").alias("line_no")).agg(F.min("line_no").alias("_again")), "equal-calls")

    marks = lines.select(*group, "line_no", "line")
    for extra, name in ((loops.select(*group, F.col("start_line").alias("line_no"), F.lit(1).alias("_start")), "_start"),
                        (loops.groupBy(*group, F.col("end_line").alias("line_no")).agg(F.count(F.lit(1)).alias("_ended")), "_ended"), (again, "_again")):
        marks = _joined(marks, extra.select(*group, "line_no", name), [*group, "line_no"], "left")
    sig = F.col("line").rlike(r"(?U)[^\s\x1c-\x1f]") & ~F.col("line").startswith("#")
    doc = F.col("line").rlike(r"^[ \t\f]*[rRuUbBfF]*[\x22\x27]")
    marks = block_scan(written(marks, "line-marks"), group, "line_no", {
        "_q": ("sum", F.col("line").rlike(rv.QUERY_CALL).cast("long")), "_begun": ("sum", F.coalesce("_start", F.lit(0)).cast("long")),
        "_done": ("sum", F.coalesce("_ended", F.lit(0)).cast("long")), "_least": ("least", F.col("_again")),
        "_following": ("next", F.when(sig, F.struct(F.col("line_no").alias("at"), doc.alias("doc"))))}, block)
    colon = sig & F.col("line").rlike(r":\s*(#.*)?$")
    marks = block_scan(written(marks, "line-counts"), group, "line_no", {"_colon": ("next", F.when(colon, F.col("_following"))),
                                                 "_colon_at": ("next", F.when(colon, F.col("line_no")))}, block)
    marks = written(marks, "line-values")

    start = _joined(loops, marks.select(*group, F.col("line_no").alias("start_line"), "_q", "_begun", "_done", F.coalesce("_ended", F.lit(0)).alias("_own"), "_least"), [*group, "start_line"])
    both = _joined(start, marks.select(*group, F.col("line_no").alias("end_line"), F.col("_q").alias("_q_end")), [*group, "end_line"])
    depth = F.col("_begun") - (F.col("_done") - F.col("_own"))
    loop_tags = F.array(F.when(F.col("_q_end") > F.col("_q"), "R9"), F.when(depth >= 3, "R10deep").when(depth >= 2, "R10"),
                        F.when(F.col("_least") <= F.col("end_line"), "R11"))
    head = marks.select(*group, F.col("line_no").alias("start_line"), "line", colon.alias("_here"), "_following", "_colon", "_colon_at")
    fn = _joined(defs, head, [*group, "start_line"])
    at = F.when(F.col("_here"), F.col("start_line")).otherwise(F.col("_colon_at"))
    follow = F.when(F.col("_here"), F.col("_following")).otherwise(F.col("_colon"))
    documented = F.coalesce((at <= F.col("end_line")) & (follow["at"] <= F.col("end_line")) & follow["doc"], F.lit(False))
    public = ~F.regexp_extract("line", r"^[ \t\f]*(?:async\s+)?def\s+(\w+)", 1).startswith("_")
    def_tags = F.array(F.when(F.col("end_line") - F.col("start_line") + 1 > rv.LONG_FUNCTION_LINES, "R17"), F.when(public & ~documented, "R18"))
    hits = both.select(*group, F.col("start_line").alias("line_no"), F.explode(F.array_compact(loop_tags)).alias("_tag")).union(
        fn.select(*group, F.col("start_line").alias("line_no"), F.explode(F.array_compact(def_tags)).alias("_tag")))
    return hits.select(*group, F.col("line_no").cast("int").alias("line_no"), *rv.block_rule_meta(F.col("_tag")))
