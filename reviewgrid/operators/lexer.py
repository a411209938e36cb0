"""C6 on lexed lines: top-level definitions of Python text, triple-quoted strings and brackets read as such.

A line's effect on strings is a function from the state it starts in (code, inside ''', inside
three double quotes) to the state it ends in. The three values are computed by regular expressions in
the JVM, folded over each block of lines, composed over the blocks of a file, and folded again from each block's
true entry state. With the state known, brackets opened minus closed outside strings and comments
are a running sum, and a backslash at a line's end continues it. All of this is known of a line for each state it may
start in before it is moved, so what is shuffled and written are a few numbers a line, and no text. A line starts a statement if it
starts in code, outside brackets and not as a continuation; only such lines can open or end a
top-level block.

Works on a line table (``group``, ``line_no`` from 1, ``line``), so a file of any size is lexed by many tasks; one row
per block of lines (a character each) is all that a file gathers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written
from .line_scan import BLOCK, SECTION, _joined, block_scan

_SINGLE, _DOUBLE = "'''", '"""'
_BODY = r"(?:\\(?:.|$)|[^\\])*?"
_CLOSED = rf"{_DOUBLE}{_BODY}{_DOUBLE}|{_SINGLE}{_BODY}{_SINGLE}"
_ONE_LINE = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""
#: Strings and comments of a line that starts in code; an unfinished triple-quoted string runs to its end.
TOKENS = rf"{_DOUBLE}{_BODY}(?:{_DOUBLE}|$)|{_SINGLE}{_BODY}(?:{_SINGLE}|$)|{_ONE_LINE}|#.*$"
CLOSE = {1: rf"^{_BODY}{_SINGLE}", 2: rf"^{_BODY}{_DOUBLE}"}
# The same for Java, which recurses once for every turn of a group that may be given back and runs out of stack on a long
# line. What a string may hold up to its end is one way to read it, so nothing need be given back: possessive groups loop.
_IN_DOUBLE = r"""(?:[^"\\]++|\\(?:.|$)|"(?!""))*+"""
_IN_SINGLE = r"""(?:[^'\\]++|\\(?:.|$)|'(?!''))*+"""
_J_CLOSED = rf"{_DOUBLE}{_IN_DOUBLE}{_DOUBLE}|{_SINGLE}{_IN_SINGLE}{_SINGLE}"
_J_ONE_LINE = r""""(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'"""
_J_TOKENS = rf"{_DOUBLE}{_IN_DOUBLE}(?:{_DOUBLE}|$)|{_SINGLE}{_IN_SINGLE}(?:{_SINGLE}|$)|{_J_ONE_LINE}|#.*$"
_J_CLOSE = {1: rf"^{_IN_SINGLE}{_SINGLE}", 2: rf"^{_IN_DOUBLE}{_DOUBLE}"}
OPENER = r"^(async\s+def|def|class)\s"


def _exit_from_code(text: Column) -> Column:
    """State after ``text`` when it starts in code: what its last string leaves open."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(_J_TOKENS), F.lit(0)), F.lit(-1))
    open_ = ~last.rlike(rf"^(?:{_J_CLOSED})$")
    return F.when(last.startswith(_DOUBLE) & open_, "2").when(last.startswith(_SINGLE) & open_, "1").otherwise("0")


def _rest(line: Column, state: int) -> Column:
    """What follows the end of the string that the line starts in; null if it doesn't end here."""
    return F.when(line.rlike(_J_CLOSE[state]), F.regexp_replace(line, _J_CLOSE[state], ""))


def _effect(line: Column) -> Column:
    """Three characters: the exit states from entry states 0, 1 and 2."""
    from_string = [F.coalesce(_exit_from_code(_rest(line, s)), F.lit(str(s))) for s in (1, 2)]
    quoted = line.contains(_SINGLE) | line.contains(_DOUBLE)
    return F.when(quoted, F.concat(_exit_from_code(line), *[F.when(_rest(line, s).isNull(), str(s)).otherwise(x) for s, x in zip((1, 2), from_string, strict=True)])).otherwise("012")


def _step(effect: Column, state: Column) -> Column:
    return F.substring(effect, state.cast("int") + 1, F.lit(1))


def _by_state(x: Column | None, name: str, state: Column) -> Column:
    """Of the three values of a line, that of the state it starts in."""
    of = (lambda k: F.col(f"{name}{k}")) if x is None else (lambda k: x[f"{name}{k}"])
    return F.when(state == 0, of(0)).when(state == 1, of(1)).otherwise(of(2))


def _lexed(lines: DataFrame, group: list[str], block: int, keep: dict[str, Column]) -> tuple[DataFrame, list[DataFrame]]:
    """``lexed`` with the group as one column ``_g`` (rows of null keys meet) and the block as ``_b``, dealt by both; the tables it is read from."""
    line = F.col("line")
    rest = lambda s: F.when(line.contains(_SINGLE) | line.contains(_DOUBLE), F.regexp_replace(F.coalesce(_rest(line, s), F.lit("")), _J_TOKENS, "")).otherwise("")
    src = lines.select(F.struct(*group).alias("_g"), F.floor(F.col("line_no") / block).alias("_b"), "line_no", "line").withColumns(
        {"_code0": F.regexp_replace(line, _J_TOKENS, ""), "_code1": rest(1), "_code2": rest(2)})
    code = [F.col(f"_code{s}") for s in range(3)]
    delta = [F.coalesce(F.regexp_count(c, F.lit(r"[(\[{]")) - F.regexp_count(c, F.lit(r"[)\]}]")), F.lit(0)) for c in code]
    entry = F.struct("line_no", _effect(line).alias("f"), *[d.alias(f"d{s}") for s, d in enumerate(delta)],
                     *[F.coalesce(c.endswith("\\"), F.lit(False)).alias(f"on{s}") for s, c in enumerate(code)], *[c.alias(n) for n, c in keep.items()])
    packed = src.groupBy("_g", "_b").agg(F.sort_array(F.collect_list(entry)).alias("_n"))
    quoted = F.filter("_n", lambda x: x["f"] != "012")
    whole = F.aggregate(quoted, F.lit("012"), lambda acc, x: F.concat(*[_step(x["f"], F.substring(acc, i, 1)) for i in (1, 2, 3)]))
    packed = written(packed.withColumn("_f", whole), "lexer-blocks")
    # compose over the blocks of a file: one character of state per block
    chain = packed.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_b", "_f"))).alias("_s"))
    states = F.aggregate("_s", F.lit("0"), lambda acc, x: F.concat(acc, _step(x["_f"], F.substring(acc, -1, 1))))
    enter = chain.withColumn("_t", states).select("_g", F.posexplode("_s").alias("_k", "x"), "_t", (F.size("_s") > 1).alias("_many")).select(
        "_g", F.col("x._b").alias("_b"), F.expr("substring(_t, _k + 1, 1)").alias("_in"), "_many")
    enter = written(enter, "lexer-entries")

    # brackets and a continued line that earlier blocks of the file hand on
    ends = packed.select("_g", "_b", "_n").join(enter.filter("_many").drop("_many"), ["_g", "_b"]).withColumn("_e", F.aggregate(
        "_n", F.struct(F.col("_in").cast("int").alias("s"), F.lit(0).cast("long").alias("d"), F.lit(False).alias("on")), lambda acc, x: F.struct(
            F.substring(x["f"], acc["s"] + 1, F.lit(1)).cast("int").alias("s"), (acc["d"] + _by_state(x, "d", acc["s"])).alias("d"), _by_state(x, "on", acc["s"]).alias("on"))))
    past = Window.partitionBy("_g").orderBy("_b")
    carry = ends.select("_g", "_b", F.element_at("_n", -1)["line_no"].alias("_no"), "_e.d", "_e.on").select(
        "_g", "_b", F.sum("d").over(past.rowsBetween(Window.unboundedPreceding, -1)).alias("_depth"),
        F.when(F.lag("on").over(past), F.lag("_no").over(past) + 1).alias("_goes_on_at"))
    carry = written(carry, "lexer-carries")
    both = packed.drop("_f").join(enter.drop("_many"), ["_g", "_b"]).join(carry, ["_g", "_b"], "left")
    both = both.withColumn("_states", F.aggregate("_n", F.col("_in"), lambda acc, x: F.concat(acc, _step(x["f"], F.substring(acc, -1, 1)))))
    rows = both.select("_g", "_b", "_depth", "_goes_on_at", "_states", F.posexplode("_n").alias("_k", "x")).select(
        "_g", "_b", "_depth", "_goes_on_at", F.expr("cast(substring(_states, _k + 1, 1) as int)").alias("state"), "x.*")
    here = Window.partitionBy("_g", "_b").orderBy("line_no")
    rows = rows.withColumns({"_d": _by_state(None, "d", F.col("state")), "_on": _by_state(None, "on", F.col("state"))})
    inside = F.coalesce(F.sum("_d").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.coalesce(F.when(F.lag("_on").over(here), F.lag("line_no").over(here) + 1), F.when(F.lag("line_no").over(here).isNull(), F.col("_goes_on_at")))
    return rows.withColumns({"depth": F.coalesce("_depth", F.lit(0)) + inside, "continued": F.coalesce(F.col("line_no") == at, F.lit(False))}).select(
        "_g", "_b", "line_no", *keep, "state", "depth", "continued"), [packed, enter, carry]


def lexed(lines: DataFrame, group: list[str] = SECTION, block: int = BLOCK, keep: dict[str, Column] | None = None) -> DataFrame:
    """``group, line_no`` with what ``keep`` computes of a line (``line`` itself if not given) and at the line's start ``state``
    (0 code, 1 or 2 inside a triple-quoted string), ``depth`` (open brackets) and ``continued``.

    Whatever a line may do from each of the three states is computed where it is read, so its text moves on only if it is kept."""
    keep = {"line": F.col("line")} if keep is None else keep
    return _lexed(lines, group, block, keep)[0].select("_g.*", "line_no", *keep, "state", "depth", "continued")


def toplevel_extents(lines: DataFrame, group: list[str] = SECTION, block: int = BLOCK) -> DataFrame:
    """``group, chunk_ord, name, chunk_type, start_line, end_line`` of the undecorated top-level definitions."""
    line = F.col("line")
    rows, tables = _lexed(lines, group, block, {
        "blank": ~line.rlike(r"(?U)[^\s\x1c-\x1f]"), "comment": line.rlike(r"^[ \t\f]*#"), "indented": line.rlike(r"^[ \t\f]"), "decorator": line.startswith("@"),
        "name": F.when(line.rlike(OPENER), F.regexp_extract(line, r"(?U)^(?:async\s+)?(?:def|class)\s+(\w+)", 1)), "is_class": line.startswith("class")})
    starts = (F.col("state") == 0) & (F.col("depth") <= 0) & ~F.col("continued")
    solid = ~(starts & (F.col("blank") | F.col("comment"))) & ~((F.col("state") == 0) & F.col("blank"))
    number = F.col("line_no")
    here = Window.partitionBy("_g", "_b").orderBy("line_no")
    # of a block: its heads, each with the last solid line before it, and its last solid line
    rows = rows.withColumn("_head", starts & solid & ~F.col("indented")).filter(solid).select(
        "_g", "_b", "line_no", "_head", "decorator", "name", "is_class", F.lag("line_no").over(here).alias("_prev"), F.lead("line_no").over(here).isNull().alias("_final"))
    rows = rows.filter("_head or _final").withColumns({
        "_first": F.lag("line_no").over(here).isNull(), "_decorated": F.lag("decorator").over(here), "_more": F.coalesce(F.lead("_head").over(here), F.lit(False)), "_next": F.lead("_prev").over(here)})
    wanted = F.col("name").isNotNull() | F.col("_first") | F.col("_final") | ~F.col("_more")
    rows = written(rows.filter(wanted).select("_g.*", "_b", "line_no", "_head", "decorator", "name", "is_class", "_prev", "_first", "_decorated", "_more", "_next"), "lexed-heads")
    discard(*tables)
    # what other blocks of the file say: their last solid line, whether their last head is a decorator, what precedes their first head
    head = F.col("_head")
    sums = rows.groupBy(*group, "_b").agg(
        F.max(number).alias("_last"), F.max(head).alias("_any"), F.max_by("decorator", F.when(head, number)).alias("_at"), F.max(F.when(F.col("_first") & head, F.col("_prev"))).alias("_front"))
    file = Window.partitionBy(*group)
    earlier = file.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = file.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.max("_last").over(earlier), "_open": F.last(F.when(F.col("_any"), F.col("_at")), True).over(earlier), "_end": F.max("_last").over(file)})
    sums = sums.withColumn("_ahead", F.when(F.col("_any"), F.coalesce("_front", "_before"))).withColumn("_after", F.last("_ahead", True).over(later))
    found = _joined(rows.filter("_head and name is not null"), sums.select(*group, "_b", "_open", "_after", "_end"), [*group, "_b"])
    found = found.filter(~F.coalesce("_decorated", "_open", F.lit(False))).select(
        *group, "line_no", "name", "is_class", F.when(F.col("_more"), F.col("_next")).otherwise(F.coalesce("_after", "_end")).alias("_end_line"))
    found = block_scan(found, group, "line_no", {"_o": ("sum", F.lit(1).cast("long"))}, block)
    return found.select(*group, (F.col("_o") - 1).cast("int").alias("chunk_ord"), "name",
                        F.when(F.col("is_class"), "class").otherwise("function").alias("chunk_type"),
                        number.cast("int").alias("start_line"), F.col("_end_line").cast("int").alias("end_line"))
