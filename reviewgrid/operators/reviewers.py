"""Reviewers: fan-out (A1), model seam (A2), response parsing (A3, A4, P15),
deterministic rule table (A5, A6) and counts (A7).

The rule table is our offline substitute for the hosted model; its hits are
not the model's output. Line rules are one scan: every pattern is a literal
(compiled once per task) and the hits of a line come out of one
``filter(array(when(...)))`` generator. Block rules work on each section's
line array with the same per-row array plans as the chunkers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..constants import AGENT_TITLES, AGENTS

# FIXED VALUES: line rules (id, reviewer, severity, pattern, description).
# Patterns are RE2- and Java-compatible so the DuckDB oracle agrees.
LINE_RULES = [
    ("R1", "security", "critical", r"""(?i)["'].*\b(select|insert|update|delete)\b.*["']\s*\+""",
     "SQL query built by string concatenation (injection risk)"),
    ("R2", "security", "high", r"""(?i)\bf["'].*\b(select|insert|update|delete)\b.*\{""",
     "SQL query built with an f-string (injection risk)"),
    ("R3", "security", "high", r"""(?i)\b\w*(secret|password|passwd|token|api_?key)\w*\s*=\s*["'][^"']{6,}["']""",
     "Hard-coded secret or credential"),
    ("R4", "security", "critical", r"""os\.system\(.*\+|subprocess\.\w+\(.*shell\s*=\s*True""",
     "Shell command built from input"),
    ("R5", "security", "high", r"""\bpickle\.loads?\(""", "Insecure deserialisation with pickle"),
    ("R6", "security", "medium", r"""\bhashlib\.(md5|sha1)\(""", "Weak hash function"),
    ("R7", "security", "high", r"""\bopen\(\s*["'][^"']*["']\s*\+""", "File path built from input"),
    ("R8", "security", "medium", r"""verify\s*=\s*False|["']http://""", "Plain HTTP or disabled TLS verification"),
    ("R12", "style", "low", r"""^\s*except\s*:""", "Bare except clause"),
    ("R13", "style", "medium", r"""\bdef\s+\w+\(.*=\s*(\[\]|\{\})""", "Mutable default argument"),
    ("R14", "style", "low", r"""^\s*(async\s+)?def\s+\w*[A-Z]\w*""", "Function name is not snake_case"),
    ("R15", "style", "low", r"""^\s*class\s+(_*[a-z]\w*|\w+_\w*)""", "Class name is not PascalCase"),
    ("R16", "style", "low", r"""^\s*(async\s+)?def\s+\w+\([^)]*\)\s*:""", "Function signature without return type hint"),
]

# FIXED VALUES: block rules (id, reviewer, severity, description).
BLOCK_RULES = [
    ("R9", "performance", "high", "Database query inside a loop (N+1)"),
    ("R10", "performance", "medium", "Loop nested in a loop"),
    ("R11", "performance", "medium", "The same call repeated inside one loop"),
    ("R17", "style", "low", "Function longer than 20 lines"),
    ("R18", "style", "low", "Public function without a docstring"),
]
DEEP_LOOP_SEVERITY = "high"          # R10 at nesting depth 3 or more
LONG_FUNCTION_LINES = 20
QUERY_CALL = r"\.(execute|executemany|query)\s*\("
CALL_TEXT = r"[A-Za-z_][A-Za-z0-9_.]*\([^()]*\)"
LOOP_OPENER = r"^[ \t\f]*(async\s+)?(for|while)\b"
DEF_OPENER = r"^[ \t\f]*(async\s+)?def\s"

FINDING_FIELDS = ["rule_id", "agent", "severity", "category", "description"]


def _hit(rule, line: Column) -> Column:
    rid, agent, sev, pattern, desc = rule
    return F.when(line.rlike(pattern), F.struct(
        F.lit(rid).alias("rule_id"), F.lit(agent).alias("agent"), F.lit(sev).alias("severity"),
        F.lit(agent).alias("category"), F.lit(desc).alias("description")))


def line_hits_expr(line: Column, rules=LINE_RULES) -> Column:
    """Array of the rule hits of one line (a column or a lambda variable)."""
    return F.filter(F.array(*[_hit(r, line) for r in rules]), lambda x: x.isNotNull())


def line_rule_hits(lines: DataFrame, rules=LINE_RULES) -> DataFrame:
    """A5: one row per (line, matching rule); ``lines`` needs a ``line`` column."""
    hits = line_hits_expr(F.col("line"), rules)
    out = lines.withColumn("_h", F.explode_outer(hits)).filter(F.col("_h").isNotNull())
    return out.select(*[c for c in lines.columns], *[F.col(f"_h.{f}").alias(f) for f in FINDING_FIELDS])


# Extents of blocks whose opener matches OPENER, by the C8 indentation rule;
# positions are 0-based indices into the line array.
_EXTENTS = """
sort_array(flatten(transform(
  array_distinct(transform(filter(_n, x -> x.l rlike 'OPENER'), x -> x.ind)),
  d -> element_at(transform(
    array(filter(transform(_n, (x, p) -> if(x.ind <= d and not (x.l rlike '^[ \\\\t\\\\f]*[)\\\\]}]'), p + 1, -1)), p -> p > 0)),
    t -> transform(
      filter(transform(t, (p, m) -> named_struct('p', p, 'm', m)),
             y -> element_at(_n, y.p).ind = d and element_at(_n, y.p).l rlike 'OPENER'),
      y -> named_struct(
        'start', element_at(_n, y.p).i,
        'end', element_at(_n, coalesce(try_element_at(t, y.m + 2), size(_n) + 1) - 1).i,
        'sp', y.p,
        'ep', coalesce(try_element_at(t, y.m + 2), size(_n) + 1) - 1))), 1))))
"""
_SIG = "x -> x.l rlike '(?U)[^\\\\s\\\\x1c-\\\\x1f]' and not startswith(x.l, '#')"


def _extents(opener: str) -> str:
    return _EXTENTS.replace("OPENER", opener.replace("\\", "\\\\"))


def with_block_hits(df: DataFrame, lines_col: str, out_col: str) -> DataFrame:
    """Add ``out_col``: array of (line 0-based, rule tag) block-rule hits of each row's lines."""
    n = F.expr(f"filter(transform({lines_col}, (l, i) -> named_struct('i', i, 'l', l, "
               f"'ind', length(regexp_extract(l, '^[ \\\\t\\\\f]*', 0)))), {_SIG})")
    df = df.withColumn("_n", n)
    df = df.withColumn("_loops", F.expr(_extents(LOOP_OPENER)))
    df = df.withColumn("_defs", F.expr(_extents(DEF_OPENER)))
    # Loop depth: merge start and end events sorted by (position, start before end);
    # the m-th start at merged index q lies inside 2m - q + 1 loops (itself included).
    df = df.withColumn("_ev", F.expr("""sort_array(concat(
        transform(_loops, x -> named_struct('pos', x.start, 'kind', 0)),
        transform(_loops, x -> named_struct('pos', x.end, 'kind', 1))))"""))
    df = df.withColumn("_sq", F.expr(
        "filter(transform(_ev, (e, q) -> if(e.kind = 0, q, -1)), q -> q >= 0)"))
    q_body = f"slice({lines_col}, x.start + 2, x.end - x.start)"
    loop_hits = F.expr(f"""transform(_loops, (x, m) -> array(
        if(exists({q_body}, l -> l rlike '{QUERY_CALL.replace(chr(92), chr(92) * 2)}'),
           named_struct('line', x.start, 'rule', 'R9'), null),
        if(2 * m - element_at(_sq, m + 1) + 1 >= 2,
           named_struct('line', x.start, 'rule', if(2 * m - element_at(_sq, m + 1) + 1 >= 3, 'R10deep', 'R10')), null),
        if(size(flatten(transform({q_body}, l -> regexp_extract_all(l, '{CALL_TEXT.replace(chr(92), chr(92) * 2)}', 0))))
             > size(array_distinct(flatten(transform({q_body}, l -> regexp_extract_all(l, '{CALL_TEXT.replace(chr(92), chr(92) * 2)}', 0))))),
           named_struct('line', x.start, 'rule', 'R11'), null)))""")
    # Signature end: first significant line of the block ending with ':'; the
    # docstring is the significant line after it, inside the block.
    df = df.withColumn("_defs", F.expr("""transform(_defs, x -> named_struct(
        'start', x.start, 'end', x.end, 'sp', x.sp, 'ep', x.ep,
        'se', try_element_at(filter(transform(slice(_n, x.sp, x.ep - x.sp + 1),
                (y, k) -> if(y.l rlike ':\\\\s*(#.*)?$', x.sp + k, -1)), p -> p > 0), 1)))"""))
    name = f"regexp_extract(element_at({lines_col}, x.start + 1), '^[ \\\\t\\\\f]*(?:async\\\\s+)?def\\\\s+(\\\\w+)', 1)"
    doc = ("(x.se is not null and x.se + 1 <= x.ep and "
           "element_at(_n, x.se + 1).l rlike '^[ \\\\t\\\\f]*[rRuUbBfF]*[\\\\x22\\\\x27]')")
    def_hits = F.expr(f"""transform(_defs, x -> array(
        if(x.end - x.start + 1 > {LONG_FUNCTION_LINES}, named_struct('line', x.start, 'rule', 'R17'), null),
        if(not startswith({name}, '_') and not {doc}, named_struct('line', x.start, 'rule', 'R18'), null)))""")
    hits = F.filter(F.flatten(F.concat(loop_hits, def_hits)), lambda h: h.isNotNull())
    return df.withColumn(out_col, hits).drop("_n", "_loops", "_defs", "_ev", "_sq")


def block_rule_meta(rule: Column) -> list[Column]:
    """rule_id, agent, severity, category, description of a block hit's rule tag."""
    rules = {rid: (agent, sev, desc) for rid, agent, sev, desc in BLOCK_RULES}
    sev = F.lit(None).cast("string")
    agent = F.lit(None).cast("string")
    desc = F.lit(None).cast("string")
    rule_col = F.when(rule == "R10deep", F.lit("R10")).otherwise(rule)
    for rid, (a, s, d) in rules.items():
        agent = F.when(rule_col == rid, F.lit(a)).otherwise(agent)
        sev = F.when(rule_col == rid, F.lit(s)).otherwise(sev)
        desc = F.when(rule_col == rid, F.lit(d)).otherwise(desc)
    sev = F.when(rule == "R10deep", F.lit(DEEP_LOOP_SEVERITY)).otherwise(sev)
    return [rule_col.alias("rule_id"), agent.alias("agent"), sev.alias("severity"), agent.alias("category"),
            desc.alias("description")]


def block_rule_hits(sections: DataFrame, keys: list[str], lines_col: str = "src_lines") -> DataFrame:
    """Loop and function rules over each section's line array.

    Returns ``keys + [line_no (1-based), rule_id, agent, severity, category, description]``.
    """
    df = with_block_hits(sections.select(*keys, lines_col), lines_col, "_bh")
    out = df.select(*keys, F.explode_outer("_bh").alias("_h")).filter(F.col("_h").isNotNull())
    return out.select(*keys, (F.col("_h.line") + 1).cast("int").alias("line_no"), *block_rule_meta(F.col("_h.rule")))


def fanout(chunks: DataFrame) -> DataFrame:
    """A1: every chunk x every reviewer, with the reviewer's order."""
    agents = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(i).alias("agent_ord")) for i, a in enumerate(AGENTS)])
    return chunks.withColumn("_a", F.explode(agents)).select("*", "_a.agent", "_a.agent_ord").drop("_a")


# ---- A2: the model seam -------------------------------------------------------

RETRYABLE = ("rate_limit", "overloaded", "529")


def call_with_retry(fn: Callable[[str, str, str], str], agent: str, file_path: str, prompt: str,
                    attempts: int = 3, backoff: float = 1.0) -> tuple[str | None, str | None]:
    """Call ``fn``; retry rate-limit style errors with 1, 2, 4 x ``backoff`` seconds.

    Returns (response, error). Any other error, or running out of attempts,
    is returned as the error text (it becomes an error finding, A4).
    """
    for attempt in range(attempts):
        try:
            return fn(agent, file_path, prompt), None
        except Exception as e:  # noqa: BLE001 - the error text is the result
            msg = str(e)
            if any(r in msg.lower() for r in RETRYABLE) and attempt + 1 < attempts:
                time.sleep(backoff * (2 ** attempt))
                continue
            return None, msg
    return None, "retries exhausted"


def call_batches(tasks: DataFrame, fn: Callable[[str, str, str], str], concurrency: int | None = None,
                 attempts: int = 3, backoff: float = 1.0) -> DataFrame:
    """A2 as a plan: ``response`` and ``error`` beside each task's columns.

    Every use of the result calls the scorer again; ``model_calls`` and
    ``call_ledger.ledger_calls`` write it.
    """
    from ..session import ship_package
    ship_package(tasks.sparkSession)
    if concurrency:
        tasks = tasks.repartition(concurrency)
    schema = StructType(list(tasks.schema.fields) + [StructField("response", StringType()),
                                                     StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            res = [call_with_retry(fn, a, p, c, attempts, backoff)
                   for a, p, c in zip(pdf["agent"], pdf["file_path"], pdf["prompt"])]
            pdf = pdf.copy()
            pdf["response"] = [r for r, _ in res]
            pdf["error"] = [e for _, e in res]
            yield pdf

    return tasks.mapInPandas(run, schema)


def model_calls(tasks: DataFrame, fn: Callable[[str, str, str], str], concurrency: int | None = None,
                attempts: int = 3, backoff: float = 1.0) -> DataFrame:
    """A2: call a user scorer once per (chunk, reviewer) row, partition-parallel.

    ``tasks`` needs ``agent``, ``file_path`` and ``prompt`` (P13); ``concurrency``
    bounds the number of simultaneous callers (partitions). The result adds
    ``response`` and ``error`` columns. It is written to the shared folder and read
    back, so each call is made once however often the result is used.
    """
    from ..session import work_path
    made = call_batches(tasks, fn, concurrency, attempts, backoff)
    path = work_path(tasks.sparkSession, "responses")
    made.write.parquet(path)
    return tasks.sparkSession.read.schema(made.schema).parquet(path)


# ---- A3 / A4 / P15: strict response parsing ---------------------------------------

def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """Classify each response: ``rows`` (array of objects), ``none`` or ``error``.

    Strict like ``json.loads`` + item assignment: the text is wrapped in
    ``[...]`` so trailing text is a syntax error; ``[]``, ``{}`` and ``""``
    give no findings; anything else that is not an array of objects is an
    error. Adds ``status`` and ``items`` (array<variant> when rows).
    """
    s = F.col(text)
    wrapped = F.concat(F.lit("["), s, F.lit("]"))
    v = F.try_parse_json(wrapped)
    one = F.when(F.json_array_length(wrapped) == 1, F.expr("try_variant_get(_v, '$[0]', 'variant')"))
    df = responses.withColumn("_v", v).withColumn("_r", one)
    arr = F.expr("try_variant_get(_r, '$', 'array<variant>')")
    df = df.withColumn("_a", arr)
    is_empty_value = (F.schema_of_variant(F.col("_r")) == "OBJECT<>") | (F.to_json(F.col("_r")) == '""')
    bad_item = F.exists("_a", lambda x: F.is_variant_null(x) | ~F.schema_of_variant(x).startswith("OBJECT<"))
    status = (F.when(s.isNull() | (F.trim(s) == "") | F.col("_v").isNull() | F.col("_r").isNull(), F.lit("error"))
              .when(is_empty_value, F.lit("none"))
              .when(F.col("_a").isNull(), F.lit("error"))
              .when(bad_item, F.lit("error"))
              .when(F.size("_a") == 0, F.lit("none"))
              .otherwise(F.lit("rows")))
    return df.withColumn("status", status).withColumn(
        "items", F.when(F.col("status") == "rows", F.col("_a"))).drop("_v", "_r", "_a")


def response_findings(parsed: DataFrame, keys: list[str], path_col: str = "file_path") -> DataFrame:
    """A3 + P15: one finding per array element; ``file_path`` is overwritten with
    the chunk's path, the model's ``category`` is kept."""
    rows = parsed.filter(F.col("status") == "rows").select(
        *keys, path_col, F.posexplode_outer("items").alias("item_ord", "_it")).filter(F.col("_it").isNotNull())
    get = lambda f, t="string": F.expr(f"try_variant_get(_it, '$.{f}', '{t}')")
    return rows.select(*keys, "item_ord", F.col(path_col).alias("file_path"),
                       get("line_number", "int").alias("line_number"), get("severity").alias("severity"),
                       get("category").alias("category"), get("description").alias("description"),
                       get("suggested_fix").alias("suggested_fix"))


def error_findings(parsed: DataFrame, keys: list[str], agent_col: str = "agent",
                   path_col: str = "file_path", reason: Column | None = None) -> DataFrame:
    """A4: one low-severity line-0 finding per failed call (category = reviewer)."""
    titles = F.create_map(*[x for a in AGENTS for x in (F.lit(a), F.lit(AGENT_TITLES[a]))])
    why = reason if reason is not None else F.lit("response is not a JSON array of findings")
    err = parsed.filter(F.col("status") == "error")
    return err.select(*keys, F.lit(0).alias("item_ord"), F.col(path_col).alias("file_path"),
                      F.lit(0).alias("line_number"), F.lit("low").alias("severity"),
                      F.col(agent_col).alias("category"),
                      F.concat(F.coalesce(F.element_at(titles, F.col(agent_col)), F.col(agent_col)),
                               F.lit(" agent error: "), why).alias("description"),
                      F.lit("").alias("suggested_fix"))
