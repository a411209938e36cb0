"""The core plan: diffs -> chunks -> reviewers -> merged findings.

``review(diffs)`` is what the batch queries, the stream (T2) and the bench
run. Chunking and rule scoring are per row (no shuffle); the only shuffles
are the dedup aggregation (map-side combined) and the position numbering
per PR revision, which spreads each PR over ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunkers, merge, reviewers as rv, sections
from ..operators.call_ledger import ledger_calls
from ..operators.retrieval import with_prompt

SCOPE = ["repo", "pr_number", "commit_sha"]
CHUNK_KEY = SCOPE + ["file_ord", "chunk_ord"]
OUT = ["repo", "pr_number", "commit_sha", "position", "agent", "severity", "category", "file_path",
       "line_number", "description", "suggested_fix", "rank"]


def chunk_diffs(diffs: DataFrame) -> DataFrame:
    """S2 -> C1 -> C3 -> C9: the chunks of every diff."""
    return chunkers.dispatch_chunks(sections.added_source(sections.sections_a(diffs)))


def rule_findings(chunks: DataFrame) -> DataFrame:
    """Rule-table reviewers on each chunk: line rules (A5) and block rules.

    One pass over the chunks: both hit lists are built inside the row and
    one generator emits them. ``line_number`` is the line in the section's
    added source (the chunk's ``start_line`` plus the offset in the chunk).
    """
    lined = chunks.select(*CHUNK_KEY, "file_path", "start_line",
                          F.split(F.col("content"), "\n", -1).alias("_lines"))
    lined = rv.with_block_hits(lined, "_lines", "_bh")
    line_hits = F.flatten(F.transform("_lines", lambda l, off: F.transform(
        rv.line_hits_expr(l), lambda h: F.struct(off.alias("off"), h["rule_id"].alias("tag"), F.lit(False).alias("block")))))
    block_hits = F.transform("_bh", lambda h: F.struct(h["line"].alias("off"), h["rule"].alias("tag"),
                                                      F.lit(True).alias("block")))
    out = lined.select(*CHUNK_KEY, "file_path", "start_line",
                       F.explode_outer(F.concat(line_hits, block_hits)).alias("_h")).filter(F.col("_h").isNotNull())
    line_meta = {r[0]: r for r in rv.LINE_RULES}
    tag = F.col("_h.tag")
    block_cols = rv.block_rule_meta(tag)
    cols = []
    for i, name in enumerate(["rule_id", "agent", "severity", "category", "description"]):
        expr = block_cols[i]
        for rid, agent, sev, _pat, desc in line_meta.values():
            val = {"rule_id": rid, "agent": agent, "severity": sev, "category": agent, "description": desc}[name]
            expr = F.when(~F.col("_h.block") & (tag == rid), F.lit(val)).otherwise(expr)
        cols.append(expr.alias(name))
    return out.select(
        *CHUNK_KEY, "file_path", (F.col("start_line") + F.col("_h.off")).cast("int").alias("line_number"),
        (F.col("_h.off") * 100 + F.regexp_extract(tag, "[0-9]+", 0).cast("int")).alias("item_ord"),
        *cols, F.lit(None).cast("string").alias("suggested_fix"))


def scorer_findings(chunks: DataFrame, scorer: Callable[[str, str, str], str],
                    concurrency: int | None = None, backoff: float = 1.0,
                    ledger: tuple[str, str] | None = None) -> DataFrame:
    """Model-seam reviewers: P13 -> A1 -> A2 -> A3 + A4 (+ P15); the scorer gets (agent, file path, prompt).

    With ``ledger`` (folder, run name) calls that were answered before are not made again.
    """
    tasks = rv.fanout(with_prompt(chunks)).select(*CHUNK_KEY, "file_path", "agent", "prompt")
    if ledger:
        calls = ledger_calls(tasks, scorer, *ledger, concurrency=concurrency, backoff=backoff)
    else:
        calls = rv.model_calls(tasks, scorer, concurrency, backoff=backoff)
    parsed = rv.parse_responses(calls).withColumn(
        "status", F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.col("status")))
    keys = CHUNK_KEY + ["agent"]
    ok = rv.response_findings(parsed, keys)
    bad = rv.error_findings(parsed, keys, reason=F.coalesce(
        F.col("error"), F.lit("response is not a JSON array of findings")))
    return ok.unionByName(bad)


MODULE_SCAN_ORD = 1 << 30   # module-level hits order after every chunk


def module_secret_findings(sources: DataFrame) -> DataFrame:
    """Opt-in repair of SURVEY note 5: the secret rule (R3) over every added
    line, so module-level constants are reported too. Hits inside a chunk
    duplicate a chunk finding's key and are merged by the dedup."""
    r3 = [r for r in rv.LINE_RULES if r[0] == "R3"]
    lines = sections.chunk_lines(sources)
    hits = rv.line_rule_hits(lines, r3)
    return hits.select(*SCOPE, "file_ord", F.lit(MODULE_SCAN_ORD).alias("chunk_ord"), "file_path",
                       F.col("line_no").alias("line_number"), (F.col("line_no") * 100 + 3).alias("item_ord"),
                       "rule_id", "agent", "severity", "category", "description",
                       F.lit(None).cast("string").alias("suggested_fix"))


def review(diffs: DataFrame, scorer: Callable[[str, str, str], str] | None = None,
           concurrency: int | None = None,
           secrets_outside_chunks: bool = False, chunk_table: str | None = None,
           ledger: tuple[str, str] | None = None) -> DataFrame:
    """Diffs -> prioritised, deduplicated findings per PR revision (M4 order).

    ``chunk_table`` names a folder: the chunks are written there once and the review
    reads them from it, so that a caller can use them too. ``ledger`` (folder, run
    name) keeps the scorer's answers over runs (``operators.call_ledger``).

    ``secrets_outside_chunks`` (off by default, parity) also scans
    module-level added lines for hard-coded secrets.
    """
    sources = sections.added_source(sections.sections_a(diffs))
    chunks = chunkers.dispatch_chunks(sources)
    if chunk_table:
        chunks.write.mode("overwrite").parquet(chunk_table)
        chunks = chunks.sparkSession.read.schema(chunks.schema).parquet(chunk_table)
    found = rule_findings(chunks) if scorer is None else scorer_findings(chunks, scorer, concurrency, ledger=ledger)
    if secrets_outside_chunks:
        extra = module_secret_findings(sources)
        found = found.unionByName(extra.select(*found.columns))
    ordered = merge.order_findings(found, ["file_ord", "chunk_ord", "item_ord"])
    ranked = merge.prioritise(merge.dedup(ordered, SCOPE), SCOPE)
    return ranked.select(*OUT)
