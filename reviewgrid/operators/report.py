"""Rendering and per-PR reports (P9, P10, F5, G6, G7, G8, K3 and K4 rows).

In a findings table a missing key and a null value are the same thing, so
the renderers apply the defaults of a missing key to nulls: severity
``low``, category ``""``, line ``?``, description and fix ``""``.

The summary markdown of a PR is one value by nature: the task that finishes
it holds the whole document. What it does not hold is the PR's findings one by
one: they are rendered and concatenated in blocks of ``block_rows`` consecutive
positions by many tasks, and only the blocks meet.

Reports are per ``scope``: a PR by default, a revision of it
(repo, pr_number, commit_sha) in the review stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NO_ISSUES_BODY, SUMMARY_FOOTER, SUMMARY_SUBTITLE, SUMMARY_TITLE
from ..functions.severity import category_label, line_label, severity_emoji, shown_severity

SCOPE = ["repo", "pr_number"]


def _s(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def publishable(findings: DataFrame) -> DataFrame:
    """``line_number > 0`` and a non-empty path (null is false)."""
    return findings.filter(F.coalesce((F.col("line_number") > 0) & (F.col("file_path") != ""),
                                      F.lit(False)))


def with_badge(findings: DataFrame) -> DataFrame:
    """Emoji, upper-case severity label and capitalised category label."""
    return (findings.withColumn("emoji", severity_emoji("severity"))
            .withColumn("severity_label", F.upper(shown_severity("severity")))
            .withColumn("category_label", category_label("category")))


def inline_body() -> Column:
    """P10: the inline comment body (expects ``with_badge`` columns)."""
    return F.concat(F.col("emoji"), F.lit(" **["), F.col("severity_label"), F.lit("] "),
                    F.col("category_label"), F.lit("**\n\n"), _s("description"),
                    F.lit("\n\n**Fix:**\n```python\n"), _s("suggested_fix"), F.lit("\n```"))


def summary_item() -> Column:
    """One numbered entry of the summary markdown (expects ``position`` and badge columns)."""
    return F.concat(
        F.lit("### "), F.col("position").cast("string"), F.lit(". "), F.col("emoji"), F.lit(" `["),
        F.col("severity_label"), F.lit("]` "), F.col("category_label"), F.lit(" — `"),
        _s("file_path"), F.lit("` line "), line_label("line_number"),
        F.lit("\n\n**Issue:** "), _s("description"),
        F.lit("\n\n**Suggested Fix:**\n```python\n"), _s("suggested_fix"), F.lit("\n```\n\n---\n"))


def summary_markdown(ranked: DataFrame, scope: list[str] = SCOPE,
                     block_rows: int = 1000) -> DataFrame:
    """Numbered summary markdown per PR from prioritised findings.

    ``ranked`` needs ``position`` (1-based order inside the PR). Lines of the
    document are joined by newlines: title, subtitle, count line, rule,
    one entry per finding, footer.
    """
    items = (with_badge(ranked).withColumn("_item", summary_item())
             .withColumn("_block", ((F.col("position") - 1) / F.lit(block_rows)).cast("int")))
    blocks = items.groupBy(*scope, "_block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "_item"))),
                                 lambda x: x["_item"]), "\n").alias("_text"),
        F.count(F.lit(1)).alias("_n"))
    per_pr = blocks.groupBy(*scope).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_text"))),
                                 lambda x: x["_text"]), "\n").alias("_items"),
        F.sum("_n").cast("bigint").alias("n_findings"))
    header = F.concat(F.lit(SUMMARY_TITLE + "\n" + SUMMARY_SUBTITLE + "\n**"),
                      F.col("n_findings").cast("string"),
                      F.lit(" issue(s) found**, sorted by severity.\n\n---\n\n"))
    return per_pr.select(*scope, "n_findings",
                         F.concat(header, F.col("_items"), F.lit("\n" + SUMMARY_FOOTER)).alias("markdown"))


def inline_comments(ranked: DataFrame, commit_sha: Column, scope: list[str] = SCOPE) -> DataFrame:
    """K3 rows: one per publishable finding, in the PR's finding order."""
    pub = with_badge(publishable(ranked))
    return pub.select(*scope, commit_sha.alias("commit_sha"), F.col("file_path").alias("path"),
                      F.col("line_number").alias("line"), F.lit("RIGHT").alias("side"),
                      inline_body().alias("body"), "position")


def pr_summary(prs_chunks: DataFrame, findings_per_pr: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Per PR with chunks, total findings and chunks analysed."""
    return (prs_chunks.join(findings_per_pr, scope, "left")
            .select(*scope, F.coalesce(F.col("total"), F.lit(0)).cast("bigint").alias("total"),
                    F.col("chunks_analyzed").cast("bigint").alias("chunks_analyzed")))


def pr_outcome(prs: DataFrame, prs_chunks: DataFrame, summaries: DataFrame,
               scope: list[str] = SCOPE) -> DataFrame:
    """Per PR: ``none`` (no chunks), ``no_issues`` (fixed body) or ``summary``."""
    has_chunks = prs_chunks.select(*scope).distinct().withColumn("_chunks", F.lit(True))
    s = summaries.select(*scope, "markdown")
    out = prs.select(*scope).join(has_chunks, scope, "left").join(s, scope, "left")
    outcome = (F.when(F.col("_chunks").isNull(), F.lit("none"))
               .when(F.col("markdown").isNull(), F.lit("no_issues"))
               .otherwise(F.lit("summary")))
    body = (F.when(F.col("_chunks").isNull(), F.lit(None).cast("string"))
            .when(F.col("markdown").isNull(), F.lit(NO_ISSUES_BODY))
            .otherwise(F.col("markdown")))
    return out.select(*scope, outcome.alias("outcome"), body.alias("body"))
