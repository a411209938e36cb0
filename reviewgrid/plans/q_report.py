"""Report projections, per-PR aggregates and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..constants import DEFAULT_MARKER, NO_ISSUES_BODY, SUMMARY_FOOTER, SUMMARY_SUBTITLE, SUMMARY_TITLE
from ..functions.severity import severity_rank
from ..operators import report
from ..session import work_path
from ..sinks import store
from ..sources.events import accepted
from ..sources.fixtures import duck_with, view
from .catalog import query
from .q_chunks import DISPATCH_BODY, DISPATCH_CTES, dispatched
from .q_merge import M4_CTES, RANK_SQL, merged_findings


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EMOJI_SQL = ("case coalesce(severity, 'low') when 'critical' then '🔴' when 'high' then '🟠' "
             "when 'medium' then '🟡' when 'low' then '🔵' else '⚪' end")
SEV_LABEL_SQL = "upper(coalesce(severity, 'low'))"
CAT_LABEL_SQL = "upper(substr(coalesce(category, ''), 1, 1)) || lower(substr(coalesce(category, ''), 2))"
INLINE_BODY_SQL = (f"{EMOJI_SQL} || ' **[' || {SEV_LABEL_SQL} || '] ' || {CAT_LABEL_SQL} || '**' || chr(10) || chr(10) "
                   "|| coalesce(description, '') || chr(10) || chr(10) || '**Fix:**' || chr(10) || '```python' || chr(10) "
                   "|| coalesce(suggested_fix, '') || chr(10) || '```'")
ITEM_SQL = (f"'### ' || cast(position as varchar) || '. ' || {EMOJI_SQL} || ' `[' || {SEV_LABEL_SQL} || ']` ' || "
            f"{CAT_LABEL_SQL} || ' — `' || coalesce(file_path, '') || '` line ' || coalesce(cast(line_number as varchar), '?') "
            "|| chr(10) || chr(10) || '**Issue:** ' || coalesce(description, '') || chr(10) || chr(10) || "
            "'**Suggested Fix:**' || chr(10) || '```python' || chr(10) || coalesce(suggested_fix, '') || chr(10) || '```' "
            "|| chr(10) || chr(10) || '---' || chr(10)")
PUBLISHABLE_SQL = "coalesce(line_number > 0 and file_path <> '', false)"
MARKDOWN_SQL = (f"{_lit(SUMMARY_TITLE)} || chr(10) || {_lit(SUMMARY_SUBTITLE)} || chr(10) || '**' || cast(count(*) as varchar) "
                f"|| ' issue(s) found**, sorted by severity.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) "
                f"|| string_agg({ITEM_SQL}, chr(10) order by position) || chr(10) || {_lit(SUMMARY_FOOTER)}")
SHA_SQL = "substr(sha256(cast(pr_number as varchar)), 1, 40)"


def _findings(spark, sf_dir):
    return view(spark, sf_dir, "v_findings").drop("created_at")


@query("prj_severity_rank", "P8", oracle=duck_with("v_findings") + f"""
select repo, pr_number, seq, severity, {RANK_SQL} as rank from v_findings""")
def prj_severity_rank(spark, sf_dir):
    return _findings(spark, sf_dir).select("repo", "pr_number", "seq", "severity",
                                           severity_rank("severity").alias("rank"))


@query("prj_severity_badge", "P9", oracle=duck_with("v_findings") + f"""
select seq, {EMOJI_SQL} as emoji, {SEV_LABEL_SQL} as severity_label, {CAT_LABEL_SQL} as category_label from v_findings""")
def prj_severity_badge(spark, sf_dir):
    return report.with_badge(_findings(spark, sf_dir)).select("seq", "emoji", "severity_label", "category_label")


@query("flt_publishable", "F5", oracle=duck_with("v_findings") + f"""
select seq, file_path, line_number from v_findings where {PUBLISHABLE_SQL}""")
def flt_publishable(spark, sf_dir):
    return report.publishable(_findings(spark, sf_dir)).select("seq", "file_path", "line_number")


@query("prj_inline_body", "P10", oracle=duck_with("v_findings") + f"""
select seq, {INLINE_BODY_SQL} as body from v_findings where {PUBLISHABLE_SQL}""")
def prj_inline_body(spark, sf_dir):
    f = report.with_badge(report.publishable(_findings(spark, sf_dir)))
    return f.select("seq", report.inline_body().alias("body"))


@query("agg_markdown", "G7", oracle=M4_CTES + f"""
select repo, pr_number, cast(count(*) as bigint) as n_findings, {MARKDOWN_SQL} as markdown from m4 group by repo, pr_number""")
def agg_markdown(spark, sf_dir):
    return report.summary_markdown(merged_findings(spark, sf_dir))


def _chunk_counts(spark, sf_dir):
    return dispatched(spark, sf_dir).groupBy("repo", "pr_number").agg(
        F.count(F.lit(1)).alias("chunks_analyzed"))


_CHUNK_CTES = DISPATCH_CTES
_CHUNKS_SQL = DISPATCH_BODY


def _with_chunks_and_m4() -> str:
    m4 = M4_CTES.strip()
    assert m4.startswith("with ")
    return (_CHUNK_CTES.rstrip() + ",\nch as (" + _CHUNKS_SQL + "),\n"
            + "cc as (select repo, pr_number, count(*) as chunks_analyzed from ch group by repo, pr_number),\n"
            + m4[len("with "):] + "\n")


@query("agg_review_summary", "G6", oracle=_with_chunks_and_m4() + """
select cc.repo, cc.pr_number, cast(coalesce(f.total, 0) as bigint) as total, cast(cc.chunks_analyzed as bigint) as chunks_analyzed
from cc left join (select repo, pr_number, count(*) as total from m4 group by repo, pr_number) f
 on f.repo = cc.repo and f.pr_number = cc.pr_number""")
def agg_review_summary(spark, sf_dir):
    totals = merged_findings(spark, sf_dir).groupBy("repo", "pr_number").agg(
        F.count(F.lit(1)).alias("total"))
    return report.pr_summary(_chunk_counts(spark, sf_dir), totals)


@query("agg_pr_outcome", "G8", oracle=_with_chunks_and_m4() + f"""
, md as (select repo, pr_number, {MARKDOWN_SQL} as markdown from m4 group by repo, pr_number)
select d.repo, d.pr_number,
 case when cc.repo is null then 'none' when md.markdown is null then 'no_issues' else 'summary' end as outcome,
 case when cc.repo is null then null when md.markdown is null then {_lit(NO_ISSUES_BODY)} else md.markdown end as body
from v_diffs d left join cc on cc.repo = d.repo and cc.pr_number = d.pr_number
left join md on md.repo = d.repo and md.pr_number = d.pr_number""")
def agg_pr_outcome(spark, sf_dir):
    prs = view(spark, sf_dir, "v_diffs").select("repo", "pr_number")
    summaries = report.summary_markdown(merged_findings(spark, sf_dir))
    return report.pr_outcome(prs, _chunk_counts(spark, sf_dir), summaries)


@query("sink_inline_comments", "K3", oracle=M4_CTES + f"""
select repo, pr_number, {SHA_SQL} as commit_sha, file_path as path, line_number as line, 'RIGHT' as side,
 {INLINE_BODY_SQL} as body, position from m4 where {PUBLISHABLE_SQL}""")
def sink_inline_comments(spark, sf_dir):
    ranked = merged_findings(spark, sf_dir)
    sha = F.substring(F.sha2(F.col("pr_number").cast("string"), 256), 1, 40)
    rows = report.inline_comments(ranked, sha)
    return store.write_rows(rows, work_path(spark, "inline_comments")).select(
        "repo", "pr_number", "commit_sha", "path", "line", "side", "body", "position")


@query("sink_summary_comments", "K4", oracle=M4_CTES + f"""
select repo, pr_number, {MARKDOWN_SQL} as body from m4 group by repo, pr_number""")
def sink_summary_comments(spark, sf_dir):
    md = report.summary_markdown(merged_findings(spark, sf_dir))
    rows = md.select("repo", "pr_number", F.col("markdown").alias("body"))
    return store.write_rows(rows, work_path(spark, "summary_comments")).select("repo", "pr_number", "body")


@query("sink_replace_stale", "K5", oracle=duck_with("v_comments", "v_pr_events") + "," + M4_CTES.strip()[len("with "):] + f"""
, md as (select repo, pr_number, {MARKDOWN_SQL} as body from m4 group by repo, pr_number),
tgt as (select distinct json_extract_string(payload, '$.repository.full_name') as repo,
  cast(json_extract(payload, '$.pull_request.number') as int) as pr_number from v_pr_events
  where event = 'pull_request' and json_extract_string(payload, '$.action') = 'synchronize')
select repo, pr_number, comment_id, body from v_comments c
where not (contains(body, {_lit(DEFAULT_MARKER)}) and exists (select 1 from tgt where tgt.repo = c.repo and tgt.pr_number = c.pr_number))
union all select repo, pr_number, cast('0x' || substr(md5(concat_ws('/', 0, repo, pr_number, body)), 1, 15) as bigint) as comment_id, body
from md join tgt using (repo, pr_number)""")
def sink_replace_stale(spark, sf_dir):
    events = accepted(view(spark, sf_dir, "v_pr_events")).filter(F.col("action") == "synchronize")
    targets = events.select("repo", "pr_number").distinct()
    md = report.summary_markdown(merged_findings(spark, sf_dir))
    new = md.select("repo", "pr_number", F.col("markdown").alias("body")).join(targets, ["repo", "pr_number"], "left_semi")
    return store.replace_stale(view(spark, sf_dir, "v_comments"), new, targets, DEFAULT_MARKER, work_path(spark, "comments"))


@query("src_bot_comments", "S4", oracle=duck_with("v_comments") + f"""
select repo, pr_number, comment_id, body from v_comments where contains(body, {_lit(DEFAULT_MARKER)})""")
def src_bot_comments(spark, sf_dir):
    c = view(spark, sf_dir, "v_comments")
    return c.filter(F.col("body").contains(DEFAULT_MARKER))


RUN_TS = dt.datetime(2024, 1, 1, 0, 0, 0, tzinfo=dt.timezone.utc)
RUN_US = "epoch_us(timestamp '2024-01-01')"


def _created():
    return F.unix_micros("created_at").alias("created_us")
REVIEW_OUT = ["repo", "pr_number", "seq", "severity", "category", "file_path", "line_number",
              "description", "suggested_fix"]


@query("sink_reviews_init", "K1", oracle=duck_with("v_findings") + f"""
select {", ".join(REVIEW_OUT)}, {RUN_US} as created_us from v_findings""")
def sink_reviews_init(spark, sf_dir):
    """Init twice around an append: the second init must not clobber rows."""
    path = work_path(spark, "reviews")
    store.init_reviews(spark, path)
    store.append_reviews(_findings(spark, sf_dir), path, RUN_TS, "run-1")
    store.init_reviews(spark, path)
    return store.read_reviews(spark, path).select(*REVIEW_OUT, _created())


@query("sink_reviews_append", "K2", oracle=duck_with("v_findings") + f"""
select {", ".join(REVIEW_OUT)}, {RUN_US} as created_us, run_id from (select *, 'run-1' as run_id from v_findings
 union all select *, 'run-2' as run_id from v_findings) t""")
def sink_reviews_append(spark, sf_dir):
    """A re-review adds a run; writing a run twice (a replay) leaves it once."""
    path = work_path(spark, "reviews")
    store.init_reviews(spark, path)
    f = _findings(spark, sf_dir)
    store.append_reviews(f, path, RUN_TS, "run-1")
    store.append_reviews(f, path, RUN_TS, "run-2")
    store.append_reviews(f, path, RUN_TS, "run-2")
    return store.read_reviews(spark, path).select(*REVIEW_OUT, _created(), "run_id")


@query("src_reviews", "S6", oracle=duck_with("v_findings") + f"""
select {", ".join(c for c in REVIEW_OUT if c != "seq")}, {RUN_US} as created_us from v_findings""")
def src_reviews(spark, sf_dir):
    """Stored findings as the dashboard reads them (written once, read with the fixed schema)."""
    path = work_path(spark, "reviews")
    store.append_reviews(_findings(spark, sf_dir), path, RUN_TS, "run-1")
    return store.read_reviews(spark, path).select(*[c for c in REVIEW_OUT if c != "seq"], _created())
