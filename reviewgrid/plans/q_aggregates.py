"""G1-G5 over the stored findings (V_findings) and chunk metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators.chunkers import toplevel_chunks
from ..sources.fixtures import duck_with, view
from . import duck_chunks as D
from .catalog import query
from .q_chunks import K, _w, sources_a

G1_SQL = """select severity, category, count(*) as count from v_findings group by severity, category"""


@query("agg_sev_cat", "G1", oracle=duck_with("v_findings") + G1_SQL)
def agg_sev_cat(spark, sf_dir):
    return agg.severity_category_counts(view(spark, sf_dir, "v_findings"))


@query("agg_by_severity", "G2", oracle=duck_with("v_findings") + f"""
, g as ({G1_SQL}),
dom as (select * from (values ('critical', 0), ('high', 1), ('medium', 2), ('low', 3)) t(severity, rank))
select dom.severity, cast(dom.rank as int) as rank, cast(coalesce(sum(g.count), 0) as bigint) as count
from dom left join g on g.severity = dom.severity group by dom.severity, dom.rank""")
def agg_by_severity(spark, sf_dir):
    return agg.by_severity(agg.severity_category_counts(view(spark, sf_dir, "v_findings")))


@query("agg_by_category", "G3", oracle=duck_with("v_findings") + f"""
, g as ({G1_SQL}),
c as (select category, cast(sum(count) as bigint) as count from g group by category),
f as (select * from c union all
      select category, cast(0 as bigint) from (values ('security'), ('performance'), ('style')) t(category)
      where not exists (select 1 from c))
select category, count, case when sum(count) over () > 0 then count / sum(count) over () else 0.0 end as share from f""")
def agg_by_category(spark, sf_dir):
    return agg.by_category(agg.severity_category_counts(view(spark, sf_dir, "v_findings")))


@query("agg_kpis", "G4", oracle=duck_with("v_findings") + f"""
, g as ({G1_SQL})
select cast(coalesce(sum(case when severity in ('critical','high','medium','low') then count end), 0) as bigint) as total,
 cast(coalesce(sum(case when severity in ('critical','high') then count end), 0) as bigint) as critical_high,
 cast(coalesce(sum(case when category = 'security' then count end), 0) as bigint) as security,
 cast(coalesce(sum(case when category = 'performance' then count end), 0) as bigint) as performance from g""")
def agg_kpis(spark, sf_dir):
    return agg.kpis(agg.severity_category_counts(view(spark, sf_dir, "v_findings")))


LOG_CTES = _w(D.LINES, D.SECTIONS_A, D.TOPLEVEL) + r""", log as (
 select t.repo, t.pr_number, t.commit_sha, t.file_ord, t.chunk_ord, t.file_path,
  case when regexp_extract(t.head, '^(?:async\s+)?(?:def|class)\s+(\w+)', 1) = '' then 'unknown'
       else regexp_extract(t.head, '^(?:async\s+)?(?:def|class)\s+(\w+)', 1) end as name,
  cast(len(regexp_extract_all(s.source, '[^\s\x1c-\x1f]+')) as int) as original_tokens,
  cast(len(regexp_extract_all(t.content, '[^\s\x1c-\x1f]+')) as int) as chunk_tokens
 from topcc t join src s using (repo, pr_number, commit_sha, file_ord) where ends_with(t.file_path, '.py'))
"""
REDUCTION_SQL = "round_even((1 - chunk_tokens / greatest(original_tokens, 1)) * 100, 1)"


def _chunk_rows(spark, sf_dir):
    """The chunk log: file, name, tokens and reduction of every top-level chunk."""
    chunks = toplevel_chunks(sources_a(spark, sf_dir).filter(F.col("file_path").endswith(".py")))
    return chunks.select(*K, "file_ord", "chunk_ord", "file_path", "name", "original_tokens", "chunk_tokens", "reduction_pct")


@query("prj_reduction_pct", "P7", oracle=LOG_CTES + f"""
select repo, pr_number, commit_sha, file_ord, chunk_ord, file_path, name, original_tokens, chunk_tokens,
 {REDUCTION_SQL} as reduction_pct from log""")
def prj_reduction_pct(spark, sf_dir):
    return _chunk_rows(spark, sf_dir)


@query("agg_chunk_log", "G5", oracle=LOG_CTES + f"""
, r as (select {REDUCTION_SQL} as reduction_pct from log)
select count(*) as total_chunks, round_even(avg(reduction_pct), 1) as average_token_reduction_pct,
 cast(95 as int) as target_pct, round_even(avg(reduction_pct), 1) >= 95 as target_met from r""")
def agg_chunk_log(spark, sf_dir):
    return agg.chunk_log(_chunk_rows(spark, sf_dir))
