"""M1-M4 over V_findings (reviewer = seq % 3: security, performance, style)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AGENTS
from ..functions.severity import severity_rank
from ..operators import merge
from ..operators.ordering import position_within
from ..sources.fixtures import duck_with, view
from .catalog import query

RANK_SQL = ("case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 "
            "when 'low' then 3 else 3 end")
AGENT_SQL = "case seq % 3 when 0 then 'security' when 1 then 'performance' else 'style' end"
OUT = ["repo", "pr_number", "file_path", "line_number", "category", "severity",
       "description", "suggested_fix"]


def _with_agents(spark, sf_dir):
    f = view(spark, sf_dir, "v_findings").drop("created_at").withColumnRenamed("seq", "item_seq")
    agents = F.array(*[F.lit(a) for a in AGENTS])
    return f.withColumn("agent", F.element_at(agents, (F.col("item_seq") % 3 + 1).cast("int")))


@query("mrg_union", "M1", oracle=duck_with("v_findings") + f"""
select repo, pr_number, {AGENT_SQL} as agent, cast(seq % 3 as int) as agent_ord, seq as item_seq,
 file_path, line_number, category, severity, description, suggested_fix from v_findings""")
def mrg_union(spark, sf_dir):
    ordered = merge.order_findings(_with_agents(spark, sf_dir), ["item_seq"])
    return ordered.select(*OUT, "agent", "agent_ord", "item_seq")


@query("mrg_dedup", "M2", oracle=duck_with("v_findings") + f"""
, r as (select *, {RANK_SQL} as rank from v_findings)
select {", ".join(OUT)}, seq, rank, first_seq from (
 select *, row_number() over (partition by repo, pr_number, file_path, line_number, category order by rank, seq) as rn,
  min(seq) over (partition by repo, pr_number, file_path, line_number, category) as first_seq from r) t
where rn = 1""")
def mrg_dedup(spark, sf_dir):
    f = view(spark, sf_dir, "v_findings").drop("created_at")
    return merge.dedup(f, order_col="seq").select(*OUT, "seq", "rank", "first_seq")


_PRIORITISE_SQL = duck_with("v_findings") + f"""
, r as (select *, {RANK_SQL} as rank from v_findings),
s as (select * from (
 select *, row_number() over (partition by repo, pr_number, file_path, line_number, category order by rank, seq) as rn,
  min(seq) over (partition by repo, pr_number, file_path, line_number, category) as first_seq from r) t where rn = 1)
select {", ".join(OUT)}, seq, rank, first_seq,
 cast(row_number() over (partition by repo, pr_number order by rank, first_seq) as int) as position from s"""


@query("mrg_prioritise", "M3", oracle=_PRIORITISE_SQL)
def mrg_prioritise(spark, sf_dir):
    f = view(spark, sf_dir, "v_findings").drop("created_at")
    return merge.prioritise(merge.dedup(f, order_col="seq")).select(
        *OUT, "seq", "rank", "first_seq", "position")


M4_CTES = duck_with("v_findings") + f"""
, a as (select *, {AGENT_SQL} as agent, cast(seq % 3 as int) as agent_ord, {RANK_SQL} as rank from v_findings),
k as (select *, row_number() over (partition by repo, pr_number, file_path, line_number, category order by rank, agent_ord, seq) as rn,
  first_value(agent_ord) over (partition by repo, pr_number, file_path, line_number, category order by agent_ord, seq) as f_agent,
  first_value(seq) over (partition by repo, pr_number, file_path, line_number, category order by agent_ord, seq) as f_seq from a),
s as (select * from k where rn = 1),
m4 as (select {", ".join(OUT)}, agent, rank,
 cast(row_number() over (partition by repo, pr_number order by rank, f_agent, f_seq) as int) as position from s)
"""
REVIEW_SQL = M4_CTES + "select * from m4"


def merged_findings(spark, sf_dir):
    """M4 over V_findings; also the input of the report queries."""
    ordered = merge.order_findings(_with_agents(spark, sf_dir), ["item_seq"])
    return merge.prioritise(merge.dedup(ordered))


@query("mrg_review", "M4", oracle=REVIEW_SQL)
def mrg_review(spark, sf_dir):
    return merged_findings(spark, sf_dir).select(*OUT, "agent", "rank", "position")


HOT_SQL = duck_with("v_findings") + f"""
, h as (select case when seq % 3 = 0 then 'org/hot' else repo end as repo, case when seq % 3 = 0 then 1 else pr_number end as pr_number,
  seq, {RANK_SQL} as rank, case when seq % 5 = 0 then null else file_path end as file_path from v_findings)
select repo, cast(pr_number as int) as pr_number, seq, rank, file_path,
 cast(row_number() over (partition by repo, pr_number order by rank, file_path nulls first, seq) as int) as position from h"""


@query("mrg_hot_pr", "M3", oracle=HOT_SQL)
def mrg_hot_pr(spark, sf_dir):
    """Positions where one PR holds a third of all findings and an order key is partly null."""
    f = view(spark, sf_dir, "v_findings").drop("created_at").withColumn("rank", severity_rank("severity"))
    hot = F.col("seq") % 3 == 0
    f = f.select(F.when(hot, "org/hot").otherwise(F.col("repo")).alias("repo"),
                 F.when(hot, 1).otherwise(F.col("pr_number")).cast("int").alias("pr_number"), "seq", "rank",
                 F.when(F.col("seq") % 5 != 0, F.col("file_path")).alias("file_path"))
    return position_within(f, ["repo", "pr_number"], ["rank", "file_path", "seq"])
