"""Streaming queries (T1-T4): run with ``availableNow`` on fixture files and read the sink back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DEFAULT_MARKER, NO_ISSUES_BODY
from ..session import work_path
from ..sinks.diff_store import DiffStore
from ..sinks.store import current_comments, read_reviews
from ..sources.events import EVENT_SCHEMA, intake
from ..sources.fixtures import DUCK, FIXTURE_SECRET, duck_with, view
from ..streaming import review_stream as rs
from ..streaming.pr_order import newest_events
from .catalog import query
from .q_events import FIELDS_SQL, HMAC_SQL
from .q_report import MARKDOWN_SQL, PUBLISHABLE_SQL, _lit

ACCEPTED_SQL = duck_with("v_pr_events") + f"""
, acc as (select delivery_id, received_at, {FIELDS_SQL} from v_pr_events
  where signature = {HMAC_SQL} and event = 'pull_request'
    and json_extract_string(payload, '$.action') in ('opened', 'synchronize', 'reopened'))
"""


def _event_files(spark, sf_dir, base):
    src = f"{base}/events"
    ev = view(spark, sf_dir, "v_pr_events").select(*[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA.fields])
    ev.repartition(4, "delivery_id").write.mode("overwrite").parquet(src)
    return src


@query("str_pr_stream", "T1", oracle=ACCEPTED_SQL + "select delivery_id, action, repo, pr_number, commit_sha from acc")
def str_pr_stream(spark, sf_dir):
    base = work_path(spark, "stream_intake")
    src = _event_files(spark, sf_dir, base)
    rs.start_intake(spark, src, f"{base}/sink", f"{base}/checkpoint", FIXTURE_SECRET)
    return spark.read.parquet(f"{base}/sink").select("delivery_id", "action", "repo", "pr_number", "commit_sha")


def _review_ctes() -> str:
    """CTEs: accepted events, the review of every diff revision (rvw), its chunks (ch) and markdown (md)."""
    from .q_reviewers import _review_sql
    acc = ACCEPTED_SQL.strip()
    body = _review_sql()
    body = body.replace("with ", "with " + acc[len("with "):].rstrip() + ",\n", 1)
    head, final = body.rsplit("\nselect repo, pr_number, commit_sha,", 1)
    return head.rstrip() + f""",
rvw as (select repo, pr_number, commit_sha,{final}),
md as (select repo, pr_number, commit_sha, {MARKDOWN_SQL} as markdown from rvw group by repo, pr_number, commit_sha),
done as (select distinct repo, pr_number, commit_sha from ch)"""


def _latest(batch: str) -> str:
    return f"""lat as (select * exclude (rn) from (select *, {batch} as b, row_number() over (
  partition by repo, pr_number, {batch} order by received_at desc, delivery_id desc) as rn from acc) t where rn = 1)"""


def _streamed(spark, sf_dir, batches, store=False):
    """Run the review stream over the events, one micro-batch per filter; returns the sink folder."""
    base = work_path(spark, "stream_review")
    ev = view(spark, sf_dir, "v_pr_events").select(*[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA.fields])
    diffs = view(spark, sf_dir, "v_diffs")
    if store:
        kept = DiffStore(f"{base}/diffs", buckets=16)
        kept.append(diffs)
        diffs = kept
    for keep in batches:
        ev.filter(keep).write.mode("append").parquet(f"{base}/events")
        rs.start_review(spark, f"{base}/events", diffs, f"{base}/sink", f"{base}/checkpoint", FIXTURE_SECRET)
    return f"{base}/sink"


def _deliveries(spark, sf_dir, batch):
    """Events of one of three micro-batches: dealt out of order, every fourth delivered again later."""
    ev = view(spark, sf_dir, "v_pr_events")
    dealt = F.col("delivery_id") * 7 % 3
    again = ev.filter((F.col("delivery_id") % 4 == 0) & (dealt < 2)).withColumn(
        "received_at", F.col("received_at") + F.expr("interval 1 hour")).filter(dealt + 1 == batch)
    rows = ev.filter(dealt == batch).unionByName(again)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA.fields])


#: Longer than the time span of the fixture, so that no delivery is late.
QUERY_HORIZON = "400 days"


@query("str_ordered", "T3", oracle=ACCEPTED_SQL.rstrip() + """,
b as (select *, delivery_id * 7 % 3 as b from acc),
n as (select *, row_number() over (partition by repo, pr_number, b order by received_at desc, delivery_id desc) as rn from b)
select repo, pr_number, delivery_id, action, commit_sha from n where rn = 1 and not exists (select 1 from b o
  where o.repo = n.repo and o.pr_number = n.pr_number and o.b < n.b and (o.received_at, o.delivery_id) > (n.received_at, n.delivery_id))""")
def str_ordered(spark, sf_dir):
    """The events that call for a review over three micro-batches with late and repeated deliveries."""
    base = work_path(spark, "stream_ordered")
    for batch in range(3):
        _deliveries(spark, sf_dir, batch).write.mode("append").parquet(f"{base}/events")
        new = newest_events(intake(rs.event_stream(spark, f"{base}/events"), FIXTURE_SECRET), QUERY_HORIZON)
        rs._run(new.writeStream.format("parquet").option("path", f"{base}/sink")
                .option("checkpointLocation", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/sink").select("repo", "pr_number", "delivery_id", "action", "commit_sha")


@query("str_rereview", "T3", oracle=_review_ctes() + ",\n" + _latest("delivery_id % 2") + f"""
, post as (select l.repo, l.pr_number, l.b, coalesce(md.markdown, {_lit(NO_ISSUES_BODY)}) as body from lat l
  join done using (repo, pr_number, commit_sha) left join md using (repo, pr_number, commit_sha)),
every as (select repo, pr_number, comment_id, body, -1 as b from ({DUCK["v_comments"]})
 union all select repo, pr_number, cast('0x' || substr(md5(concat_ws('/', b, repo, pr_number, body)), 1, 15) as bigint), body, b from post),
gone as (select repo, pr_number, max(b) as last from lat where action = 'synchronize' group by repo, pr_number)
select e.repo, e.pr_number, comment_id, body from every e left join gone g on g.repo = e.repo and g.pr_number = e.pr_number
where not coalesce(contains(body, {_lit(DEFAULT_MARKER)}) and g.last > e.b, false)""")
def str_rereview(spark, sf_dir):
    """The comments table after two micro-batches (even, then odd deliveries)."""
    sink = _streamed(spark, sf_dir, [F.col("delivery_id") % 2 == k for k in (0, 1)])
    return current_comments(view(spark, sf_dir, "v_comments"), f"{sink}/comments", DEFAULT_MARKER, f"{sink}/commits")


@query("str_latest", "T3", oracle=ACCEPTED_SQL.rstrip() + ",\n" + _latest("0") + """
select repo, pr_number, delivery_id, action, commit_sha from lat""")
def str_latest(spark, sf_dir):
    """The event of each PR that counts in a batch."""
    return rs.latest_per_pr(intake(view(spark, sf_dir, "v_pr_events"), FIXTURE_SECRET)).select(
        "repo", "pr_number", "delivery_id", "action", "commit_sha")


@query("str_review", "T2", oracle=_review_ctes() + ",\n" + _latest("0") + """
select cast(0 as int) as batch_id, rvw.* from rvw where exists (select 1 from lat where lat.repo = rvw.repo
  and lat.pr_number = rvw.pr_number and lat.commit_sha = rvw.commit_sha)""")
def str_review(spark, sf_dir):
    return spark.read.parquet(f"{_streamed(spark, sf_dir, [F.lit(True)])}/findings")


@query("str_review_store", "T2", oracle=_review_ctes() + ",\n" + _latest("delivery_id % 2") + """
select cast(lat.b as int) as batch_id, rvw.* from rvw join lat using (repo, pr_number, commit_sha)""")
def str_review_store(spark, sf_dir):
    """The findings of two micro-batches (even, then odd deliveries) over a bucketed diff store."""
    sink = _streamed(spark, sf_dir, [F.col("delivery_id") % 2 == k for k in (0, 1)], store=True)
    return spark.read.parquet(f"{sink}/findings")


@query("str_review_sinks", "T2", oracle=_review_ctes() + ",\n" + _latest("0") + f"""
, n as (select repo, pr_number, commit_sha, count(*) as n_reviews, count(*) filter ({PUBLISHABLE_SQL}) as n_inline from rvw group by all)
select repo, pr_number, commit_sha,
 case when d.repo is null then 'none' when md.markdown is null then 'no_issues' else 'summary' end as outcome,
 case when d.repo is null then null else coalesce(md.markdown, {_lit(NO_ISSUES_BODY)}) end as body,
 coalesce(n_reviews, 0) as n_reviews, coalesce(n_inline, 0) as n_inline
from lat left join done d using (repo, pr_number, commit_sha) left join md using (repo, pr_number, commit_sha)
left join n using (repo, pr_number, commit_sha)""")
def str_review_sinks(spark, sf_dir):
    """What T2 left in the reviews, inline and outcome tables, per PR."""
    sink = _streamed(spark, sf_dir, [F.lit(True)])
    reviews = read_reviews(spark, f"{sink}/reviews", commits=f"{sink}/commits").groupBy("repo", "pr_number").agg(F.count(F.lit(1)).alias("n_reviews"))
    inline = spark.read.parquet(f"{sink}/inline").groupBy("repo", "pr_number").agg(F.count(F.lit(1)).alias("n_inline"))
    out = spark.read.parquet(f"{sink}/outcome").drop("batch_id")
    return (out.join(reviews, ["repo", "pr_number"], "left").join(inline, ["repo", "pr_number"], "left")
            .select("repo", "pr_number", "commit_sha", "outcome", "body", F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"),
                    F.coalesce("n_inline", F.lit(0)).alias("n_inline")))


@query("str_quarantine", "T4", oracle=duck_with("v_responses") + r"""
, w as (select *, '[' || response || ']' as t from v_responses),
p as (select *, case when json_valid(t) and json_array_length(t) = 1 and trim(response) <> ''
                     then json_extract(t, '$[0]') end as v from w),
c as (select *, case
   when v is null then 'error'
   when json_type(v) = 'OBJECT' and len(json_keys(v)) = 0 then 'none'
   when v::varchar = '""' then 'none'
   when json_type(v) <> 'ARRAY' then 'error'
   when exists (select 1 from unnest(json_extract(v, '$[*]')) e(x) where json_type(x) <> 'OBJECT') then 'error'
   else 'rows' end as status from p)
select call_id, agent, file_path, 'response is not a JSON array of findings' as reason from c where status = 'error'""")
def str_quarantine(spark, sf_dir):
    base = work_path(spark, "stream_quarantine")
    src = f"{base}/responses"
    view(spark, sf_dir, "v_responses").repartition(4, "call_id").write.mode("overwrite").parquet(src)
    rs.start_quarantine(spark, src, f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink/review_errors").select("call_id", "agent", "file_path", "reason")
