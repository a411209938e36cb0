"""Event intake and small sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.signature import signature_header, signature_ok
from ..operators.ordering import position_within
from ..sources import events as ev
from ..sources.fixtures import FIXTURE_SECRET, _IPAD, _OPAD, duck_with, view
from .catalog import query

HMAC_SQL = (f"'sha256=' || sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(payload))))")
FIELDS_SQL = """json_extract_string(payload, '$.action') as action,
 json_extract_string(payload, '$.repository.full_name') as repo,
 cast(json_extract(payload, '$.pull_request.number') as int) as pr_number,
 json_extract_string(payload, '$.pull_request.head.sha') as commit_sha"""


@query("src_pr_events", "S1", oracle=duck_with("v_pr_events") + """
select delivery_id, event, signature, payload, epoch_us(received_at) as received_us from v_pr_events""")
def src_pr_events(spark, sf_dir):
    e = view(spark, sf_dir, "v_pr_events")
    typed = e.select(*[F.col(f.name).cast(f.dataType) for f in ev.EVENT_SCHEMA.fields])
    return typed.select("delivery_id", "event", "signature", "payload",
                        F.unix_micros("received_at").alias("received_us"))


@query("prj_event_fields", "P1", oracle=duck_with("v_pr_events") + f"""
select delivery_id, {FIELDS_SQL} from v_pr_events""")
def prj_event_fields(spark, sf_dir):
    e = ev.event_fields(view(spark, sf_dir, "v_pr_events"))
    return e.select("delivery_id", "action", "repo", "pr_number", "commit_sha")


@query("flt_pr_event", "F1", oracle=duck_with("v_pr_events") + f"""
select delivery_id, {FIELDS_SQL} from v_pr_events
where event = 'pull_request' and json_extract_string(payload, '$.action') in ('opened', 'synchronize', 'reopened')""")
def flt_pr_event(spark, sf_dir):
    e = ev.accepted(view(spark, sf_dir, "v_pr_events"))
    return e.select("delivery_id", "action", "repo", "pr_number", "commit_sha")


@query("flt_signature", "F2", oracle=duck_with("v_pr_events") + f"""
select delivery_id from v_pr_events where signature = {HMAC_SQL}""")
def flt_signature(spark, sf_dir):
    return ev.verified(view(spark, sf_dir, "v_pr_events"), FIXTURE_SECRET).select("delivery_id")


@query("prj_signature_hex", "P11", oracle=duck_with("v_pr_events") + f"""
select delivery_id, {HMAC_SQL} as expected, signature = {HMAC_SQL} as valid from v_pr_events""")
def prj_signature_hex(spark, sf_dir):
    e = view(spark, sf_dir, "v_pr_events")
    return e.select("delivery_id", signature_header(F.col("payload"), FIXTURE_SECRET).alias("expected"),
                    signature_ok(F.col("payload"), F.col("signature"), FIXTURE_SECRET).alias("valid"))


@query("src_diffs", "S2", oracle=duck_with("v_diffs") + """
select repo, pr_number, commit_sha, diff from v_diffs""")
def src_diffs(spark, sf_dir):
    return view(spark, sf_dir, "v_diffs").select("repo", "pr_number", "commit_sha", "diff")


@query("src_commits", "S3", oracle=duck_with("v_commits") + """
select repo, pr_number, sha, cast(row_number() over (partition by repo, pr_number order by committed_at, sha) as int) as commit_ord
from v_commits""")
def src_commits(spark, sf_dir):
    c = view(spark, sf_dir, "v_commits")
    ranked = position_within(c, ["repo", "pr_number"], [F.col("committed_at"), F.col("sha")], name="commit_ord")
    return ranked.select("repo", "pr_number", "sha", "commit_ord")

