"""Reviewer queries (A1-A7, P15) and the end-to-end review of diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, reviewers as rv, sections
from ..operators.call_ledger import ledger_calls
from ..operators.diff_lines import split_lines
from ..operators.parallel import spread
from ..session import work_path, written
from ..sources.fixtures import duck_with, view
from ..sources.tables import table
from . import duck_chunks as D
from ..operators.retrieval import with_prompt
from .catalog import query
from .q_chunks import DISPATCH_BODY, DISPATCH_CTES, K, dispatched, sources_a
from .q_merge import M4_CTES


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RULES_VALUES = ", ".join(
    f"({_lit(r)}, {_lit(a)}, {_lit(s)}, {_lit(p)}, {_lit(d)})" for r, a, s, p, d in rv.LINE_RULES)
SK = "repo, pr_number, commit_sha, file_ord"


def _rules_cte() -> str:
    return f"rules(rule_id, agent, severity, pattern, description) as (values {RULES_VALUES})"


@query("rev_rules_line", "A5", oracle=DISPATCH_CTES.rstrip() + ",\n" + _rules_cte() + f"""
select l.repo, l.pr_number, l.commit_sha, l.file_ord, l.file_path, l.line_no,
 r.rule_id, r.agent, r.severity, r.agent as category, r.description
from cl2 l join rules r on regexp_matches(l.line, r.pattern)""")
def rev_rules_line(spark, sf_dir):
    lines = sections.chunk_lines(sources_a(spark, sf_dir))
    hits = rv.line_rule_hits(lines)
    return hits.drop("line")


@query("rev_rules_docs", "A5", oracle="with " + _rules_cte() + """,
dl as (select doc_id, case when l[-1] = '' then l[1:len(l)-1] else l end as lines
       from (select doc_id, string_split(text, chr(10)) as l from documents) x),
ln as (select doc_id, unnest(lines) as line, cast(unnest(range(1, len(lines) + 1)) as int) as line_no from dl)
select l.doc_id, l.line_no, r.rule_id, r.agent, r.severity, r.agent as category, r.description
from ln l join rules r on regexp_matches(l.line, r.pattern)""")
def rev_rules_docs(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    lines = docs.select("doc_id", F.posexplode_outer(split_lines("text")).alias("line_no", "line")) \
        .filter(F.col("line_no").isNotNull()).withColumn("line_no", (F.col("line_no") + 1).cast("int"))
    return rv.line_rule_hits(lines).drop("line")


_SIG = r"(regexp_matches(line, '[^\s\x1c-\x1f]') and not starts_with(line, '#'))"
_CLOSER = r"regexp_matches(s.line, '^[ \t\f]*[)\]}]')"


def _blocks_cte(name: str, opener: str) -> str:
    return rf"""
{name}o as (select * from bsig where regexp_matches(line, '{opener}')),
{name}t as (select o.repo, o.pr_number, o.commit_sha, o.file_ord, o.file_path, o.line_no as start_line, o.line as head,
              min(s.line_no) as term
            from {name}o o left join bsig s on {D.kj('o', 's', 'file_ord')} and s.line_no > o.line_no
              and s.ind <= o.ind and not {_CLOSER}
            group by all),
{name} as (select t.repo, t.pr_number, t.commit_sha, t.file_ord, t.file_path, t.start_line, t.head,
             max(s.line_no) as end_line
           from {name}t t join bsig s on {D.kj('t', 's', 'file_ord')} and s.line_no >= t.start_line
             and (t.term is null or s.line_no < t.term)
           group by all)"""


BLOCK_PART = rf"""
bsig as (select *, length(regexp_extract(line, '^[ \t\f]*', 0)) as ind from cl2 where {_SIG}),
{_blocks_cte('loops', r'^[ \t\f]*(async\s+)?(for|while)\b')},
{_blocks_cte('defs', r'^[ \t\f]*(async\s+)?def\s')},
r9 as (select distinct b.repo, b.pr_number, b.commit_sha, b.file_ord, b.start_line as line_no, 'R9' as rule_id
       from loops b join cl2 l on {D.kj('b', 'l', 'file_ord')} and l.line_no > b.start_line and l.line_no <= b.end_line
       where regexp_matches(l.line, '{rv.QUERY_CALL}')),
dep as (select b.repo, b.pr_number, b.commit_sha, b.file_ord, b.start_line,
          1 + count(o.start_line) as depth
        from loops b left join loops o on {D.kj('b', 'o', 'file_ord')} and o.start_line < b.start_line
          and o.end_line >= b.start_line
        group by all),
r10 as (select repo, pr_number, commit_sha, file_ord, start_line as line_no,
          case when depth >= 3 then 'R10deep' else 'R10' end as rule_id from dep where depth >= 2),
calls as (select b.repo, b.pr_number, b.commit_sha, b.file_ord, b.start_line,
            unnest(regexp_extract_all(l.line, '{rv.CALL_TEXT}')) as call
          from loops b join cl2 l on {D.kj('b', 'l', 'file_ord')} and l.line_no > b.start_line and l.line_no <= b.end_line),
r11 as (select repo, pr_number, commit_sha, file_ord, start_line as line_no, 'R11' as rule_id from calls
        group by all having count(*) > count(distinct call)),
r17 as (select repo, pr_number, commit_sha, file_ord, start_line as line_no, 'R17' as rule_id from defs
        where end_line - start_line + 1 > {rv.LONG_FUNCTION_LINES}),
se as (select d.repo, d.pr_number, d.commit_sha, d.file_ord, d.start_line, d.end_line, d.head, min(s.line_no) as se_line
       from defs d left join bsig s on {D.kj('d', 's', 'file_ord')} and s.line_no >= d.start_line
         and s.line_no <= d.end_line and regexp_matches(s.line, ':\s*(#.*)?$')
       group by all),
doc as (select e.repo, e.pr_number, e.commit_sha, e.file_ord, e.start_line, e.head, e.se_line,
          (select s.line from bsig s where {D.kj('s', 'e', 'file_ord')} and s.line_no > e.se_line
             and s.line_no <= e.end_line order by s.line_no limit 1) as doc_line
        from se e),
r18 as (select repo, pr_number, commit_sha, file_ord, start_line as line_no, 'R18' as rule_id from doc
        where not starts_with(regexp_extract(head, '^[ \t\f]*(?:async\s+)?def\s+(\w+)', 1), '_')
          and not coalesce(se_line is not null and regexp_matches(doc_line, '^[ \t\f]*[rRuUbBfF]*[\x22\x27]'), false)),
hits as (select * from r9 union all select * from r10 union all select * from r11
         union all select * from r17 union all select * from r18),
meta(rule_id, agent, severity, description) as (values
  {", ".join(f"({_lit(r)}, {_lit(a)}, {_lit(s)}, {_lit(d)})" for r, a, s, d in rv.BLOCK_RULES)},
  ('R10deep', 'performance', {_lit(rv.DEEP_LOOP_SEVERITY)}, {_lit(dict((r, d) for r, _, _, d in rv.BLOCK_RULES)['R10'])}))
select h.repo, h.pr_number, h.commit_sha, h.file_ord, cast(h.line_no as int) as line_no,
 case when h.rule_id = 'R10deep' then 'R10' else h.rule_id end as rule_id,
 m.agent, m.severity, m.agent as category, m.description
from hits h join meta m on m.rule_id = h.rule_id"""
BLOCK_SQL = DISPATCH_CTES.rstrip() + ",\n" + BLOCK_PART.strip()


@query("rev_rules_block", "A6", oracle=BLOCK_SQL)
def rev_rules_block(spark, sf_dir):
    return rv.block_rule_hits(sources_a(spark, sf_dir), K + ["file_ord"])


CK = "repo, pr_number, commit_sha, file_ord, chunk_ord"


@query("rev_fanout", "A1", oracle=DISPATCH_CTES.rstrip() + ",\nch as (" + DISPATCH_BODY + f""")
select {CK}, a.agent, a.agent_ord from ch cross join
 (values ('security', 0), ('performance', 1), ('style', 2)) a(agent, agent_ord)""")
def rev_fanout(spark, sf_dir):
    return rv.fanout(dispatched(spark, sf_dir)).select(*CK.split(", "), "agent", "agent_ord")


def offline_scorer(agent: str, file_path: str, prompt: str) -> str:
    """A stand-in for a hosted model: deterministic JSON from simple cues in the prompt's code."""
    import json
    code = prompt.split("```python\n", 1)[1].rsplit("\n```", 1)[0]
    items = []
    for i, line in enumerate(code.split("\n"), 1):
        if agent == "security" and "execute(" in line and '" +' in line:
            items.append({"line_number": i, "severity": "critical", "category": "security",
                          "description": "query built by concatenation", "suggested_fix": "use parameters"})
        if agent == "performance" and line.lstrip().startswith("for ") and line.startswith(" "):
            items.append({"line_number": i, "severity": "medium", "category": "performance",
                          "description": "loop inside a block", "suggested_fix": "batch it"})
    return json.dumps(items)


def _item_sql(severity: str, category: str, description: str, fix: str) -> str:
    return ("'{\"line_number\": ' || line_no || ', \"severity\": \"" + severity + "\", \"category\": \"" + category
            + "\", \"description\": \"" + description + "\", \"suggested_fix\": \"" + fix + "\"}'")


MODEL_CALL_SQL = DISPATCH_CTES.rstrip() + ",\nch as (" + DISPATCH_BODY + f"""),
ln as (select {CK}, unnest(string_split(content, chr(10))) as line,
  unnest(range(1, len(string_split(content, chr(10))) + 1)) as line_no from ch),
it as (select {CK}, line_no, 'security' as agent, {_item_sql("critical", "security", "query built by concatenation", "use parameters")} as j
  from ln where contains(line, 'execute(') and contains(line, '" +')
  union all select {CK}, line_no, 'performance', {_item_sql("medium", "performance", "loop inside a block", "batch it")}
  from ln where regexp_matches(line, '^ \\s*for ')),
js as (select {CK}, agent, string_agg(j, ', ' order by line_no) as items from it group by all)
select {CK}, a.agent, '[' || coalesce(items, '') || ']' as response, cast(null as varchar) as error
from ch cross join (values ('security'), ('performance'), ('style')) a(agent)
left join js using ({CK}, agent)"""


@query("rev_model_call", "A2", oracle=MODEL_CALL_SQL)
def rev_model_call(spark, sf_dir):
    tasks = rv.fanout(with_prompt(dispatched(spark, sf_dir))).select(*CK.split(", "), "file_path", "agent", "prompt")
    calls = rv.model_calls(tasks, offline_scorer, concurrency=spark.sparkContext.defaultParallelism)
    return calls.select(*CK.split(", "), "agent", "response", "error")


@query("rev_call_ledger", "A2", oracle=MODEL_CALL_SQL)
def rev_call_ledger(spark, sf_dir):
    """The same calls in two runs over one ledger: the second asks only what the first did not."""
    tasks = written(rv.fanout(with_prompt(dispatched(spark, sf_dir))).select(*CK.split(", "), "file_path", "agent", "prompt"), "tasks")
    path = work_path(spark, "ledger")
    ledger_calls(tasks.filter(F.col("pr_number") % 2 == 0), offline_scorer, path, "first", slice_rows=2_000)
    calls = ledger_calls(tasks, offline_scorer, path, "second", slice_rows=2_000)
    return calls.select(*CK.split(", "), "agent", "response", "error")


RESP_CTES = duck_with("v_responses") + r""",
w as (select *, '[' || response || ']' as t from v_responses),
p as (select *, case when json_valid(t) and json_array_length(t) = 1 and trim(response) <> ''
                     then json_extract(t, '$[0]') end as v from w),
c as (select *, case
   when v is null then 'error'
   when json_type(v) = 'OBJECT' and json_v_keys = 0 then 'none'
   when v::varchar = '""' then 'none'
   when json_type(v) <> 'ARRAY' then 'error'
   when exists (select 1 from unnest(json_extract(v, '$[*]')) e(x) where json_type(x) <> 'OBJECT') then 'error'
   else 'rows' end as status
 from (select *, case when json_type(v) = 'OBJECT' then len(json_keys(v)) end as json_v_keys from p) q),
items as (select call_id, file_path, agent, unnest(json_extract(v, '$[*]')) as it,
            unnest(range(cast(json_array_length(v) as bigint))) as item_ord from c where status = 'rows')
"""


@query("rev_parse_response", "A3", oracle=RESP_CTES + """
select call_id, cast(item_ord as int) as item_ord, file_path,
 try_cast(json_extract_string(it, '$.line_number') as int) as line_number,
 json_extract_string(it, '$.severity') as severity, json_extract_string(it, '$.category') as category,
 json_extract_string(it, '$.description') as description, json_extract_string(it, '$.suggested_fix') as suggested_fix
from items""")
def rev_parse_response(spark, sf_dir):
    parsed = rv.parse_responses(view(spark, sf_dir, "v_responses"))
    return rv.response_findings(parsed, ["call_id"])


@query("rev_error_findings", "A4", oracle=RESP_CTES + """
select call_id, 0 as item_ord, file_path, 0 as line_number, 'low' as severity, agent as category,
 case agent when 'security' then 'Security' when 'performance' then 'Performance' else 'Style' end
   || ' agent error: response is not a JSON array of findings' as description, '' as suggested_fix
from c where status = 'error'""")
def rev_error_findings(spark, sf_dir):
    parsed = rv.parse_responses(view(spark, sf_dir, "v_responses"))
    return rv.error_findings(parsed, ["call_id"])


@query("prj_with_file_path", "P15", oracle=RESP_CTES + """
select call_id, cast(item_ord as int) as item_ord, file_path, json_extract_string(it, '$.file_path') as model_path,
 json_extract_string(it, '$.category') as category from items""")
def prj_with_file_path(spark, sf_dir):
    parsed = rv.parse_responses(view(spark, sf_dir, "v_responses"))
    rows = parsed.filter(F.col("status") == "rows").select(
        "call_id", "file_path", F.posexplode_outer("items").alias("item_ord", "_it")).filter(F.col("_it").isNotNull())
    return rows.select("call_id", "item_ord", "file_path",
                       F.expr("try_variant_get(_it, '$.file_path', 'string')").alias("model_path"),
                       F.expr("try_variant_get(_it, '$.category', 'string')").alias("category"))


@query("rev_counts", "A7", oracle=M4_CTES + """
, raw as (select agent, count(*) as raw_findings from a group by agent),
kept as (select agent, count(*) as deduplicated from m4 group by agent)
select raw.agent, cast(raw.raw_findings as bigint) as raw_findings, cast(coalesce(kept.deduplicated, 0) as bigint) as deduplicated
from raw left join kept using (agent)
union all select 'all', (select count(*) from a), (select count(*) from m4)""")
def rev_counts(spark, sf_dir):
    from .q_merge import _with_agents
    f = _with_agents(spark, sf_dir)
    raw = f.groupBy("agent").agg(F.count(F.lit(1)).alias("raw_findings"))
    kept = merge.dedup(merge.order_findings(f, ["item_seq"])).groupBy("agent").agg(
        F.count(F.lit(1)).alias("deduplicated"))
    per_agent = raw.join(kept, "agent", "left").select(
        "agent", "raw_findings", F.coalesce("deduplicated", F.lit(0)).cast("bigint").alias("deduplicated"))
    total = per_agent.agg(F.lit("all").alias("agent"), F.sum("raw_findings").cast("bigint").alias("raw_findings"),
                          F.sum("deduplicated").cast("bigint").alias("deduplicated"))
    return per_agent.unionByName(total)




def _review_sql() -> str:
    """DuckDB: rules on every chunk's own lines, then the merge of M4."""
    # Block rules reuse the section formulation with each chunk as a section:
    # its id takes the place of file_ord.
    block_sel = BLOCK_PART.strip()
    block_ctes, block_final = block_sel[:block_sel.rindex("select h.repo")], block_sel[block_sel.rindex("select h.repo"):]
    block_ctes = block_ctes.replace("from cl2", "from ckl").replace("join cl2", "join ckl").rstrip().rstrip(",")
    return DISPATCH_CTES.rstrip() + ",\nch as (" + DISPATCH_BODY + "),\n" + _rules_cte() + """,
ckl as (select repo, pr_number, commit_sha, file_ord * 100000 + chunk_ord as file_ord, file_path, start_line,
          unnest(string_split(content, chr(10))) as line,
          cast(unnest(range(1, len(string_split(content, chr(10))) + 1)) as int) as line_no from ch),
""" + block_ctes + """,
bh as (""" + block_final + """),
lh as (select l.repo, l.pr_number, l.commit_sha, l.file_ord, l.line_no, r.rule_id, r.agent, r.severity,
         r.agent as category, r.description from ckl l join rules r on regexp_matches(l.line, r.pattern)),
hs as (select * from lh union all select * from bh),
f as (select h.repo, h.pr_number, h.commit_sha, c.file_path, h.agent, h.severity, h.category, h.description,
        cast(c.start_line + h.line_no - 1 as int) as line_number, c.file_ord as f_ord, c.chunk_ord as c_ord,
        (h.line_no - 1) * 100 + cast(regexp_extract(h.rule_id, '[0-9]+', 0) as int) as item_ord,
        case h.agent when 'security' then 0 when 'performance' then 1 else 2 end as agent_ord,
        case h.severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 3 end as rank
      from hs h join ch c on c.repo = h.repo and c.pr_number = h.pr_number and c.commit_sha = h.commit_sha
        and c.file_ord * 100000 + c.chunk_ord = h.file_ord),
k as (select *,
        row_number() over (partition by repo, pr_number, commit_sha, file_path, line_number, category
                           order by rank, agent_ord, f_ord, c_ord, item_ord) as rn,
        first_value(struct_pack(a := agent_ord, b := f_ord, c := c_ord, d := item_ord)) over (
          partition by repo, pr_number, commit_sha, file_path, line_number, category
          order by agent_ord, f_ord, c_ord, item_ord) as fs from f)
select repo, pr_number, commit_sha,
 cast(row_number() over (partition by repo, pr_number, commit_sha order by rank, fs.a, fs.b, fs.c, fs.d) as int) as position,
 agent, severity, category, file_path, line_number, description, cast(null as varchar) as suggested_fix, rank
from k where rn = 1"""


@query("rev_review", "3.2", oracle=_review_sql())
def rev_review(spark, sf_dir):
    """The whole review of every diff with the rule-table reviewers."""
    from ..plans.review import review
    from .q_chunks import diffs
    return review(diffs(spark, sf_dir))
