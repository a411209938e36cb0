"""Fixture views V_* derived from the read-only test tables.

Each view is given twice, as Spark SQL and as DuckDB SQL, and the two give
the same rows. Spark builds them as DataFrames (``view(spark, sf_dir,
name)``); the DuckDB oracle embeds them as common table expressions
(``duck_with``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.parallel import spread
from .tables import run_sql, table

# FIXED VALUES: HMAC-SHA256 pads of the fixture key text "fixture-secret"
# (key XOR 0x5c and key XOR 0x36, padded to 64 bytes).
FIXTURE_SECRET = "fixture-secret"
_OPAD = "3a352428292e39712f393f2e39285c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c"
_IPAD = "505f4e424344531b4553554453423636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636"

SPARK = {
    "v_diffs": r"""
with d as (select doc_id, lang, (doc_id div 2) as pr_number, transform(split(text, char(10)), (t, j) -> case (doc_id + (j + 1)) % 7
 when 0 then concat('+def f_', (j + 1), '(a, b=[]):')
 when 1 then concat('+    ', t)
 when 2 then concat('+class c', (j + 1), ':')
 when 3 then concat(' ', t)
 when 4 then concat('-', t)
 when 5 then '+    for x in a:'
 else '+        cur.execute("SELECT * FROM t WHERE id = " + x)' end) as lines,
  case when (doc_id div 2) % 10 = 0 then (doc_id div 2) * 2 else doc_id end as path_id from documents),
p as (select doc_id, pr_number, lines,
  concat(case when path_id % 4 = 0 then 'doc' else 'src' end, '/f', path_id, case when path_id % 3 = 0 then '.md' else '.py' end) as path from d),
s as (select doc_id, pr_number, concat(
  case when doc_id % 22 = 0 then concat('+stray', char(10)) else '' end,
  'diff --git a/', path, ' b/', path, char(10), 'index 000..111 100644', char(10), '--- a/', path, char(10), '+++ b/', path, char(10), '@@ -1 +1 @@', char(10),
  array_join(lines, char(10))) as txt from p)
select concat('org/r', a.pr_number % 5) as repo, cast(a.pr_number as int) as pr_number,
  substr(sha2(cast(a.pr_number as string),256), 1, 40) as commit_sha,
  concat(a.txt, char(10), coalesce(b.txt, '')) as diff
from s a left join s b on b.doc_id = a.doc_id + 1 where a.doc_id % 2 = 0
""",
    "v_lines": r"""
with d as (select doc_id, doc_id % 3 = 0 as giant, split(text, char(10)) as parts from documents),
j as (select doc_id, giant, posexplode(parts) as (k, t) from d),
b as (select doc_id, giant, k, t, case when giant then '    ' else '' end as p from j),
body as (select case when giant then 0 else doc_id end as pr, case when giant then doc_id * 100000 else 0 end + k + 10 as pos,
 case (doc_id + k) % 9
 when 0 then concat('+', p, 'def f_', k, '(a, b=[]):')
 when 1 then concat('+', p, '    ', t)
 when 2 then concat('+', p, 'class c', k, ':')
 when 3 then concat(' ', t)
 when 4 then concat('-', t)
 when 5 then concat('+', p, '    for x in a:')
 when 6 then concat('+', p, '        cur.execute("SELECT * FROM t WHERE id = " + x)')
 when 7 then concat('+', p, '        while go(x', doc_id % 40, '):')
 else concat('+', p, '            go(x', doc_id % 40, ')') end as line from b),
head as (select case when doc_id % 3 = 0 then 0 else doc_id end as pr, explode(sequence(0, 4)) as h from documents where doc_id % 3 <> 0 or doc_id = 0),
named as (select pr, h as pos, case h when 0 then concat('diff --git a/src/f', pr, '.py b/src/f', pr, '.py') when 1 then concat('+++ b/src/f', pr, '.py')
 when 2 then '@@ -1 +1 @@' when 3 then '+class Giant:' else '+    "All of it."' end as line from head)
select concat('org/r', pr % 5) as repo, cast(pr as int) as pr_number, substr(sha2(cast(pr as string),256), 1, 40) as commit_sha, pos, line
from (select pr, pos, line from body union all select pr, cast(pos as bigint) as pos, line from named) u
""",
    "v_code": r"""
with d as (select doc_id, split(text, char(10)) as parts from documents),
j as (select doc_id, posexplode(parts) as (k, t) from d),
c as (select doc_id, k, regexp_replace(t, '[^A-Za-z ]', '') as t, char(92) as bs, repeat(char(34), 3) as q, repeat(char(39), 3) as s from j),
p as (select doc_id, k, case (doc_id + k) % 8
 when 0 then array(concat('def f_', k, '(a,'), 'b):', concat('    ', q, t), 'def not_code():', q, '    return a')
 when 1 then array(concat('x_', k, ' = ', q), concat(t, ' # no comment'), 'class NotCode:', concat(q, ' + "tail"'))
 when 2 then array(concat('class C_', k, ':'), '    y = (', '1,', ')', concat('    # ', t), '', '# column 0')
 when 3 then array('@dec(', '1', ')', concat('def g_', k, '(): pass'))
 when 4 then array(concat('z_', k, ' = 1 + ', bs), '2', concat('w = ', s), concat('def no(): it', bs, char(39), 's ', q), s)
 when 5 then array(concat('async def h_', k, '():'), concat('    return "# not a comment" # ', t), '')
 when 6 then array(concat('class D_', k, '('), 'object', '):', concat('    html = f', q), concat('<p>', s, '</p>'), concat('def x(): ', char(39)), concat('    ', q))
 else array('if z:', concat('    def inner_', k, '(): pass'), concat('v = ', char(39), 'it', bs, char(39), 's', char(39), ' + "', s, '"')) end as block from c),
l as (select doc_id, k, posexplode(block) as (i, line) from p)
select concat('org/r', doc_id % 5) as repo, cast(doc_id as int) as pr_number, substr(sha2(cast(doc_id as string),256), 1, 40) as commit_sha, cast(0 as int) as file_ord, concat('src/f', doc_id, '.py') as file_path,
 cast(row_number() over (partition by doc_id order by k, i) as int) as line_no, line from l
""",
    "v_hunks": r"""
with d as (select doc_id, split(text, char(10)) as parts from documents),
j as (select doc_id, posexplode(parts) as (k, t) from d),
m as (select doc_id, k, k div 6 as h, (doc_id + k) % 4 as kind, t from j),
n as (select doc_id, h, sum(case when kind <> 0 then 1 else 0 end) as b, sum(case when kind <> 1 then 1 else 0 end) as d from m group by doc_id, h),
o as (select doc_id, h, b, d, coalesce(sum(b) over (partition by doc_id order by h rows between unbounded preceding and 1 preceding), 0) + 3 * h + 1 as a,
  coalesce(sum(d) over (partition by doc_id order by h rows between unbounded preceding and 1 preceding), 0) + 3 * h + 1 as c from n),
u as (select doc_id, 0 as pos, concat('diff --git a/f', doc_id, '.py b/f', doc_id, '.py') as line from documents
 union all select doc_id, 1, concat('--- a/f', doc_id, '.py') from documents
 union all select doc_id, 2, concat('+++ b/f', doc_id, '.py') from documents
 union all select doc_id, 4 + h * 7, concat('@@ -', a, case when b = 1 then '' else concat(',', b) end, ' +', c, case when d = 1 then '' else concat(',', d) end, ' @@') from o
 union all select doc_id, 5 + h * 7 + k % 6, concat(case kind when 0 then '+' when 1 then '-' else ' ' end, case when k % 5 = 0 then '++ ' when k % 5 = 1 then '-- ' else '' end, t) from m)
select concat('org/r', doc_id % 5) as repo, cast(doc_id as int) as pr_number, substr(sha2(cast(doc_id as string),256), 1, 40) as commit_sha, cast(pos as int) as pos, line from u
""",
    "v_findings": r"""
select concat('org/r', user_id % 5) as repo, cast(user_id as int) as pr_number, event_id as seq,
 case event_type when 'error' then 'security' when 'purchase' then 'security' when 'click' then 'performance' when 'view' then 'style' else null end as category,
 case event_id % 6 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' when 4 then 'High' else null end as severity,
 case when event_id % 13 = 0 then '' else concat('src/f', event_id % 3, '.py') end as file_path,
 cast(case when event_id % 17 = 0 then null else event_id % 5 end as int) as line_number,
 concat('issue ', props) as description, case when event_id % 4 = 0 then null else concat('fix ', event_id) end as suggested_fix, ts as created_at from events
""",
    "v_pr_events": r"""
with b as (select event_id, ts, case when event_type = 'view' then 'push' else 'pull_request' end as event,
 concat('{"action":"', case event_id % 5 when 0 then 'opened' when 1 then 'synchronize' when 2 then 'reopened' when 3 then 'closed' else 'labeled' end,
  '","repository":{"full_name":"org/r', user_id % 5, '"},"pull_request":{"number":', user_id, ',"head":{"sha":"', substr(sha2(cast(case when event_id % 4 = 3 then event_id else user_id end as string),256),1,40), '"}}}') as payload from events)
select event_id as delivery_id, event, payload, ts as received_at,
 case when event_id % 10 = 0 then 'sha256=bad' else concat('sha256=', sha2(concat(X'OPAD', unhex(sha2(concat(X'IPAD', cast(payload as binary)),256))),256)) end as signature from b
""".replace("OPAD", _OPAD).replace("IPAD", _IPAD),
    "v_comments": r"""
select concat('org/r', conv_id % 5) as repo, cast(conv_id as int) as pr_number, conv_id * 100 + turn as comment_id,
 case when role = 'assistant' then concat('## 🤖 Automated Review', char(10), text) else text end as body from conversations
""",
    "v_responses": r"""
select event_id as call_id, concat('src/f', event_id % 50, '.py') as file_path, case event_id % 3 when 0 then 'security' when 1 then 'performance' else 'style' end as agent,
 case event_id % 10 when 0 then '[]' when 1 then '{}' when 2 then concat('Sure: [', event_id, ']') when 3 then '[] hello' when 4 then '{"a":1}' when 5 then '[1]' when 6 then 'null'
 when 7 then concat('[{"file_path":"x","line_number":', event_id % 40, ',"severity":"high","category":"security","description":"d","suggested_fix":"s"}]')
 when 8 then '[{"line_number":"3","severity":null},{"line_number":4,"severity":"low","category":"style"}]' else '[null]' end as response from events
""",
    "v_commits": r"""
select concat('org/r', user_id % 5) as repo, cast(user_id as int) as pr_number,
 substr(sha2(cast(event_id as string),256),1,40) as sha, ts as committed_at from events
""",
}

DUCK = {
    "v_diffs": r"""
with d as (select doc_id, lang, (doc_id // 2) as pr_number, list_transform(string_split(text, chr(10)), lambda t, i: case (doc_id + i) % 7
 when 0 then concat('+def f_', i, '(a, b=[]):')
 when 1 then concat('+    ', t)
 when 2 then concat('+class c', i, ':')
 when 3 then concat(' ', t)
 when 4 then concat('-', t)
 when 5 then '+    for x in a:'
 else '+        cur.execute("SELECT * FROM t WHERE id = " + x)' end) as lines,
  case when (doc_id // 2) % 10 = 0 then (doc_id // 2) * 2 else doc_id end as path_id from documents),
p as (select doc_id, pr_number, lines,
  concat(case when path_id % 4 = 0 then 'doc' else 'src' end, '/f', path_id, case when path_id % 3 = 0 then '.md' else '.py' end) as path from d),
s as (select doc_id, pr_number, concat(
  case when doc_id % 22 = 0 then concat('+stray', chr(10)) else '' end,
  'diff --git a/', path, ' b/', path, chr(10), 'index 000..111 100644', chr(10), '--- a/', path, chr(10), '+++ b/', path, chr(10), '@@ -1 +1 @@', chr(10),
  array_to_string(lines, chr(10))) as txt from p)
select concat('org/r', a.pr_number % 5) as repo, cast(a.pr_number as int) as pr_number,
  substr(sha256(cast(a.pr_number as varchar)), 1, 40) as commit_sha,
  concat(a.txt, chr(10), coalesce(b.txt, '')) as diff
from s a left join s b on b.doc_id = a.doc_id + 1 where a.doc_id % 2 = 0
""",
    "v_lines": r"""
with d as (select doc_id, doc_id % 3 = 0 as giant, string_split(text, chr(10)) as parts from documents),
j as (select doc_id, giant, unnest(range(0, len(parts))) as k, unnest(parts) as t from d),
b as (select doc_id, giant, k, t, case when giant then '    ' else '' end as p from j),
body as (select case when giant then 0 else doc_id end as pr, case when giant then doc_id * 100000 else 0 end + k + 10 as pos,
 case (doc_id + k) % 9
 when 0 then concat('+', p, 'def f_', k, '(a, b=[]):')
 when 1 then concat('+', p, '    ', t)
 when 2 then concat('+', p, 'class c', k, ':')
 when 3 then concat(' ', t)
 when 4 then concat('-', t)
 when 5 then concat('+', p, '    for x in a:')
 when 6 then concat('+', p, '        cur.execute("SELECT * FROM t WHERE id = " + x)')
 when 7 then concat('+', p, '        while go(x', doc_id % 40, '):')
 else concat('+', p, '            go(x', doc_id % 40, ')') end as line from b),
head as (select case when doc_id % 3 = 0 then 0 else doc_id end as pr, unnest(range(0, 5)) as h from documents where doc_id % 3 <> 0 or doc_id = 0),
named as (select pr, h as pos, case h when 0 then concat('diff --git a/src/f', pr, '.py b/src/f', pr, '.py') when 1 then concat('+++ b/src/f', pr, '.py')
 when 2 then '@@ -1 +1 @@' when 3 then '+class Giant:' else '+    "All of it."' end as line from head)
select concat('org/r', pr % 5) as repo, cast(pr as int) as pr_number, substr(sha256(cast(pr as varchar)), 1, 40) as commit_sha, pos, line
from (select pr, pos, line from body union all select pr, cast(pos as bigint) as pos, line from named) u
""",
    "v_code": r"""
with d as (select doc_id, string_split(text, chr(10)) as parts from documents),
j as (select doc_id, unnest(range(0, len(parts))) as k, unnest(parts) as t from d),
c as (select doc_id, k, regexp_replace(t, '[^A-Za-z ]', '', 'g') as t, chr(92) as bs, repeat(chr(34), 3) as q, repeat(chr(39), 3) as s from j),
p as (select doc_id, k, case (doc_id + k) % 8
 when 0 then list_value(concat('def f_', k, '(a,'), 'b):', concat('    ', q, t), 'def not_code():', q, '    return a')
 when 1 then list_value(concat('x_', k, ' = ', q), concat(t, ' # no comment'), 'class NotCode:', concat(q, ' + "tail"'))
 when 2 then list_value(concat('class C_', k, ':'), '    y = (', '1,', ')', concat('    # ', t), '', '# column 0')
 when 3 then list_value('@dec(', '1', ')', concat('def g_', k, '(): pass'))
 when 4 then list_value(concat('z_', k, ' = 1 + ', bs), '2', concat('w = ', s), concat('def no(): it', bs, chr(39), 's ', q), s)
 when 5 then list_value(concat('async def h_', k, '():'), concat('    return "# not a comment" # ', t), '')
 when 6 then list_value(concat('class D_', k, '('), 'object', '):', concat('    html = f', q), concat('<p>', s, '</p>'), concat('def x(): ', chr(39)), concat('    ', q))
 else list_value('if z:', concat('    def inner_', k, '(): pass'), concat('v = ', chr(39), 'it', bs, chr(39), 's', chr(39), ' + "', s, '"')) end as block from c),
l as (select doc_id, k, unnest(range(0, len(block))) as i, unnest(block) as line from p)
select concat('org/r', doc_id % 5) as repo, cast(doc_id as int) as pr_number, substr(sha256(cast(doc_id as varchar)), 1, 40) as commit_sha, cast(0 as int) as file_ord, concat('src/f', doc_id, '.py') as file_path,
 cast(row_number() over (partition by doc_id order by k, i) as int) as line_no, line from l
""",
    "v_hunks": r"""
with d as (select doc_id, string_split(text, chr(10)) as parts from documents),
j as (select doc_id, unnest(range(0, len(parts))) as k, unnest(parts) as t from d),
m as (select doc_id, k, k // 6 as h, (doc_id + k) % 4 as kind, t from j),
n as (select doc_id, h, sum(case when kind <> 0 then 1 else 0 end) as b, sum(case when kind <> 1 then 1 else 0 end) as d from m group by doc_id, h),
o as (select doc_id, h, b, d, coalesce(sum(b) over (partition by doc_id order by h rows between unbounded preceding and 1 preceding), 0) + 3 * h + 1 as a,
  coalesce(sum(d) over (partition by doc_id order by h rows between unbounded preceding and 1 preceding), 0) + 3 * h + 1 as c from n),
u as (select doc_id, 0 as pos, concat('diff --git a/f', doc_id, '.py b/f', doc_id, '.py') as line from documents
 union all select doc_id, 1, concat('--- a/f', doc_id, '.py') from documents
 union all select doc_id, 2, concat('+++ b/f', doc_id, '.py') from documents
 union all select doc_id, 4 + h * 7, concat('@@ -', a, case when b = 1 then '' else concat(',', b) end, ' +', c, case when d = 1 then '' else concat(',', d) end, ' @@') from o
 union all select doc_id, 5 + h * 7 + k % 6, concat(case kind when 0 then '+' when 1 then '-' else ' ' end, case when k % 5 = 0 then '++ ' when k % 5 = 1 then '-- ' else '' end, t) from m)
select concat('org/r', doc_id % 5) as repo, cast(doc_id as int) as pr_number, substr(sha256(cast(doc_id as varchar)), 1, 40) as commit_sha, cast(pos as int) as pos, line from u
""",
    "v_findings": SPARK["v_findings"],
    "v_pr_events": r"""
with b as (select event_id, ts, case when event_type = 'view' then 'push' else 'pull_request' end as event,
 concat('{"action":"', case event_id % 5 when 0 then 'opened' when 1 then 'synchronize' when 2 then 'reopened' when 3 then 'closed' else 'labeled' end,
  '","repository":{"full_name":"org/r', user_id % 5, '"},"pull_request":{"number":', user_id, ',"head":{"sha":"', substr(sha256(cast(case when event_id % 4 = 3 then event_id else user_id end as varchar)),1,40), '"}}}') as payload from events)
select event_id as delivery_id, event, payload, ts as received_at,
 case when event_id % 10 = 0 then 'sha256=bad' else concat('sha256=', sha256(unhex('OPAD') || unhex(sha256(unhex('IPAD') || encode(payload))))) end as signature from b
""".replace("OPAD", _OPAD).replace("IPAD", _IPAD),
    "v_comments": r"""
select concat('org/r', conv_id % 5) as repo, cast(conv_id as int) as pr_number, conv_id * 100 + turn as comment_id,
 case when role = 'assistant' then concat('## 🤖 Automated Review', chr(10), text) else text end as body from conversations
""",
    "v_responses": SPARK["v_responses"],
    "v_commits": r"""
select concat('org/r', user_id % 5) as repo, cast(user_id as int) as pr_number,
 substr(sha256(cast(event_id as varchar)),1,40) as sha, ts as committed_at from events
""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture view ``name`` as a Spark DataFrame over ``sf_dir``.

    The diffs are built from narrow rows that are dealt to all cores first: a small
    table is one row group and would be one task.
    """
    if name == "v_diffs":
        docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
        return run_sql(spark, sf_dir, SPARK[name], documents=spread(docs, ["doc_id"]))
    return run_sql(spark, sf_dir, SPARK[name])


def duck_with(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause defining the given fixture views (and extra CTEs) for DuckDB."""
    parts = [f"{n} as ({DUCK[n].strip()})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} as ({v.strip()})")
    return "with " + ",\n".join(parts) + "\n"
