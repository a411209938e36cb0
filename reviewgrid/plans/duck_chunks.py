"""DuckDB oracle building blocks for the diff, section and chunk queries.

These are written the other way round from the Spark operators: lines are
rows, sections and chunks come from running sums, ``lead``/``lag`` and range
joins. Agreement of the two formulations is the correctness check.
"""

from __future__ import annotations

K = "repo, pr_number, commit_sha"
KJ = "{a}.repo = {b}.repo and {a}.pr_number = {b}.pr_number and {a}.commit_sha = {b}.commit_sha"


def kj(a: str, b: str, extra: str = "") -> str:
    on = KJ.format(a=a, b=b)
    return on + (f" and {a}.{extra} = {b}.{extra}" if extra else "")


LINES = f"""
dl as (select {K}, diff, case when l[-1] = '' then l[1:len(l)-1] else l end as lines
       from (select *, string_split(diff, chr(10)) as l from v_diffs) x),
lines as (select {K}, unnest(lines) as line, cast(unnest(range(len(lines))) as int) as pos from dl)
"""

KIND = """case
 when starts_with(line, 'diff --git') then 'diff_header'
 when starts_with(line, '+++ b/') then 'new_path'
 when starts_with(line, '+++') or starts_with(line, '---') then 'file_header'
 when starts_with(line, '@@') then 'hunk'
 when starts_with(line, '+') then 'add'
 when starts_with(line, '-') then 'del'
 else 'context' end"""

IS_ADD = "(starts_with(line, '+') and not starts_with(line, '+++'))"

SECTIONS_A = f"""
la as (select *, cast(sum(case when starts_with(line, '+++ b/') then 1 else 0 end)
          over (partition by {K} order by pos rows between unbounded preceding and current row) - 1 as int) as file_ord
       from lines),
sa as (select {K}, file_ord, min(pos) as header_pos, arg_min(substr(line, 7), pos) as file_path,
          cast(count(*) - 1 as int) as n_body_lines,
          cast(count(*) filter (where {IS_ADD}) as int) as n_added
       from la where file_ord >= 0 group by {K}, file_ord),
adds as (select {K}, file_ord, pos, substr(line, 2) as code from la where file_ord >= 0 and {IS_ADD}),
src as (select s.repo, s.pr_number, s.commit_sha, s.file_ord, s.file_path,
          string_agg(a.code, chr(10) order by a.pos) as source,
          cast(count(*) - case when arg_max(a.code, a.pos) = '' then 1 else 0 end as int) as n_lines
        from sa s join adds a on {kj('s', 'a', 'file_ord')}
        where s.file_path <> '' group by s.repo, s.pr_number, s.commit_sha, s.file_ord, s.file_path),
cl as (select a.repo, a.pr_number, a.commit_sha, a.file_ord, s.file_path, s.n_lines,
          cast(row_number() over (partition by a.repo, a.pr_number, a.commit_sha, a.file_ord order by a.pos) as int) as line_no,
          a.code as line
       from adds a join src s on {kj('a', 's', 'file_ord')}),
cl2 as (select * from cl where line_no <= n_lines)
"""

SK = f"{K}, file_ord"


def _content(chunks: str, lines: str = "cl2", cols: str = "") -> str:
    """Join chunk extents to their lines and concatenate them in order."""
    return f"""
select c.*, coalesce(string_agg(l.line, chr(10) order by l.line_no), '') as content
from {chunks} c left join {lines} l on {kj('c', 'l', 'file_ord')}
  and l.line_no between c.start_line and c.end_line
group by all"""


BOUNDARY = f"""
bnd as (select {SK}, file_path, n_lines, line_no as start_line,
          lead(line_no) over (partition by {SK} order by line_no) as nb,
          cast(row_number() over (partition by {SK} order by line_no) - 1 as int) as chunk_ord
        from cl2 where starts_with(line, 'def ') or starts_with(line, 'class ')),
bch as (select {SK}, file_path, chunk_ord, start_line, cast(coalesce(nb - 2, n_lines) as int) as end_line,
          'boundary' as method from bnd),
bcc as ({_content('bch')}),
whole as (select {SK}, file_path, cast(0 as int) as chunk_ord, cast(1 as int) as start_line,
            n_lines as end_line, 'whole_file' as method, source as content
          from src s where not exists (select 1 from bnd b where {kj('b', 's', 'file_ord')}))
"""

SIG = r"(regexp_matches(line, '[^\s\x1c-\x1f]') and not starts_with(line, '#'))"
OPENER_TOP = r"regexp_matches(line, '^(async\s+def|def|class)\s')"
OPENER_ANY = r"regexp_matches(line, '^[ \t\f]*(async\s+def|def|class)\s')"
CLOSER = r"regexp_matches(@L@, '^[ \t\f]*[)\]}]')"
NAME = r"regexp_extract({h}, '^[ \t\f]*(?:async\s+)?(?:def|class)\s+(\w+)', 1)"

TOPLEVEL = f"""
sig as (select * from cl2 where {SIG}),
term as (select *, lead(line_no) over (partition by {SK} order by line_no) as next_term,
           lag(line) over (partition by {SK} order by line_no) as prev_term
         from sig where not regexp_matches(line, '^[ \t\f]') and not {CLOSER.replace('@L@', 'line')}),
op as (select * from term where {OPENER_TOP} and (prev_term is null or not starts_with(prev_term, '@'))),
opend as (select o.repo, o.pr_number, o.commit_sha, o.file_ord, o.file_path, o.line_no as start_line,
            cast(max(s.line_no) as int) as end_line, o.line as head
          from op o join sig s on {kj('o', 's', 'file_ord')} and s.line_no >= o.line_no
            and (o.next_term is null or s.line_no < o.next_term)
          group by all),
topc as (select *, cast(row_number() over (partition by {SK} order by start_line) - 1 as int) as chunk_ord,
           'ast' as method from opend),
topcc as ({_content('topc')})
"""

NESTED = f"""
nsig as (select *, length(regexp_extract(line, '^[ \t\f]*', 0)) as ind from cl2
         where {SIG} and ends_with(file_path, '.py')),
nop as (select * from nsig where {OPENER_ANY}),
nterm as (select o.repo, o.pr_number, o.commit_sha, o.file_ord, o.file_path, o.line_no as start_line,
            o.line as head, min(s.line_no) as term
          from nop o left join nsig s on {kj('o', 's', 'file_ord')} and s.line_no > o.line_no
            and s.ind <= o.ind and not {CLOSER.replace('@L@', 's.line')}
          group by all),
nend as (select t.repo, t.pr_number, t.commit_sha, t.file_ord, t.file_path, t.start_line, t.head,
           cast(max(s.line_no) as int) as end_line
         from nterm t join nsig s on {kj('t', 's', 'file_ord')} and s.line_no >= t.start_line
           and (t.term is null or s.line_no < t.term)
         group by all),
nch as (select *, cast(row_number() over (partition by {SK} order by start_line) - 1 as int) as chunk_ord from nend),
ncc as ({_content('nch')})
"""

FUNC_RE = r"'^def\s+(\w+)\s*\('"
CLASS_RE = r"'^class\s+(\w+)[\s:(]'"

SECTIONS_B = f"""
lb as (select *, cast(sum(case when starts_with(line, 'diff --git') then 1 else 0 end)
          over (partition by {K} order by pos rows between unbounded preceding and current row) - 1 as int) as sec
       from lines),
hb as (select {K}, sec,
          case when len(string_split(line, ' ')) >= 4 then
            case when starts_with(string_split(line, ' ')[4], 'b/') then substr(string_split(line, ' ')[4], 3)
                 else string_split(line, ' ')[4] end end as raw_path
       from lb where starts_with(line, 'diff --git')),
hb2 as (select *, last_value(raw_path ignore nulls) over (partition by {K} order by sec
          rows between unbounded preceding and current row) as file_path from hb),
pb as (select {K}, file_path, min(sec) as first_sec, max(sec) as last_sec from hb2
       where file_path is not null group by {K}, file_path),
pb2 as (select *, cast(row_number() over (partition by {K} order by first_sec) - 1 as int) as file_ord from pb),
bodyb as (select p.repo, p.pr_number, p.commit_sha, p.file_ord, p.file_path, l.pos, l.line,
            l.pos = max(l.pos) over (partition by p.repo, p.pr_number, p.commit_sha, p.file_ord) as is_last
          from pb2 p join lb l on {kj('p', 'l')} and l.sec = p.last_sec
          where not starts_with(l.line, 'diff --git')),
keptb as (select {SK}, file_path, pos,
            case when starts_with(line, '+') then substr(line, 2) else line end as code
          from bodyb
          where not (is_last and line = '')
            and not (starts_with(line, '+++') or starts_with(line, '---') or starts_with(line, '@@')
                     or starts_with(line, '-'))),
secb as (select p.repo, p.pr_number, p.commit_sha, p.file_ord, p.file_path,
           coalesce(string_agg(k.code, chr(10) order by k.pos), '') as changed_code
         from pb2 p left join keptb k on {kj('p', 'k', 'file_ord')} group by all),
clb0 as (select {SK}, file_path, code as line,
           cast(row_number() over (partition by {SK} order by pos) as int) as line_no,
           count(*) over (partition by {SK}) as n_all,
           last_value(code) over (partition by {SK} order by pos rows between unbounded preceding and unbounded following) as last_code
         from keptb),
clb as (select *, cast(n_all - case when last_code = '' then 1 else 0 end as int) as n_lines from clb0),
clb2 as (select * from clb where line_no <= n_lines),
mb as (select {SK}, file_path, n_lines, line_no as start_line, line,
         lead(line_no) over (partition by {SK} order by line_no) as nxt,
         cast(row_number() over (partition by {SK} order by line_no) - 1 as int) as chunk_ord
       from clb2 where regexp_matches(line, {FUNC_RE}) or regexp_matches(line, {CLASS_RE})),
nbk as (select {SK}, file_path, chunk_ord, start_line, cast(coalesce(nxt - 1, n_lines) as int) as end_line,
          case when regexp_matches(line, {FUNC_RE}) then 'function' else 'class' end as chunk_type,
          case when regexp_matches(line, {FUNC_RE}) then regexp_extract(line, {FUNC_RE}, 1)
               else regexp_extract(line, {CLASS_RE}, 1) end as name
        from mb),
nbkc as ({_content('nbk', 'clb2')})
"""
