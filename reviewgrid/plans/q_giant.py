"""Operators on line tables: C1-C3, C8 and A6 with one file that holds a third of all lines, C6 on lexed lines,
true line numbers from hunk headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hunks, lexer, line_scan as ls
from ..sources.fixtures import duck_with, view
from . import duck_chunks as D
from .catalog import query
from .q_reviewers import BLOCK_PART

K = "repo, pr_number, commit_sha"
_LINES = duck_with("v_lines", extra={"lines": "select * from v_lines"}).rstrip() + ",\n"


def _w(*ctes: str) -> str:
    return _LINES + ",\n".join(c.strip() for c in ctes) + "\n"


def _sections(spark, sf_dir):
    return ls.section_lines(view(spark, sf_dir, "v_lines"))


@query("chk_giant_sections", "C1 line table", oracle=_w(D.SECTIONS_A) + f"""
select {K}, file_ord, header_pos, file_path, n_body_lines, n_added from sa""")
def chk_giant_sections(spark, sf_dir):
    return ls.section_counts(_sections(spark, sf_dir))


@query("chk_giant_source", "C3 line table", oracle=_w(D.SECTIONS_A) + f"select {K}, file_ord, file_path, line_no, line from cl2")
def chk_giant_source(spark, sf_dir):
    return ls.added_lines(_sections(spark, sf_dir))


@query("chk_giant_sections_b", "C2 line table", oracle=_w(D.SECTIONS_B) + f"select {K}, file_ord, file_path, pos, line from bodyb")
def chk_giant_sections_b(spark, sf_dir):
    return ls.sections_b_lines(view(spark, sf_dir, "v_lines"))


@query("chk_giant_file", "C8 line table", oracle=_w(D.SECTIONS_A, D.NESTED.replace("ncc as (" + D._content("nch") + ")", "ncc as (select * from nch)")) + f"""
select {K}, file_ord, file_path, chunk_ord, case when starts_with(ltrim(head), 'class') then 'class' else 'function' end as chunk_type,
 regexp_extract(head, '^[ \\t\\f]*(?:async\\s+)?(?:def|class)\\s+(\\w+)', 1) as name, start_line, end_line from ncc""")
def chk_giant_file(spark, sf_dir):
    py = ls.added_lines(_sections(spark, sf_dir)).filter(F.col("file_path").endswith(".py"))
    return ls.nested_blocks(py)


@query("rev_giant_blocks", "A6 line table", oracle=_w(D.SECTIONS_A, BLOCK_PART))
def rev_giant_blocks(spark, sf_dir):
    return ls.block_rule_hits(ls.added_lines(_sections(spark, sf_dir))).drop("file_path")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _rest_sql(line: str, state: str) -> str:
    closed = "".join(f" when {k} then case when regexp_matches({line}, {_q(p)}) then regexp_replace({line}, {_q(p)}, '') end" for k, p in lexer.CLOSE.items())
    return f"case {state} when 0 then {line}{closed} end"


_LAST = f"regexp_extract_all({_rest_sql('s.line', 's.state')}, {_q(lexer.TOKENS)})[-1]"
_EXIT = f"""case when s.state > 0 and ({_rest_sql('s.line', 's.state')}) is null then s.state
 when starts_with({_LAST}, repeat(chr(34), 3)) and not regexp_matches({_LAST}, {_q('^(?:' + lexer._CLOSED + ')$')}) then 2
 when starts_with({_LAST}, repeat(chr(39), 3)) and not regexp_matches({_LAST}, {_q('^(?:' + lexer._CLOSED + ')$')}) then 1 else 0 end"""
_F = f"{K}, file_ord"
LEXED = "with recursive " + duck_with("v_code").removeprefix("with ").rstrip() + rf""",
code0 as materialized (select * from v_code),
st as (select {_F}, file_path, line_no, line, 0 as state from code0 where line_no = 1
 union all select n.repo, n.pr_number, n.commit_sha, n.file_ord, n.file_path, n.line_no, n.line, {_EXIT}
 from st s join code0 n on n.repo = s.repo and n.pr_number = s.pr_number and n.commit_sha = s.commit_sha and n.file_ord = s.file_ord and n.line_no = s.line_no + 1),
vis as (select *, regexp_replace(coalesce({_rest_sql('line', 'state')}, ''), {_q(lexer.TOKENS)}, '', 'g') as code from st),
dep as (select *, coalesce(sum(len(regexp_extract_all(code, '[(\[{{]')) - len(regexp_extract_all(code, '[)\]}}]'))) over (
  partition by {_F} order by line_no rows between unbounded preceding and 1 preceding), 0) as depth,
  coalesce(lag(ends_with(code, chr(92))) over (partition by {_F} order by line_no), false) as continued from vis),
sol as (select *, state = 0 and depth <= 0 and not continued as starts, not regexp_matches(line, '[^\s\x1c-\x1f]') as blank from dep),
sig as (select *, starts and not regexp_matches(line, '^[ \t\f]') as head from sol
 where not (starts and (blank or regexp_matches(line, '^[ \t\f]*#'))) and not (state = 0 and blank)),
ord as (select *, lag(line_no) over (partition by {_F} order by line_no) as before, max(line_no) over (partition by {_F}) as final from sig),
hd as (select *, lead(before) over (partition by {_F} order by line_no) as end_line, lag(line) over (partition by {_F} order by line_no) as above from ord where head)
select {_F}, file_path, cast(row_number() over (partition by {_F} order by line_no) - 1 as int) as chunk_ord,
 regexp_extract(line, '^(?:async\s+)?(?:def|class)\s+(\w+)', 1) as name, case when starts_with(line, 'class') then 'class' else 'function' end as chunk_type,
 line_no as start_line, coalesce(end_line, final) as end_line
from hd where regexp_matches(line, '^(async\s+def|def|class)\s') and not coalesce(starts_with(above, '@'), false)"""


@query("chk_toplevel_lexed", "C6 lexed", oracle=LEXED)
def chk_toplevel_lexed(spark, sf_dir):
    return lexer.toplevel_extents(view(spark, sf_dir, "v_code"))


HUNKS = duck_with("v_hunks").rstrip() + rf""",
head as (select *, regexp_extract(line, '^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@', ['a', 'b', 'c', 'd']) as g from v_hunks where starts_with(line, '@@ ')),
span as (select {K}, pos, try_cast(g.a as bigint) as a, coalesce(try_cast(g.b as bigint), 1) as b, try_cast(g.c as bigint) as c, coalesce(try_cast(g.d as bigint), 1) as d,
  lead(pos) over (partition by {K} order by pos) as nxt from head),
inside as (select l.repo, l.pr_number, l.commit_sha, l.pos, l.line, s.pos as h, a, b, c, d,
  sum(case when line[1] in ('+', ' ', '') then 1 else 0 end) over w as n, sum(case when line[1] in ('-', ' ', '') then 1 else 0 end) over w as o
 from v_hunks l join span s on s.repo = l.repo and s.pr_number = l.pr_number and s.commit_sha = l.commit_sha and l.pos > s.pos and (s.nxt is null or l.pos < s.nxt)
 window w as (partition by l.repo, l.pr_number, l.commit_sha, s.pos order by l.pos)),
res as (select *, case when line[1] in (' ', '') then 'context' when line[1] = '+' then 'add' else 'del' end as kind from inside
 where line[1] in ('+', '-', ' ', '') and (n - case when line[1] = '-' then 0 else 1 end < d or o - case when line[1] = '+' then 0 else 1 end < b)),
num as (select {K}, pos, line, kind, case when kind <> 'add' then a + o - 1 end::bigint as old_line, case when kind <> 'del' then c + n - 1 end::bigint as new_line from res)
"""


@query("prj_true_lines", "C1 hunks", oracle=HUNKS + "select * from num")
def prj_true_lines(spark, sf_dir):
    return hunks.hunk_lines(view(spark, sf_dir, "v_hunks"))


@query("prj_added_positions", "C3 hunks", oracle=HUNKS + f"""
select a.repo, a.pr_number, a.commit_sha, cast(0 as int) as file_ord, cast(row_number() over (partition by a.repo, a.pr_number, a.commit_sha order by a.pos) as int) as line_no,
 cast(new_line as int) as file_line from v_hunks a join num using ({K}, pos) where starts_with(a.line, '+') and not starts_with(a.line, '+++')""")
def prj_added_positions(spark, sf_dir):
    return hunks.added_positions(view(spark, sf_dir, "v_hunks"))
