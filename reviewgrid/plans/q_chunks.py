"""Diff lines, sections and chunkers (P2-P6, P12, P14, F3, F4, F6-F8, C1-C10) over V_diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunkers, diff_lines as dl, sections
from ..sources.fixtures import duck_with, view
from ..sources.tables import table
from . import duck_chunks as D
from .catalog import query

K = ["repo", "pr_number", "commit_sha"]


def _w(*ctes: str) -> str:
    return duck_with("v_diffs") + ", " + ",\n".join(c.strip() for c in ctes) + "\n"


def diffs(spark, sf_dir):
    """The V_diffs fixture as the plans read it: chunking is per row and needs no exchange of its own."""
    return view(spark, sf_dir, "v_diffs")


def sources_a(spark, sf_dir):
    return sections.added_source(sections.sections_a(diffs(spark, sf_dir)))


@query("prj_diff_lines", "P2", oracle=_w(D.LINES) + "select repo, pr_number, commit_sha, pos, line from lines")
def prj_diff_lines(spark, sf_dir):
    return dl.diff_lines(diffs(spark, sf_dir))


@query("prj_line_kind", "P3", oracle=_w(D.LINES) + f"select repo, pr_number, commit_sha, pos, {D.KIND} as kind from lines")
def prj_line_kind(spark, sf_dir):
    return dl.classified_lines(diffs(spark, sf_dir)).drop("line")


@query("prj_path_a", "P4", oracle=_w(D.LINES) + """
select repo, pr_number, commit_sha, pos, substr(line, 7) as file_path from lines where starts_with(line, '+++ b/')""")
def prj_path_a(spark, sf_dir):
    lines = dl.diff_lines(diffs(spark, sf_dir))
    return lines.filter(F.col("line").startswith("+++ b/")).select(
        *K, "pos", dl.path_from_new_header().alias("file_path"))


@query("prj_path_b", "P5", oracle=_w(D.LINES) + """
select repo, pr_number, commit_sha, pos,
 case when len(string_split(line, ' ')) >= 4 then
   case when starts_with(string_split(line, ' ')[4], 'b/') then substr(string_split(line, ' ')[4], 3)
        else string_split(line, ' ')[4] end end as file_path
from lines where starts_with(line, 'diff --git')""")
def prj_path_b(spark, sf_dir):
    lines = dl.diff_lines(diffs(spark, sf_dir))
    return lines.filter(F.col("line").startswith("diff --git")).select(
        *K, "pos", dl.path_from_git_header().alias("file_path"))


@query("flt_added_lines", "F7", oracle=_w(D.LINES) + f"""
select repo, pr_number, commit_sha, pos, substr(line, 2) as code from lines where {D.IS_ADD}""")
def flt_added_lines(spark, sf_dir):
    return dl.added_lines(dl.classified_lines(diffs(spark, sf_dir))).select(*K, "pos", "code")


@query("flt_added_context_lines", "F8", oracle=_w(D.LINES) + f"""
select repo, pr_number, commit_sha, pos, case when starts_with(line, '+') then substr(line, 2) else line end as code
from lines where {D.KIND} in ('add', 'context')""")
def flt_added_context_lines(spark, sf_dir):
    return dl.added_context_lines(dl.classified_lines(diffs(spark, sf_dir))).select(*K, "pos", "code")


@query("flt_nonblank", "F4", oracle=duck_with("v_diffs") + r"""
select repo, pr_number, commit_sha, cast(length(diff) as int) as n_chars from v_diffs
where regexp_matches(diff, '[^\s\x1c-\x1f]')""")
def flt_nonblank(spark, sf_dir):
    d = diffs(spark, sf_dir)
    return d.filter(~dl.is_blank("diff")).select(*K, F.length("diff").alias("n_chars"))


@query("prj_previews", "P12", oracle=duck_with("v_diffs") + """
select repo, pr_number, cast(length(diff) as int) as diff_chars, substr(diff, 1, 2000) as preview,
 substr(commit_sha, 1, 7) as short_sha from v_diffs""")
def prj_previews(spark, sf_dir):
    d = diffs(spark, sf_dir)
    return d.select("repo", "pr_number", F.length("diff").alias("diff_chars"),
                    F.substring("diff", 1, 2000).alias("preview"),
                    F.substring("commit_sha", 1, 7).alias("short_sha"))


@query("prj_token_count", "P6", oracle=r"""
select doc_id, cast(len(regexp_extract_all(text, '[^\s\x1c-\x1f]+')) as int) as n_tokens from documents""")
def prj_token_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", dl.word_count("text").alias("n_tokens"))


@query("chk_sections_a", "C1", oracle=_w(D.LINES, D.SECTIONS_A) + """
select repo, pr_number, commit_sha, file_ord, header_pos, file_path, n_body_lines, n_added from sa""")
def chk_sections_a(spark, sf_dir):
    s = sections.sections_a(diffs(spark, sf_dir))
    return s.select(*K, "file_ord", "header_pos", "file_path",
                    F.size("body").alias("n_body_lines"), F.size("added").alias("n_added"))


@query("flt_python_files", "F3", oracle=_w(D.LINES, D.SECTIONS_A) + """
select repo, pr_number, commit_sha, file_ord, file_path from sa where ends_with(file_path, '.py')""")
def flt_python_files(spark, sf_dir):
    s = sections.sections_a(diffs(spark, sf_dir))
    return s.filter(F.col("file_path").endswith(".py")).select(*K, "file_ord", "file_path")


@query("chk_added_source", "C3", oracle=_w(D.LINES, D.SECTIONS_A) + """
select repo, pr_number, commit_sha, file_ord, file_path, source, n_lines from src""")
def chk_added_source(spark, sf_dir):
    return sources_a(spark, sf_dir).select(*K, "file_ord", "file_path", "source",
                                           F.size("src_lines").alias("n_lines"))


CHUNK_OUT = "repo, pr_number, commit_sha, file_ord, chunk_ord, file_path, content, start_line, end_line, method"


@query("chk_boundary", "C4", oracle=_w(D.LINES, D.SECTIONS_A, D.BOUNDARY) +
       f"select {CHUNK_OUT} from bcc where not ends_with(file_path, '.py')")
def chk_boundary(spark, sf_dir):
    src = sources_a(spark, sf_dir).filter(~F.col("file_path").endswith(".py"))
    return chunkers.boundary_chunks(src).filter(F.col("method") == "boundary")


@query("chk_whole_file", "C5", oracle=_w(D.LINES, D.SECTIONS_A, D.BOUNDARY) +
       f"select {CHUNK_OUT} from whole where not ends_with(file_path, '.py')")
def chk_whole_file(spark, sf_dir):
    src = sources_a(spark, sf_dir).filter(~F.col("file_path").endswith(".py"))
    return chunkers.boundary_chunks(src).filter(F.col("method") == "whole_file")




@query("chk_toplevel", "C6", oracle=_w(D.LINES, D.SECTIONS_A, D.TOPLEVEL) +
       f"select {CHUNK_OUT} from topcc where ends_with(file_path, '.py')")
def chk_toplevel(spark, sf_dir):
    src = sources_a(spark, sf_dir).filter(F.col("file_path").endswith(".py"))
    return chunkers.toplevel_chunks(src).select(*K, *chunkers.CHUNK_COLS)


@query("prj_chunk_name", "P14", oracle=_w(D.LINES, D.SECTIONS_A, D.TOPLEVEL) + """
select repo, pr_number, commit_sha, file_ord, chunk_ord,
 case when starts_with(head, 'class') then 'class' else 'function' end as chunk_type,
 case when regexp_extract(head, '^(?:async\\s+)?(?:def|class)\\s+(\\w+)', 1) = '' then 'unknown'
      else regexp_extract(head, '^(?:async\\s+)?(?:def|class)\\s+(\\w+)', 1) end as name
from topc where ends_with(file_path, '.py')""")
def prj_chunk_name(spark, sf_dir):
    src = sources_a(spark, sf_dir).filter(F.col("file_path").endswith(".py"))
    return chunkers.toplevel_chunks(src).select(*K, "file_ord", "chunk_ord", "chunk_type", "name")


@query("chk_nested_blocks", "C8", oracle=_w(D.LINES, D.SECTIONS_A, D.NESTED) + """
select repo, pr_number, commit_sha, file_ord, chunk_ord, file_path, start_line, end_line, content as code,
 case when starts_with(ltrim(head), 'class') then 'class' else 'function' end as chunk_type,
 regexp_extract(head, '^[ \\t\\f]*(?:async\\s+)?(?:def|class)\\s+(\\w+)', 1) as name
from ncc""")
def chk_nested_blocks(spark, sf_dir):
    src = sources_a(spark, sf_dir).filter(F.col("file_path").endswith(".py"))
    return chunkers.nested_blocks(src, K + ["file_ord", "file_path"])


DISPATCH_CTES = _w(D.LINES, D.SECTIONS_A, D.BOUNDARY, D.TOPLEVEL)
DISPATCH_BODY = f"""
select {CHUNK_OUT} from topcc where ends_with(file_path, '.py')
union all select {CHUNK_OUT} from bcc where not ends_with(file_path, '.py')
union all select {CHUNK_OUT} from whole where not ends_with(file_path, '.py')"""
DISPATCH_SQL = DISPATCH_CTES + DISPATCH_BODY


def dispatched(spark, sf_dir):
    return chunkers.dispatch_chunks(sources_a(spark, sf_dir))


@query("chk_dispatch", "C9", oracle=DISPATCH_SQL)
def chk_dispatch(spark, sf_dir):
    return dispatched(spark, sf_dir)


@query("flt_prs_with_chunks", "F6", oracle=DISPATCH_SQL.replace(
    f"select {CHUNK_OUT} from topcc", "select repo, pr_number from topcc", 1).replace(
    f"union all select {CHUNK_OUT} from bcc", "union select repo, pr_number from bcc").replace(
    f"union all select {CHUNK_OUT} from whole", "union select repo, pr_number from whole"))
def flt_prs_with_chunks(spark, sf_dir):
    return dispatched(spark, sf_dir).select(*K).distinct().select("repo", "pr_number")


@query("chk_sections_b", "C2", oracle=_w(D.LINES, D.SECTIONS_B) + """
select p.repo, p.pr_number, p.commit_sha, p.file_ord, p.file_path, s.changed_code,
 cast(count(b.pos) as int) as n_body_lines
from pb2 p join secb s on s.repo = p.repo and s.pr_number = p.pr_number and s.commit_sha = p.commit_sha and s.file_ord = p.file_ord
left join bodyb b on b.repo = p.repo and b.pr_number = p.pr_number and b.commit_sha = p.commit_sha and b.file_ord = p.file_ord
group by all""")
def chk_sections_b(spark, sf_dir):
    s = sections.changed_code_b(sections.sections_b(diffs(spark, sf_dir)))
    return s.select(*K, "file_ord", "file_path", "changed_code", F.size("body").alias("n_body_lines"))


NB_OUT = "repo, pr_number, commit_sha, file_ord, file_path, chunk_ord, chunk_type, name, content as code, start_line, end_line"


@query("chk_named_blocks", "C7", oracle=_w(D.LINES, D.SECTIONS_B) + f"select {NB_OUT} from nbkc")
def chk_named_blocks(spark, sf_dir):
    s = sections.changed_code_b(sections.sections_b(diffs(spark, sf_dir)))
    return chunkers.named_blocks(s, K + ["file_ord", "file_path"])


@query("chk_standalone_b", "C10", oracle=_w(D.LINES, D.SECTIONS_B) + f"""
select {NB_OUT} from nbkc n where ends_with(file_path, '.py') and exists (
  select 1 from secb s where s.repo = n.repo and s.pr_number = n.pr_number and s.commit_sha = n.commit_sha
    and s.file_ord = n.file_ord and regexp_matches(s.changed_code, '[^\\s\\x1c-\\x1f]'))""")
def chk_standalone_b(spark, sf_dir):
    return chunkers.standalone_b(sections.sections_b(diffs(spark, sf_dir)))
