"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import GUIDELINES
from ..operators import retrieval
from ..operators.parallel import spread
from ..sources.tables import table
from .catalog import query
from .q_chunks import DISPATCH_BODY, DISPATCH_CTES, dispatched


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


GUIDE_VALUES = ", ".join(f"({i}, {_lit(t)})" for i, t in enumerate(GUIDELINES))


def _cosine_ctes(src: str, key: str) -> str:
    """DuckDB: token cosine of ``src(key..., text)`` rows against the guidelines."""
    return rf"""
g(g_ord, text) as (values {GUIDE_VALUES}),
gt as (select g_ord, tok, count(*) as c from (select g_ord, unnest(regexp_extract_all(lower(text), '\w+')) as tok from g) x group by g_ord, tok),
gn as (select g_ord, sqrt(sum(c * c)) as gnorm from gt group by g_ord),
dt as (select {key}, tok, count(*) as c from (select {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '\w+')) as tok from {src}) x group by all),
dn as (select {key}, sqrt(sum(c * c)) as dnorm from dt group by all),
dp as (select {", ".join("dt." + k.strip() for k in key.split(","))}, gt.g_ord, sum(dt.c * gt.c) as dot from dt join gt on gt.tok = dt.tok group by all),
sc as (select {", ".join("s." + k.strip() for k in key.split(","))}, g.g_ord,
         case when dn.dnorm > 0 and gn.gnorm > 0 then coalesce(dp.dot, 0) / (dn.dnorm * gn.gnorm) else 0.0 end as score
       from {src} s cross join g
       join gn on gn.g_ord = g.g_ord
       left join dn on {" and ".join(f"dn.{k.strip()} = s.{k.strip()}" for k in key.split(","))}
       left join dp on dp.g_ord = g.g_ord and {" and ".join(f"dp.{k.strip()} = s.{k.strip()}" for k in key.split(","))}),
top as (select *, cast(row_number() over (partition by {key} order by score desc, g_ord) as int) as rank from sc)
"""


@query("rag_embed", "V1", oracle=r"""
with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\w+')) as tok from documents),
b as (select doc_id, ('0x' || substr(md5(tok), 1, 8))::bigint % 64 as bucket, count(*) as c from t group by all),
n as (select doc_id, sqrt(sum(c * c)) as norm from b group by doc_id),
d as (select doc_id, g.i from documents cross join range(64) g(i))
select d.doc_id, list(coalesce(b.c / n.norm, 0.0) order by d.i) as embedding
from d left join b on b.doc_id = d.doc_id and b.bucket = d.i
left join n on n.doc_id = d.doc_id group by d.doc_id""")
def rag_embed(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return retrieval.with_hashed_tf(docs, "text").select("doc_id", "embedding")


@query("rag_topk", "V2", oracle=r"""
with g as (select vec_id as g_id, embedding as ge from embeddings where vec_id < 12),
q as (select vec_id as chunk_id, embedding as qe from embeddings where vec_id >= 12),
d as (select q.chunk_id, g.g_id,
        list_sum(list_transform(range(1, len(qe) + 1), lambda i: (qe[i]::double - ge[i]::double) * (qe[i]::double - ge[i]::double))) as dist
      from q cross join g)
select chunk_id, rank, g_id, round(dist, 4) as distance from (
  select *, cast(row_number() over (partition by chunk_id order by dist, g_id) as int) as rank from d) t where rank <= 3""")
def rag_topk(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    guides = emb.filter(F.col("vec_id") < 12).withColumnRenamed("vec_id", "g_id")
    chunks = emb.filter(F.col("vec_id") >= 12).withColumnRenamed("vec_id", "chunk_id")
    top = retrieval.topk_dense(chunks, ["chunk_id"], guides, k=3)
    return top.withColumn("distance", F.round("distance", 4))


@query("rag_topk_text", "V3", oracle="with " + _cosine_ctes("documents", "doc_id") + """
select doc_id, rank, 'g' || cast(g_ord as varchar) as g_id, g_ord, score from top where rank <= 3""")
def rag_topk_text(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return retrieval.topk_text(docs, ["doc_id"], "text", k=3)


CK = "repo, pr_number, commit_sha, file_ord, chunk_ord"


@query("prj_prompt", "P13", oracle=DISPATCH_CTES.rstrip() + ",\nch as (" + DISPATCH_BODY + "),\n"
       + "chx as (select *, content as text from ch),\n" + _cosine_ctes("chx", CK) + f""",
bl as (select {CK}, string_agg('- ' || g.text, chr(10) order by t.rank) as bullets
       from top t join g on g.g_ord = t.g_ord where t.rank <= 3 group by all)
select c.repo, c.pr_number, c.commit_sha, c.file_ord, c.chunk_ord,
 'File: ' || c.file_path || chr(10) || 'Relevant guidelines:' || chr(10) || coalesce(bl.bullets, '') || chr(10) || chr(10)
 || 'Code:' || chr(10) || '```python' || chr(10) || c.content || chr(10) || '```' as prompt
from ch c left join bl using (repo, pr_number, commit_sha, file_ord, chunk_ord)""")
def prj_prompt(spark, sf_dir):
    ch = dispatched(spark, sf_dir)
    return retrieval.prompts(ch, ["repo", "pr_number", "commit_sha", "file_ord", "chunk_ord"])
