"""Retrieval: block-merged exact top-k equals one block; embeddings are unit length."""

import math

from pyspark.sql import functions as F

from reviewgrid.operators import retrieval

SF = "/root/testdata/sf0.001"


def test_topk_dense_blocks_are_exact(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    guides = emb.filter(F.col("vec_id") < 40).withColumnRenamed("vec_id", "g_id")
    chunks = emb.filter(F.col("vec_id") >= 40).withColumnRenamed("vec_id", "chunk_id")
    one = retrieval.topk_dense(chunks, ["chunk_id"], guides, k=3)
    many = retrieval.topk_dense(chunks, ["chunk_id"], guides, k=3, block_rows=7)   # 6 blocks
    a = sorted((r.chunk_id, r.rank, r.g_id, round(r.distance, 9)) for r in one.collect())
    b = sorted((r.chunk_id, r.rank, r.g_id, round(r.distance, 9)) for r in many.collect())
    assert a == b and len(a) == 3 * chunks.count()


def test_hashed_tf_unit_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = retrieval.with_hashed_tf(docs, "text", dims=16).collect()
    for r in rows:
        n = math.sqrt(sum(x * x for x in r.embedding))
        assert len(r.embedding) == 16 and (abs(n - 1) < 1e-9 or n == 0)


def test_topk_text_ties_break_by_guideline_order(spark):
    df = spark.createDataFrame([(1, ""), (2, "sql injection queries")], "id int, text string")
    got = {(r.id, r.rank): r.g_id for r in retrieval.topk_text(df, ["id"], "text").collect()}
    assert [got[(1, k)] for k in (1, 2, 3)] == ["g0", "g1", "g2"]     # no tokens: all scores 0
    assert got[(2, 1)] == "g0"
