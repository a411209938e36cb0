"""Guideline retrieval (S5, V1, V2, V3) and the review prompt.

The reference embeds text with a sentence model and asks a vector store for
the three nearest guidelines. Here:

* V1 ``with_hashed_tf``: a normalised hashed term-frequency vector, computed
  per row — no explode, no shuffle. A user
  model can replace it through ``embed_with`` (an Arrow-batched pandas UDF).
* V2 ``topk_dense``: exact k nearest candidates by squared L2. Candidates
  are packed into blocks of at most ``block_rows``; each query row scores a
  whole block with ``transform`` and keeps its k best with ``sort_array`` +
  ``slice``. One block (the fixed guideline set) is a bounded broadcast;
  more blocks are an equi-join on an explicit block id and the per-block
  winners are merged exactly with a grouped top-k. No pair is ever a row.
* V3 ``topk_text``: sparse cosine over lower-case word tokens against a
  constant guideline list; the guideline weights are literal maps, so each
  row computes its twelve dot products alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import GUIDELINES, TOP_K_GUIDELINES

TOKEN_REGEX = "\\w+"           # ASCII word characters, as RE2 and Java agree
DEFAULT_BLOCK_ROWS = 4096
BLOCK_BYTES = 16 << 20  # of vectors in a block, which is one row


def guidelines_df(spark: SparkSession) -> DataFrame:
    """The twelve guidelines, ids g0..g11, as a constant relation."""
    rows = [(f"g{i}", i, t) for i, t in enumerate(GUIDELINES)]
    return spark.createDataFrame(rows, "g_id string, g_ord int, text string")


def tokens(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(TOKEN_REGEX), 0)


def token_bucket(w: Column, dims: int) -> Column:
    """Bucket of a token: the first 32 bits of its md5, modulo ``dims``
    (a hash every SQL engine can reproduce)."""
    return F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int")


def with_hashed_tf(df: DataFrame, text_col: str, dims: int = 64, out: str = "embedding") -> DataFrame:
    """V1: L2-normalised hashed term frequencies (``array<double>`` of ``dims``).

    Per row: token buckets are sorted and counted as runs (linear after the
    sort), then spread into a dense vector; no explode and no shuffle.
    """
    tmp = df.withColumn("_b", F.sort_array(F.transform(tokens(text_col), lambda w: token_bucket(w, dims))))
    tmp = _run_counts(tmp, "_b", "_runs").withColumn("_m", F.map_from_entries("_runs"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                        lambda d: F.coalesce(F.try_element_at(F.col("_m"), d), F.lit(0)).cast("double"))
    return tmp.withColumn("_dense", dense).withColumn(out, normalise(F.col("_dense"))) \
        .drop("_b", "_runs", "_m", "_dense")


def normalise(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)


def embed_with(df: DataFrame, text_col: str, fn: Callable, out: str = "embedding") -> DataFrame:
    """V1 hook: a user embedding model as an Arrow-batched pandas UDF.

    ``fn(pandas.Series[str]) -> pandas.Series[list[float]]``.
    """
    from ..session import ship_package
    ship_package(df.sparkSession)
    udf = F.pandas_udf(fn, "array<double>")
    return df.withColumn(out, udf(F.col(text_col)))


def _sq_l2(a: str, b: str) -> str:
    return (f"aggregate(zip_with({a}, {b}, (x, y) -> (cast(x as double) - cast(y as double)) * "
            f"(cast(x as double) - cast(y as double))), 0d, (acc, z) -> acc + z)")


def topk_dense(queries: DataFrame, query_key: list[str], candidates: DataFrame, k: int = TOP_K_GUIDELINES,
               emb: str = "embedding", cand_id: str = "g_id", cand_emb: str = "embedding",
               block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """V2: exact k nearest candidates per query row by squared L2.

    Returns ``query_key + [rank, cand_id, distance]`` (rank 1 = nearest;
    ties broken by candidate id).
    """
    n, width = candidates.agg(F.count(F.lit(1)), F.max(F.size(cand_emb))).first()  # scalars: sizes of blocks and broadcast
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, width or 1))))
    blocks = max(1, math.ceil(n / block_rows))
    c = candidates.select(F.col(cand_id).alias("_cid"), F.col(cand_emb).alias("_cemb"))
    if blocks > 1:
        c = c.withColumn("_block", F.pmod(F.xxhash64("_cid"), F.lit(blocks)).cast("int"))
    else:
        c = c.withColumn("_block", F.lit(0))
    packed = c.groupBy("_block").agg(F.collect_list(F.struct("_cid", "_cemb")).alias("_cands"))
    q = queries.select(*query_key, F.col(emb).alias("_qemb"))
    if blocks == 1:
        # At most block_rows candidates: a bounded broadcast, no shuffle of the queries.
        joined = q.withColumn("_block", F.lit(0)).join(F.broadcast(packed), "_block")
    else:
        # few block ids would gather all queries in few tasks: each block is copied under several salts
        salts = max(1, math.ceil(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")) / blocks))
        q = q.withColumn("_salt", F.pmod(F.xxhash64(*query_key), F.lit(salts)).cast("int"))
        q = q.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = q.join(packed, ["_block", "_salt"])
    best = joined.select(*query_key, F.expr(
        f"slice(sort_array(transform(_cands, c -> named_struct('distance', {_sq_l2('c._cemb', '_qemb')}, "
        f"'cid', c._cid))), 1, {k})").alias("_best"))
    if blocks > 1:
        best = best.groupBy(*query_key).agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("_best"))), 1, k).alias("_best"))
    out = best.select(*query_key, F.posexplode_outer("_best").alias("_r", "_b")).filter(F.col("_b").isNotNull())
    return out.select(*query_key, (F.col("_r") + 1).cast("int").alias("rank"),
                      F.col("_b.cid").alias(cand_id), F.col("_b.distance").alias("distance"))


def _guideline_weights(texts: list[str]) -> list[tuple[dict[str, int], float]]:
    out = []
    for t in texts:
        tf = Counter(re.findall(r"\w+", t.lower(), flags=re.ASCII))
        out.append((dict(tf), math.sqrt(sum(v * v for v in tf.values()))))
    return out


def _run_starts(sorted_col: str) -> Column:
    """Places in a sorted array at which a new value starts."""
    return F.expr(f"filter(transform({sorted_col}, (t, i) -> case when i = 0 then i "
                  f"when t != {sorted_col}[i - 1] then i else -1 end), i -> i >= 0)")


def _run_counts(df: DataFrame, sorted_col: str, out: str) -> DataFrame:
    """Distinct values of a sorted array with their counts (array of (value, n)),
    from the run starts; linear in the array."""
    runs = F.expr(f"transform(_starts, (s, m) -> struct({sorted_col}[s] as value, "
                  f"coalesce(try_element_at(_starts, m + 2), size({sorted_col})) - s as n))")
    return df.withColumn("_starts", _run_starts(sorted_col)).withColumn(out, runs).drop("_starts")


def best_guides(df: DataFrame, text_col: str, k: int = TOP_K_GUIDELINES, texts: list[str] | None = None,
                out: str = "_best") -> DataFrame:
    """``df`` with ``out``: the k guidelines with the highest token cosine to ``text_col``,
    array<struct<neg, g_ord, score>>, best first, ties by guideline order.

    All inside the row: run lengths of the sorted tokens give the norm; a literal map gives
    a token's weight in every guideline at once, and tokens in none drop out.
    """
    weights = _guideline_weights(texts if texts is not None else GUIDELINES)
    vocab = sorted({w for tf, _ in weights for w in tf})
    by_token = F.create_map(*[x for w in vocab for x in (F.lit(w), F.array(*[F.lit(float(tf.get(w, 0))) for tf, _ in weights]))])
    d = df.withColumn("_tok", F.sort_array(tokens(text_col))).withColumn("_starts", _run_starts("_tok"))
    d = d.withColumn("_dn", F.expr("""sqrt(cast(aggregate(transform(_starts, (s, m) -> coalesce(get(_starts, m + 1), size(_tok)) - s),
        0L, (acc, n) -> acc + cast(n as bigint) * n) as double))"""))
    # a hashed set test drops nearly all tokens; only the others pay the map's linear search
    d = d.withColumn("_hits", F.transform(F.filter("_tok", lambda t: t.isin(vocab)), lambda t: F.try_element_at(by_token, t)))
    zero = F.array(*[F.lit(0.0) for _ in weights])
    norms = F.array(*[F.lit(float(norm)) for _, norm in weights])
    d = d.withColumn("_dots", F.aggregate("_hits", zero, lambda acc, w: F.zip_with(acc, w, lambda x, y: x + y)))
    neg = F.transform(F.zip_with("_dots", norms, lambda x, n: F.when((F.col("_dn") > 0) & (n > 0), -(x / (F.col("_dn") * n))).otherwise(F.lit(0.0))),
                      lambda x, g: F.struct(x.alias("neg"), g.alias("g_ord")))
    best = F.transform(F.slice(F.sort_array(neg), 1, k), lambda b: F.struct(b["neg"].alias("neg"), b["g_ord"].alias("g_ord"), F.abs(b["neg"]).alias("score")))
    return d.withColumn(out, best).drop("_tok", "_starts", "_dn", "_hits", "_dots")


def topk_text(df: DataFrame, key: list[str], text_col: str, k: int = TOP_K_GUIDELINES,
              texts: list[str] | None = None) -> DataFrame:
    """V3: ``key + [rank, g_id, g_ord, score]`` of the k best guidelines of each text."""
    best = best_guides(df.select(*key, text_col), text_col, k, texts)
    out = best.select(*key, F.posexplode_outer("_best").alias("_r", "_b")).filter(F.col("_b").isNotNull())
    return out.select(*key, (F.col("_r") + 1).cast("int").alias("rank"),
                      F.concat(F.lit("g"), F.col("_b.g_ord").cast("string")).alias("g_id"),
                      F.col("_b.g_ord").alias("g_ord"), F.col("_b.score").alias("score"))


def with_prompt(chunks: DataFrame, k: int = TOP_K_GUIDELINES) -> DataFrame:
    """``chunks`` with ``prompt``, the text a reviewer gets (retrieval runs once per
    chunk, inside the row, not once per reviewer)."""
    gl = F.array(*[F.lit(t) for t in GUIDELINES])
    bullets = F.array_join(F.transform("_best", lambda b: F.concat(F.lit("- "), F.element_at(gl, b["g_ord"] + 1))), "\n")
    return best_guides(chunks, "content", k).withColumn("prompt", F.concat(
        F.lit("File: "), F.col("file_path"), F.lit("\nRelevant guidelines:\n"), bullets,
        F.lit("\n\nCode:\n```python\n"), F.col("content"), F.lit("\n```"))).drop("_best")


def prompts(chunks: DataFrame, key: list[str], k: int = TOP_K_GUIDELINES) -> DataFrame:
    """P13 on its own: key and prompt."""
    return with_prompt(chunks.select(*key, *[c for c in ("file_path", "content") if c not in key]), k).select(*key, "prompt")
