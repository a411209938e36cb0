"""The registered queries of the corpus operators: name -> builder, name -> DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (op1_ngram_join, op2_toxicity, op3_decontaminate, op4_suffix_dedup, op5_quality_qda, op6_rolling_dedup, op7_langid,
               op8_license, op9_mixing, op10_repetition, op11_divergence, op12_packing,
               op13_prefix_trie)
from .common import documents, identity, table

OP6 = """
WITH src AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT k, doc_id, i, w[i + 1:i + 13] AS g FROM (SELECT *, unnest(range(0, len(w) - 12)) AS i FROM src) WHERE len(w) >= 13),
hit AS (SELECT k, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS p FROM hit),
word AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM src),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (k, p) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(s, 0)::BIGINT AS n_spans
FROM src LEFT JOIN (SELECT k, count(*) AS n, count(*) FILTER (b IS NULL OR b < p - 1) AS s
  FROM (SELECT k, p, lag(p) OVER (PARTITION BY k ORDER BY p) AS b FROM gone) GROUP BY k) USING (k) LEFT JOIN kept USING (k)
"""
ORACLES: dict[str, str] = {"op6_rolling_hash_dedup": OP6,
                           "op3_benchmark_decontamination": op3_decontaminate.ORACLE,
                           "op9_mixing_budgets": op9_mixing.oracle(),
                           "op11_divergence_audit": op11_divergence.ORACLE}


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_ngram_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = identity(documents(spark, sf_dir)), F.coalesce(remainder(3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(remainder(3) != 1)
    return op2_toxicity.score(docs, op2_toxicity.learn(docs, labels)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3_decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.drop("thash")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return op4_suffix_dedup.remove(docs, op4_suffix_dedup.repeats(docs), with_text=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op5_quality_qda.assess(documents(spark, sf_dir), table(spark, sf_dir, "labels"), remainder(4) != 2)
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_rolling_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_rolling_dedup.remove(documents(spark, sf_dir), with_text=False).drop("thash")


def op7_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = op7_langid.learn(docs)
    return op7_langid.predict(identity(docs), model).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_license.scan(documents(spark, sf_dir)).drop("thash")


def op9_mixing_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mixing.mix(documents(spark, sf_dir), keep=["doc_id", "lang", "source"])


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_repetition.score(documents(spark, sf_dir)).drop("thash")


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_divergence.audit(documents(spark, sf_dir))


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_packing.pack(documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_prefix_trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity_grammar": op2_toxicity_grammar,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_quality_discriminant": op5_quality_discriminant,
    "op6_rolling_hash_dedup": op6_rolling_hash_dedup,
    "op7_langid_crf": op7_langid_crf,
    "op8_license_scan": op8_license_scan,
    "op9_mixing_budgets": op9_mixing_budgets,
    "op10_repetition_rules": op10_repetition_rules,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_harmonic_packing": op12_harmonic_packing,
    "op13_conversation_trie": op13_conversation_trie,
}
