"""Hierarchical mixing: SQL on random trees, budgets, epochs, cases of the docstring."""

import random

import duckdb
from corpus_helpers import docs, with_extra, words
from pyspark.sql import functions as F

from reviewgrid.llm import op9_mixing as op


def table(spark, seed, n=120):
    rnd = random.Random(seed)
    rows = [(k, "w " * rnd.choice([0, 1, 3, 10, 40]), rnd.choice(["en", "en", "de", "xx", None]),
             rnd.choice(["src0", "src0", "src0", "src9", "src14", "src19", None])) for k in range(n)]
    return docs(spark, [*rows, rows[0], (None, "a b c", "en", "src0"), (500, None, "en", "src0"), (501, " ".join("x" * 300), "fr", "src3")])


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    for seed in (1, 2):
        df = table(spark, seed)
        con.register("documents", df.toArrow())
        got = op.mix(df, keep=["doc_id", "lang", "source"])
        want = con.execute(f"select {', '.join(got.columns)} from ({op.oracle()})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 20


def test_budget_is_met_and_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)],
                                   "domain string, lang string, source string, tokens bigint")
    got = {r.source: r.budget for r in op.leaf_budgets(leaves, 800.0, 1, {}, {}, {}).collect()}
    assert got == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}  # s2 makes up for s1; the rest of the tree is untouched
    got = {r.source: r.budget for r in op.leaf_budgets(leaves.filter("source != 's2'"), 800.0, 1, {}, {}, {}).collect()}
    assert got == {"s1": 10, "s3": 390, "s4": 400}  # no sibling left: the sibling language
    got = {r.source: r.budget for r in op.leaf_budgets(leaves.filter("domain = 'b' or source = 's1'"), 800.0, 1, {}, {}, {}).collect()}
    assert got == {"s1": 10, "s4": 790}  # then the other domain
    got = {r.source: (r.epochs, r.rest) for r in op.leaf_budgets(leaves.filter("source = 's1'"), 25.0, 3, {}, {}, {}).collect()}
    assert got == {"s1": (2, 5)}
    got = {r.source: r.budget for r in op.leaf_budgets(leaves, 800.0, 1, {"a": 3.0, "b": 0.0}, {"de": 0.0}, {"s1": 2.0}).collect()}
    assert got == {"s1": 10, "s2": 790, "s3": 0, "s4": 0}


def test_tokens_taken_are_the_budget(spark):
    df = table(spark, 3, 300).dropDuplicates(["doc_id"])
    picked = op.mix(df, fraction=0.4, max_epochs=5)
    words = df.agg(F.sum(F.regexp_count("text", F.lit(op.WORD)))).first()[0]
    taken = picked.agg(F.sum("take_tokens")).first()[0]
    assert int(0.4 * words) - 20 <= taken <= int(0.4 * words)  # whole tokens per leaf
    assert op.mix(df, fraction=0.4, max_epochs=5).select("doc_id", "mix_epoch", "take_tokens").exceptAll(
        picked.select("doc_id", "mix_epoch", "take_tokens")).count() == 0
    assert op.mix(df, fraction=0.4, seed=99).select("doc_id").exceptAll(op.mix(df, fraction=0.4).select("doc_id")).count() > 0


def test_columns_pass_through_and_empty_table(spark):
    df = with_extra(table(spark, 4)).withColumn("take_tokens", F.lit("mine"))
    got = op.mix(df)
    assert got.columns[:len(df.columns)] == df.columns and "_take_tokens" in got.columns
    assert {r.take_tokens for r in got.collect()} == {"mine"}
    assert op.mix(df.limit(0)).collect() == []


def test_text_ends_after_the_words_taken(spark):
    rows = [(k, f"  a{k}\tb\n" + f"w{k} x " * 50 + " ", "en", "src1") for k in range(3)]
    got = op.mix(docs(spark, rows), fraction=0.5).collect()
    assert sum(len(words(r.text)) for r in got) == 3 * 102 // 2
    assert all(len(words(r.text)) == r.take_tokens and r.n_chars == len(r.text) for r in got)
    whole = {k: t for k, t, *_ in rows}
    assert all(whole[r.doc_id].startswith(r.text) for r in got) and any(r.take_tokens < r.n_tokens for r in got)
    assert all(r.text == whole[r.doc_id] for r in got if r.take_tokens == r.n_tokens)
