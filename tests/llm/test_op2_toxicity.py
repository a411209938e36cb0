"""Toxicity grammar: automaton, learning, held-out accuracy, cases of the docstring."""

import zlib

import numpy as np
from corpus_helpers import docs, with_extra
from pyspark.sql import functions as F

from reviewgrid.llm import op2_toxicity as op
from reviewgrid.llm import queries
from reviewgrid.llm.common import identity

MODEL = op.Model({"zork$": 3.0, "blarg": 2.0}, np.array([2.0, 0, 0, 0, -4.0]))


def total(text):
    return np.expm1(op.signals(text, MODEL, op.Automaton(), {})[0])


def test_clauses_decide_not_words():
    plain = total("he saw a zork here")
    assert plain > 0
    assert total("you are a zork") > plain  # target before
    assert total("zork that you are") > plain  # target after
    assert total("he is not a zork") < plain  # negated
    assert total("she said he is a zork") < plain  # reported
    assert abs(total("she said it. he is a zork") - plain) < 1e-9  # the report ends with its clause
    assert total("they kill time") == 0 and total("I kill you") > 0 and total("you I kill") > 0  # threat needs its target
    assert total("zork zork zork") < 3 * plain  # later insults of a clause add less
    assert abs(total("blargish zorks") - 2.0) < 1e-9  # a beginning counts, a whole-word entry does not


def test_threat_before_its_target():
    for text in ("I will kill you", "we will hurt you", "kill you"):
        assert abs(total(text) - 1.5 * MODEL.threat) < 1e-9, text
    assert total("I will never kill you") < total("I will kill you")  # negated
    assert total("she said I will kill you") < total("I will kill you")  # reported
    assert total("I kill time and then some more for you") == 0  # out of reach
    assert abs(total("you are a zork you") - 1.5 * 3) < 1e-9  # the stronger reading, not both


def test_composition_equals_running_the_parts_side_by_side():
    rng = np.random.default_rng(5)
    auto = op.Automaton()
    for _ in range(200):
        state, parts = 0, [0] * len(op.GRAMMAR)
        for cls in rng.integers(0, 6, 12).tolist():
            state, factor = auto.step(state, cls)
            moved = [t.step(s, cls) for t, s in zip(op.GRAMMAR, parts, strict=True)]
            parts = [s for s, _ in moved]
            assert auto.names[state] == tuple(parts)
            assert factor == np.prod([f for _, f in moved])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op2_toxicity_grammar(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = got.filter("held_out").join(labels, "doc_id")
    r = held.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("predicted") == F.col("toxic")).cast("int")).alias("ok"),
                 F.sum(((F.col("predicted") == 1) & (F.col("toxic") == 0)).cast("int")).alias("wrong")).first()
    assert r.n > 1000 and r.ok / r.n > 0.97 and r.wrong / r.n < 0.005
    some = got.limit(200).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in some)


def test_learns_insults_where_toxicity_is_rare(spark):
    # 8 toxic among 8,008 texts: "common" in all toxic and 24 clean ones, "rare" in two toxic ones only
    toxic = [f"common {'rare' if k < 2 else 'other'} word{k}" for k in range(8)]
    clean = [f"{'common ' if k < 24 else ''}other word{k}" for k in range(8000)]
    rows = [(k, t, k < 8) for k, t in enumerate(toxic + clean)]
    df = identity(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows], "doc_id bigint, toxic int")
    model = op.learn(df, labels)
    assert {"common$", "rare$"} <= set(model.lexicon) and not {"other$", "word"} & set(model.lexicon)
    by = {r.doc_id: r.score for r in op.score(df, model).collect()}
    assert min(by[k] for k in range(8)) > max(by[k] for k in range(100, 8008))  # weights saw the toxic rows


def test_defined_cases(spark):
    rows = [None, "", "...", "a zork", ("zork " * 3000), (3, "a zork"), (None, "zork")]
    df = identity(with_extra(docs(spark, rows)))
    got = op.score(df, MODEL).collect()
    assert len(got) == len(rows)
    none = {round(r.score, 9) for r in got if r.doc_id in (0, 1, 2)}
    assert len(none) == 1
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in op.score(df, None).collect()] == [0.0] * len(rows)
    labels = spark.createDataFrame([(3, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    assert op.learn(df, labels) is None  # no class to tell apart
    assert op.score(df.limit(0), MODEL).collect() == []
