"""CRF language identification: forward-backward, held-out accuracy, cases of the docstring."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
from corpus_helpers import docs, with_extra
from pyspark.sql import functions as F

from reviewgrid.llm import op7_langid as op
from reviewgrid.llm import queries
from reviewgrid.llm.common import identity

TEXTS = {"aa": "bada dada bada gaba daga baba gada", "bb": "silo misi lomo simo loli miso limo"}


def tiny():
    return op.fit([(lang, " ".join([t] * 8)) for lang, t in TEXTS.items()])


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    m = op.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = [4, 0, 1, 6, 3]
    first = np.concatenate([[0], np.cumsum(lengths)])
    emit = rng.normal(size=(first[-1], 3))
    got = op.posteriors(emit, first, m)
    for k, n in enumerate(lengths):
        e, want = emit[first[k]:first[k + 1]], np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            if n:
                s = m.start[path[0]] + sum(e[i, c] for i, c in enumerate(path)) + sum(m.transitions[a, b] for a, b in itertools.pairwise(path))
                for i, c in enumerate(path):
                    want[i, c] += np.exp(s)
        if n:
            assert np.allclose(got[first[k]:first[k + 1]], want / want.sum(axis=1, keepdims=True))


def test_long_sequences_stay_in_range():
    m = tiny()
    post, _ = op._labelled(m, ["bada silo " * 20_000], {})
    assert len(post) == 40_000 and np.isfinite(post).all() and np.allclose(post.sum(axis=1), 1)


def test_code_switched_words_are_labelled(spark):
    m = tiny()
    text = "Bada dada gaba. Silo misi lomo simo. Daga baba"
    runs = op.label_words(identity(docs(spark, [text])), m).collect()
    assert [(r.lang, text[r.start:r.end]) for r in runs] == [("aa", "Bada dada gaba"), ("bb", "Silo misi lomo simo"), ("aa", "Daga baba")]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op7_langid_crf(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = got.filter("held_out").join(truth, "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("ok")).first()
    assert r.n > 1500 and r.ok > 0.99
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 for x in got.limit(200).collect())


def test_defined_cases(spark):
    rows = [None, "", "123 !?", "bada", "silo " * 9000, (3, "bada"), (None, "misi lomo"), "x" * 5000]
    df = with_extra(docs(spark, rows))
    got = op.predict(identity(df), tiny()).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [(by[k].lang_pred, by[k].score) for k in (0, 1, 2)] == [("und", 0.0)] * 3
    assert by[3].lang_pred == "aa" and by[4].lang_pred == by[None].lang_pred == "bb"
    assert {r.lang_pred for r in op.predict(identity(df), None).collect()} == {"und"}
    kept = op.identified(df, tiny())
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 3, 4, 7]
    assert op.predict(identity(df).limit(0), tiny()).collect() == [] and op.learn(df.limit(0)) is None


def test_learning_sees_no_held_out_row(spark):
    rows = [(i, f"word{i}", "aa" if i % 2 else None) for i in range(60)]
    texts = {t for _, t in op.training_rows(docs(spark, rows), 100, 50, 5)}
    assert texts == {f"word{i}" for i, _, lang in rows if lang and zlib.crc32(str(i).encode()) % 5}


def test_every_language_value_is_learned(spark):
    # 70 languages, the last one with the fewest rows
    word = lambda k, j: chr(97 + k // 26) * 2 + chr(97 + k % 26) * 2 + "aeiou"[j % 5] + "rst"[j % 3]
    rows = [(100 * k + i, " ".join(word(k, i + j) for j in range(30)), f"l{k:02}") for k in range(70) for i in range(12 if k < 69 else 8)]
    df = docs(spark, rows)
    model = op.learn(df)
    assert len(model.langs) == 70
    got = op.predict(identity(df), model).collect()
    assert all(r.lang_pred == f"l{r.doc_id // 100:02}" for r in got if r.doc_id >= 6900)
    assert np.mean([r.lang_pred == f"l{r.doc_id // 100:02}" for r in got]) > 0.95


def test_long_runs_are_read_whole(spark):
    m = tiny()
    middle = "bada" * 5 + "silo" * 100 + "bada" * 5  # both ends say aa, the text is bb
    assert op.predict(identity(docs(spark, [middle])), m).collect()[0].lang_pred == "bb"
    runs = op.label_words(identity(docs(spark, [middle])), m).collect()
    assert runs[0].start == 0 and runs[-1].end == len(middle) and any(r.lang == "bb" for r in runs)


def test_segments_equal_the_whole(spark):
    m = tiny()
    text = " ".join(np.random.default_rng(5).choice(["bada", "silo", "gaba", "miso", "loda"], 5000)) + "x" * 300
    whole, _ = op._labelled(m, [text], {})
    parts = list(op._segments(m, text, {}, 700))[::-1]
    assert np.allclose(np.concatenate([p for _, _, p in parts]), whole)
    assert [lo for lo, _, _ in parts][1:] == [hi for _, hi, _ in parts][:-1]
    sums = op._shares(m, ["bada", None, text, "silo misi", "12", text], {}, 100)
    assert [n for n, _ in sums] == [1, 0, len(whole), 2, 0, len(whole)]
    assert np.allclose(sums[2][1], whole.sum(axis=0)) and np.allclose(sums[5][1], sums[2][1])


def test_only_letters_count(spark):
    rows = ["² ½ Ⅷ ٣", "²bada²", "\u0301"]
    got = sorted(op.predict(identity(docs(spark, rows)), tiny()).collect())
    assert [(r.lang_pred, r.n_words) for r in got] == [("und", 0), ("aa", 1), ("und", 0)]


def test_many_long_texts_in_little_memory(spark):
    import resource
    m = tiny()
    texts = ["bada silo gaba miso " * 5000] * 300  # 20,000 words each
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert [n for n, _ in op._shares(m, texts, {})] == [20_000] * 300
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 * 1024  # KB


def test_very_long_text(spark):
    text = "bada dada gaba " * 150_000  # 2.2 MB
    got = op.predict(identity(docs(spark, [text, "silo"])), tiny()).collect()
    assert {(r.doc_id, r.lang_pred, r.n_words) for r in got} == {(0, "aa", 450_000), (1, "bb", 1)}


def test_learning_starts_no_workers_of_its_own(spark, monkeypatch):
    """A table made from a list of rows would run through Python workers of another kind, kept beside the others."""
    frame = docs(spark, [(k, TEXTS["aa"], "aa") for k in range(12)])
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *more, **named: made.append(data) or create(self, data, *more, **named))
    assert op.training_rows(frame, 250, 1500)
    assert made and all(isinstance(data, pa.Table) for data in made)
