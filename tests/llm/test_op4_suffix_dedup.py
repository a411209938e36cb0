"""Deep-shallow suffix dedup against brute force; the sort itself; cases of the docstring."""

import random

import numpy as np
from corpus_helpers import corpus, cut_by_brute_force, docs, new_tables, with_extra

from reviewgrid.llm import op4_suffix_dedup as op


def cut(df, length, **options):
    out = op.remove(df, op.repeats(df, length, **options), with_text=False)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()), key=str)


def test_deep_shallow_orders_strings_and_prefixes():
    rnd = random.Random(2)
    text = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    text += [b"ab" * 30 + t for t in text[:100]] + text[:50]
    group = np.array([rnd.randint(0, 5) for _ in text])
    order, lcp = op.deep_shallow(group, text)
    got = [(int(group[i]), text[i]) for i in order]
    assert sorted(order.tolist()) == list(range(len(text)))
    assert got == sorted(got, key=lambda x: (x[0], x[1].ljust(op.SHALLOW, b"\0")[:op.SHALLOW], x[1]))
    for k in range(1, len(order)):
        a, b = text[order[k - 1]], text[order[k]]
        if group[order[k]] != group[order[k - 1]]:
            assert lcp[k] == -1
        else:
            m = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == m


def test_random_corpus_and_defined_cases(spark):
    texts = corpus(70, seed=5)
    rows = [*enumerate(texts), (9, texts[9]), (None, texts[12]), (500, texts[3])]
    df = with_extra(docs(spark, rows))
    assert cut(df, 60) == cut_by_brute_force(rows, 60)


def test_windows_of_hot_anchors_give_the_same(spark):
    rows = list(enumerate(corpus(60, seed=8)))
    df = docs(spark, rows)
    assert cut(df, 50, hot=1) == cut_by_brute_force(rows, 50)


def test_long_rows_are_cut_in_pieces(spark, monkeypatch):
    rnd = random.Random(6)
    a = "".join(rnd.choice("abc \n") for _ in range(9000))
    rows = [(0, a), (1, "zz" + a[2500:7100] + "zz"), (2, "q" * 3000)]
    import functools

    data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    monkeypatch.setattr(op, "PIECE", 1000)
    assert [len(op.segments(d, np.array([0, len(d)]), 200)[0]) > 0 for d in data] == [True] * 3
    got = functools.reduce(lambda x, y: x + y, [[b.num_rows for b in op._segment_rows(200)(iter([_batch([r])]))] for r in rows])
    assert len(got) >= 9 + 5 + 3  # pieces of 1,000 windows, not one chunk per row
    assert cut(docs(spark, rows), 200) == cut_by_brute_force(rows, 200)


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0 for _ in rows]), pa.array([t for _, t in rows])],
                                      names=["doc_id", "thash", "text"])


def test_strip_keeps_columns_and_drops_emptied_rows(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(0, "alpha " + passage + " omega"), (1, passage), (2, "clean text"), (3, None), (4, " ")]
    df = with_extra(docs(spark, rows))
    got = {r.doc_id: r for r in op.strip(df).collect()}
    assert set(got) == {0, 2, 3, 4}
    assert got[0].text == "alpha  omega" and got[0].n_chars == len("alpha  omega") and got[0].kept == "x"
    assert got[2].text == "clean text" and got[3].text is None


def test_empty_table(spark):
    df = docs(spark, [(0, "x")]).limit(0)
    assert cut(df, 200) == []
    assert op.strip(df).collect() == []


def test_spans_of_repeated_rows_are_kept_once(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(300))
    for row in ((7, text), (None, text)):
        one = op.span_lists(op.repeats(docs(spark, [row] * 2), 50)).collect()
        many = op.span_lists(op.repeats(docs(spark, [row] * 40), 50)).collect()
        assert len(one) == len(many) == 1 and sorted(zip(one[0].s, one[0].e, strict=True)) == sorted(zip(many[0].s, many[0].e, strict=True))
        assert len(set(zip(many[0].s, many[0].e, strict=True))) == len(many[0].s)


def test_strip_leaves_only_the_table_it_is_read_from(spark):
    rows = list(enumerate(corpus(30, seed=6)))
    left = new_tables(spark)
    kept = op.strip(docs(spark, rows))
    assert left() == {"removals"}
    want = {i: n - gone for i, n, gone, _, _ in cut_by_brute_force(rows, op.LENGTH)}
    assert all(want[r.doc_id] - 6 <= len((r.text or "").encode()) <= want[r.doc_id] for r in kept.collect())
