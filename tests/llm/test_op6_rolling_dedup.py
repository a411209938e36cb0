"""Rolling-hash window dedup against brute force; cases of the docstring."""

from corpus_helpers import corpus, docs, windows_by_brute_force, with_extra

from reviewgrid.llm import op6_rolling_dedup as op


def cut(df, **options):
    out = op.remove(df, with_text=False, **options)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=str)


def test_random_corpus_over_many_blocks_and_ranges(spark):
    texts = corpus(90, seed=3)
    rows = [*enumerate(texts), (9, texts[9]), (None, texts[12]), (500, texts[30]), (500, texts[31])]
    df = with_extra(docs(spark, rows))
    want = windows_by_brute_force(rows)
    assert cut(df, per_part=300) == want
    assert cut(df) == want


def test_texts_and_spans(spark):
    p = " ".join(f"p{i}" for i in range(13))
    got = {r.doc_id: r for r in op.remove(docs(spark, [(0, p), (1, "a " + p + " b"), (2, p + " c " + p)])).collect()}
    assert got[0].n_removed == 0 and got[0].kept == p
    assert got[1].kept == "a b" and got[1].n_spans == 1
    assert got[2].kept == "c" and got[2].n_spans == 2


def test_empty_table_and_null_ids(spark):
    assert cut(docs(spark, [(0, "x")]).limit(0)) == []
    rows = [(None, "w " * 20), (None, "w " * 20), (1, None)]
    assert cut(docs(spark, rows)) == windows_by_brute_force(rows)
