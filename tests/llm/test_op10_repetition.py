"""Suffix-array repetition rules against brute force; cases of the docstring."""

import collections

import numpy as np
from corpus_helpers import corpus, docs, with_extra, words

from reviewgrid.llm import op10_repetition as op


def by_brute_force(text):
    w = words(text)
    n = len(w)

    def covered(size):
        seen = collections.Counter(tuple(w[k:k + size]) for k in range(n - size + 1))
        return len({k + j for k in range(n - size + 1) if seen[tuple(w[k:k + size])] > 1 for j in range(size)})

    lines = [x for x in (text or "").split("\n") if words(x)]
    longest = max((size for size in range(1, n) if covered(size)), default=0)
    five = covered(5)
    failed = n < 10 or 100 * five > 20 * n
    repeat = covered(op.MIN_REPEAT)
    kept = not failed and 100 * repeat <= op.MAX_COVERED * n and longest <= op.MAX_LONGEST
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), five, repeat, longest, failed, kept)


def test_suffix_order_is_the_order_of_suffixes():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 3, n).tolist() for n in (1, 5, 40, 90)] + [[1] * 50]
    flat = [(k, x) for k, r in enumerate(rows) for x in r]
    names = {v: i for i, v in enumerate(sorted(set(flat)))}
    end = np.repeat(np.cumsum([len(r) for r in rows]), [len(r) for r in rows])
    order = op.suffix_order(np.array([names[v] for v in flat]), end)
    assert order.tolist() == sorted(range(len(flat)), key=lambda i: flat[i:end[i]])


def test_random_corpus_and_defined_cases(spark):
    texts = corpus(60, seed=2, vocabulary=30) + [
        "a b c\na b c\n\n \na b c", "x|y #tag %% <b> & $5 *", "word " * 40, "\n\nline one two\nline one two\n",
        " ".join(f"w{i}" for i in range(100)) + " " + " ".join(f"w{i}" for i in range(15)),
        " ".join(f"w{i}" for i in range(700)) + " " + " ".join(f"w{i}" for i in range(70)), "É ñ 日本 語\r\nÉ ñ 日本 語"]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[20])]
    got = op.score(with_extra(docs(spark, rows))).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat,
                    r.base_failed, r.kept) for r in got), key=str) == sorted(((i, *by_brute_force(t)) for i, t in rows), key=str)
    assert {r.kept for r in got if not r.base_failed} == {True, False}  # the method's verdict decides too


def test_empty_table(spark):
    assert op.score(docs(spark, [(0, "x")]).limit(0)).collect() == []
