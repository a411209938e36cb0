"""Divergence audit: equal to a plain version with Python integers, cases of the docstring."""

import collections
import random
import re

import numpy as np
from corpus_helpers import docs, with_extra

from reviewgrid.llm import op11_divergence as op


def brute(rows, min_docs=10, top=10):
    df, count, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        df.update((lang, t) for t in set(found))
        count.update((lang, source, t) for t in found)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for x, t in df if x == lang and df[x, t] >= min_docs]
        sources = [s for x, s in groups if x == lang]

        def share(c, n, v=len(kept)):
            return 1 + 10**9 * (c + 2) // (n + 2 * v)

        p = {}
        for s in sources:
            n = sum(count[lang, s, t] for t in kept)
            p[s] = {t: share(count[lang, s, t], n) for t in kept}
        n = sum(count[lang, s, t] for s in sources for t in kept)
        q = {t: share(sum(count[lang, s, t] for s in sources), n) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s, t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pair))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(term)[:top])]
    return sorted(out)


def rows(n=300, seed=3):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcDEñ中é") for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    out = []
    for k in range(n):
        text = rnd.choice([" ", "-", "7", "\n", "_[", "\x00"]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 40)))
        out.append((k, rnd.choice([text, text, text, None, ""]) if k % 5 else text, rnd.choice(["aa", "bb", None]), rnd.choice(["s1", "s2", "s3", "", None])))
    out += [(n + 1, "zz yy", "cc", "s1"), (n + 2, "zz", "cc", "s2"), (n + 3, None, "cc", "s3"), (n + 4, "only one", "dd", "s1")]
    return out + out[:20]


def result(df, **kw):
    return sorted(tuple(r) for r in op.audit(df, **kw).collect())


def test_equals_brute_force(spark):
    data = rows()
    df = with_extra(docs(spark, data)).repartition(5)
    want = brute(data)
    assert result(df) == want and {r[2] for r in want} == {"pair", "term"}
    assert ("cc", "s1", "pair", "s2", 0, 1) in want and not [r for r in want if r[0] == "dd"]
    # many small shards and slices, long documents in pieces
    assert result(df, shard_rows=7, slice_bytes=64) == want


def test_very_long_text(spark):
    data = [*rows(60), (900, "abc Dé " * 300_000, "aa", "s1")]
    assert result(docs(spark, data), slice_bytes=1 << 19) == brute(data)


def test_empty_table(spark):
    assert result(docs(spark, rows()).limit(0)) == []


def test_long_division():
    rnd = np.random.default_rng(1)
    total = rnd.integers(1, 9 * 10**15, 2000)
    count = (total * rnd.random(2000)).astype(np.int64)
    assert op.shares(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]
