"""Conversation trie: equal to a plain dictionary trie, double arrays, cases of the docstring."""

import collections
import hashlib
import random
import zlib

from corpus_helpers import with_extra

from reviewgrid.llm import op13_prefix_trie as op

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = collections.defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = sum(saved[x] for x in children[s]) + (len(members[s]) - 1) * (len(s[-1][1]) if s else 0)
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s],
                    hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items()), key=str)


def conversations(n=250, seed=2, hot=0.4):
    rnd = random.Random(seed)
    say = lambda: (rnd.choice(["user", "bot", None]), rnd.choice(["hi", "hé llo", "ok", "bye", "", None, "long " * 30]))
    bodies = [[say() for _ in range(rnd.randint(1, 9))] for _ in range(25)]
    rows = []
    for c in range(n):
        if rnd.random() < 0.1:
            continue  # absent, now and then a base
        turns = list(rnd.choice(bodies)) if rnd.random() < hot else [say() for _ in range(rnd.randint(1, 9))]
        if rnd.random() < 0.3:
            turns[-1] = ("user", f"end {c}")
        order = sorted(rnd.sample(range(50), len(turns)))
        order[0] = None if rnd.random() < 0.2 else order[0]
        rows += [(c * 7 - 300, t, *x) for t, x in zip(order, turns, strict=True)]
    rnd.shuffle(rows)
    return rows


def result(df, **kw):
    return sorted((tuple(r) for r in op.nodes(df, **kw).select(*op.RESULT).collect()), key=str)


def test_equals_brute_force(spark):
    rows = conversations()
    df = with_extra(spark.createDataFrame(rows, SCHEMA)).repartition(4)
    want = brute(rows)
    assert result(df) == want and sum(r[3] > 1 for r in want) > 20
    # upper nodes at every depth, and running sums over many blocks
    assert result(df, shard_turns=6, block=2) == want


def test_hot_prefix_and_copies(spark):
    rows = [(c, t, "u", "same" if t < 4 or c % 3 else f"x{c}") for c in range(120) for t in range(8)]
    rows += [(500, t, "u", f"t{t}") for t in range(300)]  # one conversation with a third of all turns
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert result(df) == want
    assert result(df, shard_turns=50, block=64) == want


def test_defined_cases(spark):
    rows = [(None, 0, "u", "lost"), (200, None, None, None), (200, 1, "u", "a"), (200, 1, "u", "a"), (203, 5, "u", "b" * 3_000_000),
            (301, 0, "u", "x"), (301, 1, "u", "y"), (302, 0, "u", "x"), (302, 1, "u", "y"), (303, 0, "u", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == brute(rows)
    assert result(df.limit(0)) == []
    one = [(700, 0, "u", "only")]
    assert result(spark.createDataFrame(one, SCHEMA)) == brute(one)


def test_double_array():
    rnd = random.Random(3)
    sequences = sorted({tuple(rnd.choice(range(40)) for _ in range(rnd.randint(1, 6))) for _ in range(400)})
    trie = op.DoubleArray([list(s) for s in sequences], 40)
    state = {(): 0}
    for s in sequences:
        for d in range(len(s)):
            at = trie.child(state[s[:d]], s[d])
            assert at > 0 and state.setdefault(s[:d + 1], at) == at
    assert len(set(state.values())) == len(state) == len(trie.order)
    for s, at in state.items():  # no other child is found
        assert {c for c in range(40) if trie.child(at, c) >= 0} == {x[len(s)] for x in state if len(x) == len(s) + 1 and x[:len(s)] == s}
