"""Small documents tables and brute-force versions for the corpus operator tests."""

import collections
import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, schema=SCHEMA):
    """rows: texts (doc_id = place) or (doc_id, text[, lang[, source]]) tuples."""
    full = []
    for k, r in enumerate(rows):
        i, text, lang, source = ((*r, None, None)[:4] if isinstance(r, tuple) else (k, r, None, None))
        full.append((i, text, lang, source, len(text) if text is not None else None))
    return spark.createDataFrame(full, schema)


def new_tables(spark):
    """A function that names the tables operators have written from now on and not discarded."""
    import os

    from reviewgrid.session import ensure_checkpoint_dir
    base = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "reviewgrid")
    there = lambda: set(os.listdir(base)) if os.path.isdir(base) else set()
    before = there()
    return lambda: {re.sub(r"^llm-|-\w+$", "", t) for t in there() - before}


def with_extra(df):
    """Columns that operators use inside, under the same names."""
    from pyspark.sql import functions as F
    for c in ("thash", "n", "row", "cid", "root", "token", "epoch", "key", "split_key", "cut_s", "near_doc", "kept"):
        df = df.withColumn(c, F.lit("x"))
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n=60, seed=1, vocabulary=400, longest=160):
    """Random texts with exact copies, near copies, shared passages, blanks, nulls and repeated lines."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeñé") for _ in range(rnd.randint(1, 6)))
    pool = [word() for _ in range(vocabulary)]
    passage = " ".join(rnd.choice(pool) for _ in range(70))
    out = [None, "", "  \n\t ", "one", "one two three", "a" * 700, "x y " * 200]
    while len(out) < n:
        kind = rnd.random()
        body = [rnd.choice(pool) for _ in range(rnd.randint(1, longest))]
        if kind < 0.2 and out[-1]:
            out.append(rnd.choice([t for t in out if t]))
        elif kind < 0.5:
            base = rnd.choice([t for t in out if t]).split(" ")
            for _ in range(rnd.randint(1, 3)):
                base[rnd.randrange(len(base))] = rnd.choice(pool)
            out.append(" ".join(base))
        elif kind < 0.7:
            at = rnd.randint(0, len(body))
            out.append(" ".join([*body[:at], passage, *body[at:]]))
        else:
            out.append(rnd.choice([" ", "\n"]).join(body))
    return out


def links_by_brute_force(rows, width=5, percent=80):
    """(doc_id, set size, smallest doc_id of the component) per row."""
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, i), i)
    return sorted((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True))


def cut_by_brute_force(rows, length):
    """(doc_id, bytes, removed, spans, digest) per row."""
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def windows_by_brute_force(rows, width=13):
    """(doc_id, words, removed, digest) per row."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                g = tuple(w[k:k + width])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k:k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)
