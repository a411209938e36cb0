"""Operator 4: exact substring removal by deep-shallow suffix sorting.

Every byte covered by a ``length``-byte string that also starts anywhere else (another
document, or another place of the same one) is found; matches never cross documents.

Method. A window of ``length`` bytes is anchored at its leftmost minimal ``KMER``-byte
gram, so equal windows have equal anchors at equal offsets. Consecutive windows with
one anchor form a segment (some 85 windows, one row). Equal segments are counted
before anything is shuffled again; an anchor seen once cannot repeat. Distinct segments
of one anchor are then suffix sorted: what follows the anchor, and what precedes it read
backwards, is ordered by multikey quicksort on 8-byte words down to ``SHALLOW`` bytes,
and groups still tied are ordered by blind tries, which also give the longest common
prefixes. A window starting l bytes before the anchor repeats if some other segment
agrees for l bytes to the left and ``length - l`` to the right; merging the neighbours
of the left order by falling common prefix while watching neighbours in the right order
finds all such l without comparing all pairs.

An anchor with more than ``HOT`` distinct segments (a passage in very many documents, at
the passage's ends) is dealt out by window instead: its windows are keyed by anchor,
offset and content and meet only their equals, which are counted with map-side
combining. So no task holds a hot anchor, and nothing is capped.

Defined cases: null text is empty; rows shorter than ``length`` have no window; a
repeated row repeats all its strings (each row loses them); null doc_ids take part like
others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, discard, identity, null_safe, on_identity, spill, split, unused
from .kernels import Prefix, U64, _TABLE, chunks, cover, int64, mix, runs, sliding_min

LENGTH = 200
KMER = 24
SHALLOW = 16
HOT = 20_000
PIECE = 1 << 22  # longer rows are anchored piece by piece (positions take 24 bits)
LONG = pa.int64()


def segments(data: np.ndarray, bounds: np.ndarray, length: int):
    """Segments of the rows of one byte array: row, first window, windows, anchor offset, two hashes."""
    n = len(data)
    size = np.diff(bounds)
    windows = np.maximum(size - length + 1, 0)
    kmer = min(KMER, length)
    if not windows.sum():
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U64)] * 2
    prefix = Prefix(_TABLE[data], "byte")
    gram = prefix.windows(kmer)
    low = np.uint64((1 << 24) - 1)
    ranked = (gram & ~low) | np.arange(len(gram), dtype=U64)
    best = sliding_min(ranked, length - kmer + 1)
    row = np.repeat(np.arange(len(size)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(bounds[:-1], windows)
    anchor = (best[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    start, anchor, row = at[head], anchor[head], row[head]
    return [row, start - bounds[row], count, anchor - start, mix(gram[anchor] + U64(99)),
            prefix.spans(start, start + count - 1 + length)]


def _segment_rows(length: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for chunk in chunks(batch.column(2)):
                n = len(chunk.data)
                cuts = range(0, n, PIECE) if n > PIECE and chunk.hi - chunk.lo == 1 else [0]
                for cut in cuts:
                    if len(cuts) > 1:
                        data = chunk.data[cut:cut + PIECE + length - 1]
                        found = segments(data, np.array([0, len(data)]), length)
                    else:
                        found = segments(chunk.data, chunk.bounds, length)
                    row, start, count, off, anchor, whole = found
                    pick = pa.array(row + chunk.lo)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pick), hashes.take(pick), pa.array(start + cut, LONG), pa.array(count, LONG),
                         pa.array(off, LONG), pa.array(int64(anchor), LONG), pa.array(int64(whole), LONG)],
                        names=["doc_id", "thash", "start", "cnt", "off", "anchor", "seg"])
    return emit


def _common(a: bytes, b: bytes) -> int:
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


class BlindTrie:
    """Patricia trie that keeps only branching depths; strings are read again to place a new one."""

    def __init__(self, first: int, text: list[bytes]):
        self.text = text
        self.root: list | int = first  # node: [depth, {byte or -1: child}]; leaf: index
        self.same: dict[int, list[int]] = {first: [first]}

    def _next(self, node: list, s: bytes):
        return node[1].get(s[node[0]] if node[0] < len(s) else -1)

    def insert(self, i: int) -> None:
        s, node = self.text[i], self.root
        while isinstance(node, list):
            node = self._next(node, s) if self._next(node, s) is not None else next(iter(node[1].values()))
        leaf = node
        depth = _common(s, self.text[leaf])
        if depth == len(s) == len(self.text[leaf]):
            self.same[leaf].append(i)
            return
        self.same[i] = [i]
        up, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            up, node = node, self._next(node, s)
        mark = s[depth] if depth < len(s) else -1
        if isinstance(node, list) and node[0] == depth:
            node[1][mark] = i
            return
        other = self.text[leaf]
        made = [depth, {mark: i, other[depth] if depth < len(other) else -1: node}]
        if up is None:
            self.root = made
        else:
            up[1][s[up[0]] if up[0] < len(s) else -1] = made

    def ordered(self) -> tuple[list[int], list[int]]:
        """Indices in order, and each one's common prefix with the one before it."""
        order: list[int] = []
        lcp: list[int] = []
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, list):
                kids = sorted(node[1].items())
                for k in range(len(kids) - 1, -1, -1):
                    stack.append((kids[k][1], before if k == 0 else node[0]))
            else:
                for k, i in enumerate(self.same[node]):
                    order.append(i)
                    lcp.append(before if k == 0 else len(self.text[i]))
        return order, lcp


def deep_shallow(group: np.ndarray, text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings inside their groups; returns order and common prefix with the predecessor (-1: other group)."""
    n = len(text)
    words = np.frombuffer(b"".join(t[:SHALLOW].ljust(SHALLOW, b"\0") for t in text), ">u8").reshape(n, -1)
    order = np.argsort(group, kind="stable")
    tied = group.astype(np.int64)
    for d in range(words.shape[1]):  # multikey: only what the words so far leave tied is told apart
        order = order[np.lexsort((words[order, d], tied[order]))]
        new = np.ones(n, bool)
        new[1:] = (tied[order][1:] != tied[order][:-1]) | (words[order, d][1:] != words[order, d][:-1])
        tied = np.empty(n, np.int64)
        tied[order] = np.cumsum(new)
        if new.all():
            break
    lcp = np.full(n, -1, np.int64)
    out = order.copy()
    heads = np.flatnonzero(np.concatenate([[True], tied[order][1:] != tied[order][:-1]])) if n else np.zeros(0, int)
    for lo, hi in zip(heads, np.append(heads[1:], n), strict=True):
        if hi - lo > 1:
            trie = BlindTrie(int(order[lo]), text)
            for i in order[lo + 1:hi]:
                trie.insert(int(i))
            out[lo:hi], lcp[lo:hi] = trie.ordered()
        if lo and group[out[lo]] == group[out[lo - 1]]:
            lcp[lo] = _common(text[out[lo]], text[out[lo - 1]])
        elif hi > lo:
            lcp[lo] = -1
    return out, lcp


def repeated_offsets(text: list[bytes], off: list[int], left: list[tuple[int, int]], rank: dict[int, int],
                     length: int) -> Iterator[tuple[int, int, int]]:
    """(member, lowest l, highest l) of the windows of one anchor's distinct segments that repeat.

    ``left``: members in the order of their reversed left contexts with common prefixes;
    ``rank``: place of each member in the order of right contexts.
    """
    right = {i: text[i][off[i]:off[i] + length] for i in rank}
    owner = {i: i for i in rank}
    cluster = {i: [i] for i in rank}
    steps = sorted(((lcp, left[k - 1][0], left[k][0]) for k, (_, lcp) in enumerate(left) if k), reverse=True)
    at = 0
    while at < len(steps):
        depth, grown = steps[at][0], set()
        while at < len(steps) and steps[at][0] == depth:
            a, b = owner[steps[at][1]], owner[steps[at][2]]
            if len(cluster[a]) < len(cluster[b]):
                a, b = b, a
            for i in cluster[b]:
                owner[i] = a
            cluster[a] += cluster.pop(b)
            grown.discard(b)
            grown.add(a)
            at += 1
        for a in grown:
            members = sorted(cluster[a], key=rank.__getitem__)
            shared = [_common(right[x], right[y]) for x, y in zip(members, members[1:], strict=False)]
            for k, i in enumerate(members):
                r = max(shared[k - 1] if k else 0, shared[k] if k < len(shared) else 0)
                if length - r <= depth:
                    yield i, length - r, depth


def _sort_rows(length: int):
    """Rows (anchor, seg, n, off, cnt, bytes), all of an anchor together -> (anchor, seg, s, e)."""
    def solve(anchor: list[int], seg: list[int], n: list[int], off: list[int], cnt: list[int], text: list[bytes]) -> pa.RecordBatch:
        ids = np.unique(np.array(anchor, np.int64), return_inverse=True)[1]
        rorder, _ = deep_shallow(ids, [t[o:o + length] for t, o in zip(text, off, strict=True)])
        lorder, llcp = deep_shallow(ids, [t[:o][::-1] for t, o in zip(text, off, strict=True)])
        place = np.empty(len(ids), np.int64)
        place[rorder] = np.arange(len(ids))
        out: list[tuple[int, int, int, int]] = []
        edges = np.append(np.flatnonzero(llcp == -1), len(ids))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            members = lorder[lo:hi].tolist()
            for i, low, high in repeated_offsets(text, off, list(zip(members, llcp[lo:hi].tolist(), strict=True)),
                                                 {i: int(place[i]) for i in members}, length):
                low, high = max(low, off[i] - cnt[i] + 1), min(high, off[i])
                if n[i] < 2 and low <= high:
                    out.append((anchor[i], seg[i], off[i] - high, off[i] - low + 1))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, LONG) for c in cols], names=["anchor", "seg", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                for h, c in zip(held, batch.slice(lo, 20_000).columns, strict=True):
                    h += c.to_pylist()
                last = held[0][-1]
                cut = len(held[0])
                while cut and held[0][cut - 1] == last:
                    cut -= 1  # the last anchor may go on in the next batch
                if cut:
                    yield solve(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
        if held[0]:
            yield solve(*held)
    return run


def _window_rows(length: int):
    """Rows of hot anchors, one per window: anchor, seg, n, window number, hash of anchor, offset and content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, seg, n, off, cnt = (np.asarray(batch.column(k)) for k in range(5))
            for chunk in chunks(batch.column(5)):
                sel = slice(chunk.lo, chunk.hi)
                windows = cnt[sel]
                row = np.repeat(np.arange(len(windows)), windows)
                k = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                at = chunk.bounds[:-1][row] + k
                content = Prefix(_TABLE[chunk.data], "byte").spans(at, at + length)
                back = (off[sel][row] - k).astype(U64)
                key = mix(content ^ mix(anchor[sel][row].view(U64) + back))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[sel][row], LONG), pa.array(seg[sel][row], LONG), pa.array(n[sel][row], LONG),
                     pa.array(k, LONG), pa.array(int64(key), LONG)], names=["anchor", "seg", "n", "k", "key"])
    return run


def _repeated(docs: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Tables of the segments and of the repeated strings in them, which ``_spans`` joins."""
    docs = identity(docs)
    found = spill(docs.select("doc_id", "thash", "text").mapInArrow(
        _segment_rows(length), "doc_id long, thash long, start long, cnt long, off long, anchor long, seg long"), "segments")
    classes = found.groupBy("anchor", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "thash", "start", "cnt", "off")).alias("rep"))
    sizes = classes.groupBy("anchor").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("m")).filter("rows > 1")
    classes = spill(classes.join(sizes, "anchor").select("anchor", "seg", "n", "m", "rep.*"), "segment-classes")
    whole = classes.filter("n > 1").select("anchor", "seg", F.lit(0).cast("long").alias("s"), F.col("cnt").alias("e"))

    several = classes.filter("m > 1")
    holders, _ = split(docs, KeyFilter(several.select(F.xxhash64("doc_id", "thash"))))
    body = (several.join(holders.withColumnsRenamed({"doc_id": "d", "thash": "t"}),
                         several["doc_id"].eqNullSafe(F.col("d")) & (several["thash"] == F.col("t")))
            .select("anchor", "seg", "n", "off", "cnt", "m",
                    F.substring(F.encode("text", "UTF-8"), (F.col("start") + 1).cast("int"),
                                (F.col("cnt") + length - 1).cast("int")).alias("bytes"))
            .dropDuplicates(["anchor", "seg"]))  # repeated rows of the representative
    body = spill(body, "segment-texts")
    plain = ["anchor", "seg", "n", "off", "cnt", "bytes"]
    ranges = "anchor long, seg long, s long, e long"
    sorted_ = (body.filter(F.col("m") <= hot).select(*plain).repartition("anchor").sortWithinPartitions("anchor", "seg")
               .mapInArrow(_sort_rows(length), ranges))
    windows = body.filter((F.col("m") > hot)).select(*plain).mapInArrow(
        _window_rows(length), "anchor long, seg long, n long, k long, key long")
    twice = windows.groupBy("key").agg(F.sum("n").alias("total")).filter("total > 1").select("key")
    dealt = windows.join(twice, "key", "left_semi").select("anchor", "seg", F.col("k").alias("s"), (F.col("k") + 1).alias("e"))
    hits = spill(whole.union(sorted_).union(dealt), "repeated-segments")
    discard(classes, body)
    return found, hits


def _spans(found: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    return found.join(hits, ["anchor", "seg"]).select(
        "doc_id", "thash", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e") - 1 + length).alias("e"))


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Spans of repeated strings: doc_id, thash, s, e (bytes; spans of a row may overlap)."""
    return _spans(*_repeated(docs, length, hot), length)


def _cut(listed: bool, with_text: bool):
    """Rows doc_id, thash, text[, span starts, span ends] -> counts, digest and kept text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                rows = chunk.hi - chunk.lo
                out: list[tuple] = []
                for k in range(rows):
                    text, gone, spans = chunk.text(k), 0, 0
                    s = batch.column(3)[chunk.lo + k].values if listed else None
                    if s is not None and len(s):
                        mask = cover(len(text), np.asarray(s), np.asarray(batch.column(4)[chunk.lo + k].values))
                        gone, spans = int(mask.sum()), len(runs(mask)[0])
                        text = chunk.data[chunk.bounds[k]:chunk.bounds[k + 1]][~mask].tobytes()
                    out.append((len(text) + gone, gone, spans, hashlib.sha256(text).hexdigest(), text))
                cols = list(zip(*out, strict=True))
                arrays = [batch.column(0).slice(chunk.lo, rows), batch.column(1).slice(chunk.lo, rows),
                          *(pa.array(c, LONG) for c in cols[:3]), pa.array(cols[3], pa.string())]
                names = ["doc_id", "thash", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays.append(pa.array([t.decode("utf-8", "ignore") for t in cols[4]], pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def span_lists(spans: DataFrame) -> DataFrame:
    """doc_id, thash and the arrays ``s``, ``e`` of distinct spans: repeated rows bring each of theirs many times."""
    sets = spans.groupBy("doc_id", "thash").agg(F.collect_set(F.struct("s", "e")).alias("p"))
    return sets.select("doc_id", "thash", "p.s", "p.e")


def remove(docs: DataFrame, spans: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, thash, n_bytes, n_removed, n_spans, kept_sha256 and (with_text) ``kept``.

    ``kept`` is the remaining bytes as text; a character cut in the middle loses its other
    bytes too. The digest is of the remaining bytes themselves. Rows without a span are
    finished where they are read; only the others are shuffled to meet their spans.
    """
    docs = identity(docs)
    lists = spill(span_lists(spans), "removals")
    some, none = split(docs, KeyFilter(lists.select(F.xxhash64("doc_id", "thash"))))
    joined = some.alias("d").join(lists.alias("l"), null_safe(some, lists, ["doc_id", "thash"]), "left").select(
        "d.doc_id", "d.thash", "d.text", "l.s", "l.e")
    schema = "doc_id long, thash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")
    return joined.mapInArrow(_cut(True, with_text), schema).union(none.select("doc_id", "thash", "text").mapInArrow(_cut(False, with_text), schema))


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (and ``n_chars``, if there, brought up to date).

    Rows of which nothing but white space is left are dropped; rows that had nothing else
    to begin with, and all other columns, stay as they are.
    """
    tables = _repeated(docs, length, HOT)
    lists = spill(span_lists(_spans(*tables, length)), "removals")
    discard(*tables)
    some, none = split(docs, KeyFilter(lists.select(F.xxhash64("doc_id", "thash"))))
    names = [unused(docs, f"cut_{k}") for k in ("doc", "hash", "s", "e")]
    lists = lists.toDF(*names)
    joined = some.join(lists, on_identity(some, lists, *names[:2]), "left").drop(*names[:2])
    columns = docs.columns
    at, width = columns.index("text"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stays = [], []
            for text, s, e in zip(batch.column(at).to_pylist(), batch.column(width), batch.column(width + 1), strict=True):
                if text and s.values is not None and len(s.values):
                    raw = np.frombuffer(text.encode(), np.uint8)
                    left = raw[~cover(len(raw), np.asarray(s.values), np.asarray(e.values))].tobytes().decode("utf-8", "ignore")
                    stays.append(bool(left.strip()))
                    text = left
                else:
                    stays.append(True)
                texts.append(text)
            arrays = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:width])]
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(stays, pa.bool_()))

    out = joined.mapInArrow(run, docs.schema).union(none)
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind in ("int", "bigint") else out
