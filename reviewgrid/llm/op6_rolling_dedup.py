"""Operator 6: substring dedup by Rabin-Karp hashes of every 13-word window.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window over it also starts
in a document with a smaller doc_id; windows are judged on the input, and overlapping
windows merge into maximal removal intervals.

Method. Documents are dealt into blocks by a hash of their identity. A block hashes every
window of its documents (rolling polynomial over word hashes), keeps each distinct hash
once with the smallest doc_id, and sends them, sorted and packed, one row per hash range.
Each range is counted in Spark: hashes of more than one document are found and every block
hears which of its hashes have a smaller document elsewhere, and which. The blocks then
read their documents again and cut. A window in a third of all documents is one entry per
block, so no task sees all its places; ranges and blocks grow in number with the corpus
(``WINDOWS_PER_PART`` words each), so their size does not grow.

Windows are compared by 64-bit hashes (a false match needs two different windows of one
hash; about N*N/2**65 for N distinct windows).

Defined cases: null text has no words; documents shorter than a window lose nothing; rows
of one doc_id never remove from each other, repeated rows get the same result; a row with
a null doc_id neither removes nor loses words; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identity
from .kernels import U64, Chunk, Prefix, Words, chunks, cover, runs

WIDTH = 13
WINDOWS_PER_PART = 1_000_000
LONG = pa.int64()
BIG = np.iinfo(np.int64).max


def _pack(x: np.ndarray) -> bytes:
    """Byte planes: the high bytes of sorted differences are runs of zeros, which Spark's codec removes."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(U64)


def _windows(chunk: Chunk, width: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a chunk, first words of its windows, and the windows' hashes."""
    words = Words(chunk)
    ok = words.same_row(width)
    return words, np.flatnonzero(ok), Prefix(words.hashes(chunk.data), "word").windows(width)[ok]


def _smallest(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, their smallest doc_id, and whether another doc_id has them too."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(hashes)) - 1
    return hashes[head], docs[head], docs[last] != docs[head] if len(head) else np.zeros(0, bool)


def _send(width: int, parts: int):
    """Block (key, documents) -> rows (part, block, packed hashes, packed smallest documents)."""
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ids = np.asarray(table.column("doc_id").combine_chunks())
        got = [(np.zeros(0, U64), np.zeros(0, np.int64))]
        for chunk in chunks(table.column("text")):
            words, at, h = _windows(chunk, width)
            if len(h):
                u, d, _ = _smallest(h, ids[chunk.lo:chunk.hi][words.row[at]])
                got.append((u, d))
        h, d, _ = _smallest(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]))
        span = (1 << 64) // parts + 1
        cut = np.searchsorted(h, np.array([min(k * span, (1 << 64) - 1) for k in range(1, parts)], U64))
        out = []
        for k, (lo, hi) in enumerate(zip(np.append(0, cut), np.append(cut, len(h)), strict=True)):
            if hi > lo:
                out.append((k, block, _pack(np.diff(h[lo:hi], prepend=U64(0))), _pack(d[lo:hi].view(U64))))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (LONG, LONG, pa.binary(), pa.binary()), strict=True)],
                        names=["part", "block", "hashes", "docs"])
    return run


def _count(table: pa.Table) -> pa.Table:
    """A hash range: for each block, its hashes that a smaller document elsewhere has, and that document."""
    blocks = table.column("block").to_pylist()
    hashes = [np.cumsum(_unpack(b), dtype=U64) for b in table.column("hashes").to_pylist()]
    docs = [_unpack(b).view(np.int64) for b in table.column("docs").to_pylist()]
    sizes = [len(h) for h in hashes]
    h, d = np.concatenate(hashes), np.concatenate(docs)
    b = np.repeat(np.arange(len(blocks)), sizes)
    order = np.lexsort((d, h))
    h, d, b = h[order], d[order], b[order]
    head = np.concatenate([[True], h[1:] != h[:-1]])
    least = d[head][np.cumsum(head) - 1]
    # within a block the hash may stand for several documents: every block hears of a hash seen in two blocks
    many = np.repeat(np.diff(np.append(np.flatnonzero(head), len(h))) > 1, np.diff(np.append(np.flatnonzero(head), len(h))))
    out = []
    h, least, b = h[many], least[many], b[many]
    order = np.lexsort((h, b))
    h, least, b = h[order], least[order], b[order]
    for k, blk in enumerate(blocks):
        lo, hi = np.searchsorted(b, k), np.searchsorted(b, k, side="right")
        if hi > lo:
            out.append((blk, _pack(np.diff(h[lo:hi], prepend=U64(0))), _pack(least[lo:hi].view(U64))))
    cols = list(zip(*out, strict=True)) or [()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(cols, (LONG, pa.binary(), pa.binary()), strict=True)],
                    names=["block", "hashes", "docs"])


def _apply(width: int, with_text: bool):
    """Cogroup of a block's documents and what it heard -> one row per document."""
    def run(docs: pa.Table, heard: pa.Table) -> pa.Table:
        ids = docs.column("doc_id").combine_chunks()
        known = np.asarray(ids.is_valid())
        number = np.asarray(ids.fill_null(0))
        pairs = [(np.cumsum(_unpack(a), dtype=U64), _unpack(b).view(np.int64))
                 for a, b in zip(heard.column("hashes").to_pylist(), heard.column("docs").to_pylist(), strict=True)]
        far_h = np.concatenate([np.zeros(0, U64), *(p[0] for p in pairs)])
        far_d = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in pairs)])
        # windows shared only inside the block
        seen = [(np.zeros(0, U64), np.zeros(0, np.int64))]
        found = []
        for chunk in chunks(docs.column("text")):
            words, at, h = _windows(chunk, width)
            who = number[chunk.lo:chunk.hi][words.row[at]]
            ok = known[chunk.lo:chunk.hi][words.row[at]]
            found.append((chunk, words, at, h, who, ok))
            u, d, _ = _smallest(h[ok], who[ok])
            seen.append((u, d))
        near_h, near_d, _ = _smallest(np.concatenate([x for x, _ in seen] + [far_h]), np.concatenate([x for _, x in seen] + [far_d]))
        out: list[tuple] = []
        for chunk, words, at, h, who, ok in found:
            k = np.minimum(np.searchsorted(near_h, h), max(len(near_h) - 1, 0))
            gone = ok & (near_h[k] == h) & (near_d[k] < who) if len(near_h) and len(h) else np.zeros(len(h), bool)
            mask = cover(len(words), at[gone], at[gone] + width)
            for r in range(chunk.hi - chunk.lo):
                lo, hi = words.first[r], words.first[r + 1]
                m = mask[lo:hi]
                s, e = words.start[lo:hi][~m], words.end[lo:hi][~m]
                kept = b" ".join(chunk.data[a:b].tobytes() for a, b in zip(s, e, strict=True))
                spans = runs(m)
                out.append((hi - lo, int(m.sum()), hashlib.sha256(kept).hexdigest(), len(spans[0]),
                            kept.decode("utf-8", "replace") if with_text else None))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([ids, docs.column("thash").combine_chunks(), *(pa.array(c, t) for c, t in zip(
            cols, (LONG, LONG, pa.string(), LONG, pa.string()), strict=True))],
            names=["doc_id", "thash", "n_words", "n_removed", "kept_sha256", "n_spans", "kept"])
    return run


def remove(docs: DataFrame, width: int = WIDTH, with_text: bool = True, per_part: int = WINDOWS_PER_PART) -> DataFrame:
    """doc_id, thash, n_words, n_removed, kept_sha256, n_spans and (with_text) ``kept`` for every row."""
    docs = identity(docs)
    size = docs.agg(F.sum(F.length("text")).alias("c"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-(size["c"] or 0) // (6 * per_part)))
    blocks = max(1, min(parts, size["n"]))
    dealt = docs.select("doc_id", "thash", "text", F.pmod(F.xxhash64("doc_id", "thash"), F.lit(blocks)).alias("block"))
    # both uses read the same shuffle of the documents
    sent = dealt.groupBy("block").applyInArrow(_known(_send(width, parts)), "part long, block long, hashes binary, docs binary")
    heard = sent.groupBy("part").applyInArrow(_count, "block long, hashes binary, docs binary")
    out = dealt.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(
        _apply(width, with_text), "doc_id long, thash long, n_words long, n_removed long, kept_sha256 string, n_spans long, kept string")
    return out if with_text else out.drop("kept")


def _known(f):
    """Only rows with a doc_id can remove anything."""
    def run(table: pa.Table) -> pa.Table:
        held = table.filter(table.column("doc_id").is_valid())
        return f(held if held.num_rows else table.slice(0, 1).set_column(0, "doc_id", pa.array([0], LONG)).set_column(
            2, "text", pa.array([""], pa.string())))
    return run
