"""Operator 12: harmonic packing of token sequences.

A document's ids (byte-level BPE, then one end id) are cut into pieces and the pieces are
packed into sequences of ``capacity`` ids. The piece lengths from 1 to the capacity are
partitioned into reciprocal classes: class k holds the lengths in (capacity/(k+1),
capacity/k], and a bin of class k takes exactly k pieces, so a bin needs no search and no
knowledge of other bins. Every Spark task fills its own bins and nothing is shuffled.

Cuts are chosen so that bins come out full: a piece of length s wastes
``(capacity - k*s) / k`` ids, and ``cut_table`` finds for every length the cuts that
minimise waste plus ``cut_price`` ids for each piece (whole sequences come first). What is left in
unfinished bins when a task ends is laid end to end and cut at the capacity, the rest of
that at powers of two, which need no padding.

Tokens are those of a byte-level BPE file. A text longer than ``PIECE_CHARS`` is read
whole, in pieces cut before a single space between two non-spaces, where pre-tokens always
meet; a longer stretch without such a space stays one piece. The strings of special tokens
are ordinary text.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept;
repeated rows are documents of their own; further columns, whatever their names, are
ignored; an empty table gives no row. ``sequence_id`` is the task's partition number times
2**32 plus a count, so a repeated task gives the same ids over the same files.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ship_package

CAPACITY = 1024
END = 0
CUT_PRICE = 2.0
PIECE_CHARS = 1 << 17
SLICE_DOCS = 256
#: FIXED VALUE: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text -> ids for a byte-level BPE file of ``tokenizers``.

    Where the file numbers its tokens in the order of their merges, its vocabulary is a table
    of ranks and ``tiktoken`` gives the same ids several times faster; else ``tokenizers`` encodes.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    ids = [vocab["".join(p)] for p in pairs]
    plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and not spec["normalizer"] and not spec["model"].get("ignore_merges") and all(x < y for x, y in zip(ids, ids[1:], strict=False)):
        to_byte = {c: b for b, c in _byte_letters().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}


def cut_points(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` in pieces of about ``size`` characters whose encodings concatenate to that of the whole."""
    out, lo = [], 0
    while len(text) - lo > size:
        m = SAFE.search(text, lo + size)
        if not m:
            break
        out.append(text[lo:m.start()])
        lo = m.start()
    return [*out, text[lo:]]


def document_ids(encode: Callable[[str], list[int]], text: str | None, end: int = END) -> np.ndarray:
    parts = [np.array(encode(p), np.uint32) for p in cut_points(text)] if text else []
    return np.concatenate([*parts, np.array([end], np.uint32)])


@lru_cache(maxsize=8)
def cut_table(capacity: int, cut_price: float) -> list[list[int]]:
    """For every length up to the capacity its cuts, longest first (see the module notes)."""
    sizes = np.arange(1, capacity + 1)
    k = capacity // sizes
    price = cut_price + (capacity - k * sizes) / k  # of one piece of each size
    cost, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for n in range(1, capacity + 1):
        total = price[:n] + cost[n - sizes[:n]]
        take[n] = n - int(np.argmin(total[::-1]))  # the longest of equals
        cost[n] = total[take[n] - 1]
    table: list[list[int]] = [[]]
    for n in range(1, capacity + 1):
        table.append(sorted([int(take[n]), *table[n - take[n]]], reverse=True))
    return table


class Packer:
    """The open bins of one task. A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, cut_price: float, first_id: int):
        self.capacity, self.cuts = capacity, cut_table(capacity, cut_price)
        self.open: dict[int, list[tuple]] = {}
        self.next_id = first_id
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, lo = len(ids), 0
        whole = [self.capacity] * (n // self.capacity)
        for size in whole + self.cuts[n % self.capacity]:
            k = self.capacity // size
            members = self.open.setdefault(k, [])
            members.append((doc, lo, ids[lo:lo + size].copy() if k > 1 else ids[lo:lo + size], n))
            lo += size
            if len(members) == k:
                self._close(self.open.pop(k))

    def finish(self) -> None:
        """Lay what is left end to end; cut at the capacity, the rest at powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        rest = sum(len(p[2]) for p in left)
        room, members = min(self.capacity, rest), []
        if rest < self.capacity:
            room = 1 << rest.bit_length() - 1 if rest else 0
        for doc, start, ids, total in left:
            lo = 0
            while lo < len(ids):
                took = min(room, len(ids) - lo)
                members.append((doc, start + lo, ids[lo:lo + took], total))
                lo, room, rest = lo + took, room - took, rest - took
                if not room:
                    self._close(members)
                    members = []
                    room = self.capacity if rest >= self.capacity else 1 << max(rest, 1).bit_length() - 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END,
         cut_price: float = CUT_PRICE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. ``docs`` needs doc_id and text."""
    ship_package(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(capacity, cut_price, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_DOCS):
                part = batch.slice(lo, SLICE_DOCS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    packer.add(doc, document_ids(encode, text.as_py(), end))
                    if len(packer.rows) > 4096:
                        yield packer.batch()
        packer.finish()
        yield packer.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_ids, documents, ids. A sequence has at most
    ``capacity`` pieces, so its group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"), F.countDistinct("doc_id").alias("documents"),
        F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
