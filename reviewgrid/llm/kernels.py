"""Vectorised text kernels used inside Spark tasks (numpy over Arrow buffers).

A task sees one Arrow batch at a time and works through it in chunks of about
``CHUNK_BYTES`` of UTF-8, so memory does not depend on batch or table size; one
longer document is a chunk of its own. Hashes are Rabin-Karp polynomials modulo
2**64 over a random byte table, taken from prefix sums (``(C[e]-C[s]) * r**-s``),
then scrambled; the table and multipliers are fixed by a seed so every task and
every rerun agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_R = {"byte": 0x9E3779B97F4A7C15 | 5, "word": 0xD1342543DE82EF95}
_POW: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n (kept between calls)."""
    have = _POW.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        r = _R[kind]
        inv = pow(r, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, x, U64))[:-1]])
                         for x in (r, inv))
        _POW[kind] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Prefix sums from which the hash of any span of ``values`` follows."""

    def __init__(self, values: np.ndarray, kind: str):
        p, self._inv = powers(kind, len(values) + 1)
        self._c = np.zeros(len(values) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(values * p[:len(values)], out=self._c[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._c[ends] - self._c[starts]) * self._inv[starts]
                       + (ends - starts).astype(U64) * U64(0x632BE59BD9B4E019))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of every ``width`` consecutive values."""
        n = len(self._c) - width
        if n <= 0:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            return mix((self._c[width:] - self._c[:n]) * self._inv[:n] + U64(width))


class Chunk:
    """Rows [lo, hi) of a batch: their bytes in one array, and each row's bounds in it."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray):
        self.lo, self.hi, self.data, self.bounds = lo, hi, data, bounds

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """Row (from 0 in the chunk) of byte positions; empty rows own none."""
        return np.searchsorted(self.bounds[1:], at, side="right")

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string or binary column into chunks; nulls are empty rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    bounds = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Chunk(lo, hi, raw[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
        lo = hi


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 9) & (data <= 13))


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte spans, row, and first word of each row."""

    def __init__(self, chunk: Chunk):
        data, bounds = chunk.data, chunk.bounds
        n = len(data)
        inside = ~spaces(data)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True  # rows are never joined
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:n + 1])) + 1
        self.row = chunk.row_of(self.start)
        self.first = np.searchsorted(self.row, np.arange(chunk.hi - chunk.lo + 1))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return Prefix(_TABLE[data], "byte").spans(self.start, self.end)

    def same_row(self, width: int) -> np.ndarray:
        """For each word: do ``width`` words of its row start here?"""
        n = len(self.row) - width + 1
        return self.row[:n] == self.row[width - 1:] if n > 0 else np.zeros(0, bool)


def byte_prefix(data: np.ndarray) -> Prefix:
    return Prefix(_TABLE[data], "byte")


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def cover(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of ``length`` positions covered by the spans."""
    turn = np.zeros(length + 1, np.int64)
    np.add.at(turn, starts, 1)
    np.add.at(turn, ends, -1)
    return np.cumsum(turn[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def int64(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed values (Spark's long)."""
    return np.ascontiguousarray(x).view(np.int64)
