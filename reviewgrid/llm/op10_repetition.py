"""Operator 10: quality rules with suffix-array repetition.

Each text's words form a suffix array (prefix doubling, all texts of a chunk together and
only what is still tied). Common prefixes of neighbouring suffixes follow by binary search
on rolling hashes. At a suffix, the larger of the common prefixes with its two neighbours
is the longest repeated string that starts there; the longest-common-prefix intervals of
``min_repeat`` words and more give the maximal repeats, whose spans are united. A text is
kept if it passes the base rules, at most ``max_covered`` percent of its words lie in such
repeats, and no repeat is longer than ``max_longest`` words.

Base figures: word_chars (code points in words), n_symbols (``[#*$%&|<>]``), n_dup_lines
(lines with a word equal to an earlier line), n_repeat_words (words in 5-word windows found
twice or more, the first included). ``base_failed``: under 10 words, or more than 20 % of
the words repeated in that sense.

Defined cases: null or blank text has no words and fails the base; repeated rows score
alike; a null doc_id is kept as null; one text of any length is one chunk and is never
cut; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import identity
from .kernels import _TABLE, Chunk, Prefix, Words, chunks, cover, runs

MIN_REPEAT = 8
MAX_COVERED = 20
MAX_LONGEST = 60
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
LONG = pa.int64()


def suffix_order(first_rank: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in suffix order. ``first_rank``: rank of (row, word); ``end``: end of each position's row."""
    n = len(first_rank)
    rank = first_rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        tied = np.zeros(n, bool)  # positions whose rank is shared
        same = rank[order][1:] == rank[order][:-1]
        tied[order[1:][same]] = True
        tied[order[:-1][same]] = True
        at = order[tied[order]]
        if not len(at):
            return order
        ahead = at + step
        follow = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)], -1)
        slots = np.flatnonzero(tied[order])
        by = np.lexsort((follow, rank[at]))
        at, follow, old = at[by], follow[by], rank[at][by]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])
        # a rank is the slot at which its group begins, so groups split without moving others
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step *= 2


def common_prefixes(order: np.ndarray, end: np.ndarray, row: np.ndarray, prefix: Prefix) -> np.ndarray:
    """Words that each suffix shares with its predecessor in the order (0 across rows)."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    low = np.zeros(len(a), np.int64)
    high = np.where(row[a] == row[b], np.minimum(end[a] - a, end[b] - b), 0)
    while (low < high).any():
        open_ = np.flatnonzero(low < high)
        mid = (low[open_] + high[open_] + 1) // 2
        eq = prefix.spans(a[open_], a[open_] + mid) == prefix.spans(b[open_], b[open_] + mid)
        low[open_[eq]] = mid[eq]
        high[open_[~eq]] = mid[~eq] - 1
    return np.concatenate([[0], low])


def longest_repeats(words: Words, data: np.ndarray) -> np.ndarray:
    """For each word of a chunk: length of the longest string starting there that its text repeats."""
    if not len(words):
        return np.zeros(0, np.int64)
    h = words.hashes(data)
    by = np.lexsort((h, words.row))
    head = np.concatenate([[True], (h[by][1:] != h[by][:-1]) | (words.row[by][1:] != words.row[by][:-1])])
    rank = np.empty(len(h), np.int64)
    rank[by] = np.flatnonzero(head)[np.cumsum(head) - 1]
    end = words.first[words.row + 1]
    order = suffix_order(rank, end)
    lcp = common_prefixes(order, end, words.row, Prefix(h, "word"))
    out = np.empty(len(h), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def _per_row(words: Words, rows: int, mask: np.ndarray) -> np.ndarray:
    return np.bincount(words.row[mask], minlength=rows)


def figures(chunk: Chunk, min_repeat: int) -> dict[str, np.ndarray]:
    """All figures of the rows of a chunk."""
    rows = chunk.hi - chunk.lo
    words = Words(chunk)
    n = np.diff(words.first)
    data = chunk.data
    bytes_row = np.repeat(np.arange(rows), np.diff(chunk.bounds))
    ahead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.bincount(words.row, weights=ahead[words.end] - ahead[words.start], minlength=rows).astype(np.int64)
    symbols = np.bincount(bytes_row[SYMBOLS[data]], minlength=rows)
    # lines
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([chunk.bounds[:-1][np.diff(chunk.bounds) > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    stop = np.minimum(np.append(begin[1:], len(data)), chunk.bounds[1:][chunk.row_of(begin)]) if len(begin) else begin
    stop = np.where((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(begin) else stop
    has_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop = begin[has_word], stop[has_word]
    line_row = chunk.row_of(begin)
    line = Prefix(_TABLE[data], "byte").spans(begin, stop)
    by = np.lexsort((line, line_row))
    again = np.concatenate([[False], (line[by][1:] == line[by][:-1]) & (line_row[by][1:] == line_row[by][:-1])])[:len(by)]
    dup_lines = np.bincount(line_row[by][again], minlength=rows)
    longest = longest_repeats(words, data)
    five = np.flatnonzero(longest >= 5)
    big = np.flatnonzero(longest >= min_repeat)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, words.row, longest)
    covered = cover(len(words), big, big + longest[big])
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
            "n_repeat_words": _per_row(words, rows, cover(len(words), five, five + 5)),
            "covered_words": _per_row(words, rows, covered), "longest_repeat": top,
            "n_spans": np.bincount(words.row[runs(covered)[0]], minlength=rows) if len(words) else np.zeros(rows, np.int64)}


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_spans")


def score(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, thash, the figures, base_failed and kept, for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                f = figures(chunk, min_repeat)
                n = f["n_words"]
                failed = (n < 10) | (100 * f["n_repeat_words"] > 20 * n)
                kept = ~failed & (100 * f["covered_words"] <= max_covered * n) & (f["longest_repeat"] <= max_longest)
                rows = chunk.hi - chunk.lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.lo, rows), batch.column(1).slice(chunk.lo, rows),
                     *(pa.array(f[k], LONG) for k in FIGURES), pa.array(failed), pa.array(kept)],
                    names=["doc_id", "thash", *FIGURES, "base_failed", "kept"])

    return identity(docs).select("doc_id", "thash", "text").mapInArrow(
        run, "doc_id long, thash long, " + ", ".join(f"{k} long" for k in FIGURES) + ", base_failed boolean, kept boolean")
