"""Operator 5: document quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (``FEATURES``: log and square-root
scales of counts and shares). Class means and covariances are exact sums over all
labelled training rows, added up inside the tasks; each covariance is shrunk towards the
pooled one and that towards its diagonal. The score of a text is the logistic of the
difference of the two log densities (Mahalanobis distances by the cached Cholesky
factors) and log priors.

Defined cases: null, empty and blank texts have the all-zero counts and are scored like any
other; labels that are null, or whose doc_id is null or unknown, are ignored; several
labels of a doc_id each count; with no training row of one class every score is the
share of class 1 among the rows there are (0.5 without any); repeated rows score alike;
a null doc_id is scored and never learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identity, spill
from .kernels import U64, Chunk, Prefix, Words, ascii_lower, chunks, mix

LONG = pa.int64()
LOW, HIGH, DIGIT, PUNCT, SIGN = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"#*$%&|<>!?@^~_=+{}[]\\/"))
FEATURES = ("log_words", "word_length", "distinct_words", "next_equal", "distinct_pairs", "capitals", "capital_words",
            "digits", "punctuation", "signs", "signs_in_row", "line_length", "equal_lines", "long_words", "non_ascii")


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of transformed statistics per text."""
    rows = chunk.hi - chunk.lo
    words, data = Words(chunk), chunk.data
    owner = np.repeat(np.arange(rows), np.diff(chunk.bounds))
    n = np.diff(words.first).astype(float)
    one = np.maximum(n, 1)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(words.row[mask], minlength=rows) / one

    def per_byte(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=rows) / np.maximum(np.diff(chunk.bounds), 1)

    def distinct(row: np.ndarray, value: np.ndarray) -> np.ndarray:
        by = np.lexsort((value, row))
        r, v = row[by], value[by]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        return np.bincount(r[new], minlength=rows)

    h = Prefix(mix(ascii_lower(data).astype(U64) + U64(7)), "byte").spans(words.start, words.end)
    pair_ok = words.same_row(2)
    pairs = Prefix(h, "word").windows(2)[pair_ok]
    pair_row = words.row[:len(pair_ok)][pair_ok]
    equal = np.zeros(len(h), bool)
    if len(h) > 1:
        equal[1:] = pair_ok & (h[1:] == h[:-1])
    size = (words.end - words.start).astype(float)
    signs = SIGN[data]
    double = np.zeros(len(data), bool)
    double[1:] = signs[1:] & signs[:-1] & (data[1:] == data[:-1]) & (owner[1:] == owner[:-1])
    lines = np.bincount(owner[data == 10], minlength=rows) + 1.0
    line_at = np.flatnonzero(np.concatenate([[True], (data[:-1] == 10) | (owner[1:] != owner[:-1])])[:len(data)])
    line_end = np.append(line_at[1:], len(data))
    line_row = owner[line_at] if len(line_at) else np.zeros(0, np.int64)
    line_hash = Prefix(mix(data.astype(U64) + U64(3)), "byte").spans(line_at, line_end)
    upper = HIGH[data]
    letters = np.maximum(np.bincount(owner[upper | LOW[data]], minlength=rows), 1)
    out = np.stack([
        np.log1p(n),
        np.log1p(np.bincount(words.row, weights=size, minlength=rows) / one),
        distinct(words.row, h) / one,
        np.sqrt(per_word(equal)),
        np.where(n > 1, distinct(pair_row, pairs) / np.maximum(n - 1, 1), 1.0),
        np.sqrt(np.bincount(owner[upper], minlength=rows) / letters),
        np.sqrt(per_word(upper[words.start]) if len(words) else np.zeros(rows)),
        np.sqrt(per_byte(DIGIT[data])),
        np.sqrt(np.bincount(owner[PUNCT[data]], minlength=rows) / one),
        np.sqrt(np.bincount(owner[signs], minlength=rows) / one),
        np.sqrt(np.bincount(owner[double], minlength=rows) / one),
        np.log1p(n / lines),
        np.sqrt(1 - distinct(line_row, line_hash) / np.maximum(np.bincount(line_row, minlength=rows), 1)),
        np.sqrt(per_word(size > 14)),
        np.sqrt(per_byte(data >= 128)),
    ], axis=1)
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, thash and ``x``, the statistics of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                x = statistics(chunk)
                rows = chunk.hi - chunk.lo
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, rows), batch.column(1).slice(chunk.lo, rows), lists],
                                                 names=["doc_id", "thash", "x"])

    return identity(docs).select("doc_id", "thash", "text").mapInArrow(run, "doc_id long, thash long, x array<double>")


@dataclass
class Model:
    """Means and Cholesky factors of both classes, their log determinants, and log prior odds."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 1 / (1 + np.exp(-self.odds)))
        logp = []
        for m, c, d in zip(self.means, self.factors, self.logdets, strict=True):
            z = np.linalg.solve(c, (x - m).T)
            logp.append(-0.5 * ((z * z).sum(axis=0) + d))
        return 1 / (1 + np.exp(-np.clip(logp[1] - logp[0] + self.odds, -500, 500)))


def fit(count: np.ndarray, total: np.ndarray, square: np.ndarray, shrink: float = 0.1, ridge: float = 0.05) -> Model:
    """Model from per-class counts, sums and sums of outer products."""
    n = count.astype(float)
    if n.min() < 2:
        return Model([], [], [], float(np.log((n[1] + 0.5) / (n[0] + 0.5))) if n.sum() else 0.0)
    means = [total[k] / n[k] for k in (0, 1)]
    scatter = [square[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    base = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(pooled))
    factors, logdets = [], []
    for k in (0, 1):
        c = np.linalg.cholesky((1 - shrink) * scatter[k] / n[k] + shrink * base)
        factors.append(c)
        logdets.append(2 * float(np.log(np.diag(c)).sum()))
    return Model(means, factors, logdets, float(np.log(n[1] / n[0])))


def learn(rows: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """Exact sufficient statistics over all rows of ``rows`` (doc_id, x) that carry a label."""
    d = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(1))
            for k in (0, 1):
                part = x[y == k]
                count[k] += len(part)
                total[k] += part.sum(axis=0)
                square[k] += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array([0], LONG), pa.array([np.concatenate([count, total.ravel(), square.ravel()])])],
                                         names=["k", "v"])

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).filter("y in (0, 1)")
    sums = rows.select("doc_id", "x").join(known, "doc_id").select("x", "y").mapInArrow(add, "k long, v array<double>")
    sums = sums.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    v = np.array([r["v"] for r in sums]) if sums else np.zeros(2 + 2 * d + 2 * d * d)
    return fit(v[:2], v[2:2 + 2 * d].reshape(2, d), v[2 + 2 * d:].reshape(2, d, d))


def apply(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, thash and score of every row of ``rows`` (doc_id, thash, x)."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], names=["doc_id", "thash", "score"])

    return rows.select("doc_id", "thash", "x").mapInArrow(run, "doc_id long, thash long, score double")


def assess(docs: DataFrame, labels: DataFrame, train) -> DataFrame:
    """Scores of all rows; the model sees rows for which the column ``train`` holds."""
    rows = spill(features(docs), "statistics")
    return apply(rows, learn(rows.filter(train), labels))
