"""Operator 7: language identification with a linear-chain conditional random field.

Every word (run of letters; a run over 40 is cut into consecutive words of 40) of a text gets a posterior over the learned languages
by forward-backward. Emission features are hashed: prefixes and suffixes of one to
three letters, letter trigrams, the script of the first letter, and the word itself
(the lexicon). Transition weights are learned with the emissions on sequences cut
from documents of different languages and laid end to end, so the model has seen
switches. A document's language is the one with the largest summed posterior and
its score is that share of its words.

Training sample (bounded, documented): ``docs_per_lang`` documents of each language,
the smallest by a hash of doc_id, and of each at most ``span_chars`` characters from
a hashed position. Every language value is learned (``max_langs``, off by default,
leaves out the rarest). Scoring reads every word of every text.

Defined cases: a null text, an empty text and a text without a letter give ``und``
with score 0; with no labelled row at all every text is ``und``; repeated rows score
alike; ties go to the language that sorts first; a null doc_id is scored and, having
no remainder, is neither learned from nor held out (``held_out`` false); a very long text
(over ``PIECE_CHARS`` characters) is read whole, in segments that pass on their messages, so
memory follows the segment and not the text; further columns, whatever their names, are ignored
(``identified`` returns them as they came).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, identity, on_identity, returns_memory, ship_package, small_table, spill, split

UND = "und"
CAP = 40  # letters of a word; a longer run is cut into consecutive words
LETTERS = regex.compile(r"\p{L}{1,%d}" % CAP)
BITS = 15
MASK = (1 << BITS) - 1
SEQ = 48
SLICE_DOCS = 1024  # texts that are Python strings at a time
PIECE_CHARS = 1 << 19  # texts labelled together; a longer one is labelled in segments
SEGMENT_WORDS = 20_000
CACHE_WORDS = 50_000
WIDE = 16  # languages up to which batches and caches have their full size; beyond, they shrink in proportion


FIXED = 8  # features of a word besides its trigrams


def features(words: list[str]) -> np.ndarray:
    """Hashed features of lower-case words, one padded row each (pad = ``1 << BITS``)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    wide = int(size.max())
    p = np.zeros((len(words), wide + 2), np.uint32)  # ^ w $
    p[:, 0] = 94
    p[:, 1:-1] = np.array(words, f"<U{wide}").view(np.uint32).reshape(len(words), wide)
    p[np.arange(len(words)), size + 1] = 36

    def slot(seed: int, columns: list[np.ndarray]) -> np.ndarray:
        h = np.full(columns[0].shape, 2166136261 ^ seed, np.uint32)
        for c in columns:
            h = np.where(c, (h ^ c) * np.uint32(16777619), h)  # padding leaves no trace: a word hashes alike in any block
        return ((h ^ (h >> np.uint32(15))) & np.uint32(MASK)).astype(np.int32)

    out = np.full((len(words), FIXED + wide), 1 << BITS, np.int32)
    rows = np.arange(len(words))
    out[:, 0] = slot(1, [p[:, i] for i in range(1, wide + 2)])  # the word with its end mark
    out[:, 1] = slot(2, [p[:, 1] >> np.uint32(7)])  # script block of the first letter
    for n in (1, 2, 3):
        fits = size >= n
        out[fits, 1 + n] = slot(10 + n, [p[fits, i] for i in range(1, n + 1)])
        out[fits, 4 + n] = slot(20 + n, [p[rows[fits], size[fits] - n + i] for i in range(1, n + 1)])
    tri = slot(3, [p[:, :-2], p[:, 1:-1], p[:, 2:]])
    out[:, FIXED:] = np.where(np.arange(wide)[None, :] < size[:, None], tri, 1 << BITS)
    return out


@dataclass
class Model:
    """``langs`` in sorted order; weights per hashed feature (a last zero row pads), transitions, start."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def sized(self, n: int) -> int:
        """``n`` rows, fewer when there are many languages: what a batch holds stays the same."""
        return max(1, n * WIDE // max(WIDE, len(self.langs)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of lower-case words, computed in blocks of like length."""
        out = np.empty((len(words), len(self.langs)))
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        step = self.sized(4096)
        for lo in range(0, len(words), step):
            at = order[lo:lo + step]
            out[at] = self.weights[features([words[i] for i in at])].sum(axis=1)
        return out


def posteriors(emit: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Forward-backward over many sequences at once.

    ``emit``: one row of scores per word; sequence k holds the rows first[k]..first[k+1].
    Sequences advance together, longest first, laid out step by step, so a step is one
    small matrix product over those still running. Messages are rescaled every eighth
    step, long before they could leave the range of a double.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    lengths = n[order]
    top = int(lengths[0]) if len(lengths) else 0
    if not top:
        return np.zeros_like(emit)
    running = np.searchsorted(-lengths, -np.arange(top), side="left")  # sequences longer than the step
    off = np.concatenate([[0], np.cumsum(running)])
    step_of = np.repeat(np.arange(top), running)
    rows = first[:-1][order][np.arange(off[-1]) - off[step_of]] + step_of
    e = emit[rows]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    t = np.exp(model.transitions - model.transitions.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:off[1]] = e[:off[1]] * np.exp(model.start - model.start.max())
    for step in range(1, top):
        lo, hi = off[step], off[step + 1]
        cur = alpha[off[step - 1]:off[step - 1] + hi - lo] @ t
        cur *= e[lo:hi]
        if step % 8 == 0:
            cur /= cur.sum(axis=1, keepdims=True)
        alpha[lo:hi] = cur
    for step in range(top - 2, -1, -1):
        lo, hi = off[step + 1], off[step + 2]
        b = (e[lo:hi] * beta[lo:hi]) @ t.T
        if step % 8 == 0:
            b /= b.sum(axis=1, keepdims=True)
        beta[off[step]:off[step] + hi - lo] = b
    alpha *= beta
    alpha /= np.maximum(alpha.sum(axis=1, keepdims=True), 1e-300)
    out = np.empty_like(alpha)
    out[rows] = alpha
    return out


def fit(samples: list[tuple[str, str]], epochs: int = 3, rate: float = 0.3, seed: int = 7) -> Model | None:
    """Train on (language, text) rows by Adagrad over batches of code-switched sequences."""
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    place = {lang: c for c, lang in enumerate(langs)}
    pieces = []  # spans of one language, of 3 to SEQ words
    for lang, text in samples:
        words = np.fromiter((ids.setdefault(w, len(ids)) for w in LETTERS.findall(text.lower())), np.int64)
        at = 0
        while at < len(words):
            size = int(rng.integers(3, SEQ))
            pieces.append((place[lang], words[at:at + size]))
            at += size
    k = len(langs)
    model = Model(langs, np.zeros(((1 << BITS) + 1, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if not pieces:
        return model
    feats = features(list(ids))
    acc = [np.full(x.shape, 1e-3) for x in (model.weights, model.transitions, model.start)]
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        words = np.concatenate([pieces[i][1] for i in order])
        tags = np.concatenate([np.full(len(pieces[i][1]), pieces[i][0]) for i in order])
        step = SEQ * 256
        for lo in range(0, len(words), step):
            w, y = words[lo:lo + step], tags[lo:lo + step]
            first = np.unique(np.append(np.arange(0, len(w), SEQ), len(w)))
            used, back = np.unique(w, return_inverse=True)
            part = model.sized(4096)
            emit = np.concatenate([model.weights[feats[used[i:i + part]]].sum(axis=1) for i in range(0, len(used), part)]).astype(float)[back]
            post = posteriors(emit, first, model)
            diff = post.copy()
            diff[np.arange(len(y)), y] -= 1
            per_word = np.stack([np.bincount(back, diff[:, c], len(used)) for c in range(k)], axis=1)
            flat = feats[used].ravel()
            owner = np.repeat(np.arange(len(used)), feats.shape[1])
            grad = np.stack([np.bincount(flat, per_word[owner, c], (1 << BITS) + 1) for c in range(k)], axis=1)
            grad[-1] = 0
            inner = np.ones(len(w), bool)
            inner[first[:-1]] = False
            at = np.flatnonzero(inner)
            # sum over words of post[i - 1] x transitions x e[i], each scaled to 1, without the array words x langs x langs
            moves, e = np.exp(model.transitions), np.exp(emit[at] - emit[at].max(axis=1, keepdims=True))
            scale = ((post[at - 1] @ moves) * e).sum(axis=1, keepdims=True)
            pair = moves * ((post[at - 1] / scale).T @ e)
            np.add.at(pair, (y[at - 1], y[at]), -1.0)
            for p, g, a in zip((model.weights, model.transitions, model.start),
                               (grad / len(w), pair / len(w), diff[first[:-1]].sum(axis=0) / len(w)), acc, strict=True):
                a += g * g
                p -= rate * g / np.sqrt(a)
    return model


def training_rows(docs: DataFrame, docs_per_lang: int, span_chars: int, max_langs: int | None = None) -> list[tuple[str, str]]:
    """The bounded training sample (see the module notes), in one pass for all languages."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                        & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    counts = [(r["lang"], r["count"]) for r in (sizes.limit(max_langs) if max_langs else sizes).collect()]
    if not counts:
        return []
    h = F.xxhash64(F.col("doc_id"))
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.greatest(F.length("text") - span_chars, F.lit(1))) + 1
    # per language the hash range that holds about four times as many rows as are wanted, so tasks send few
    caps = [(lang, min(int(min(1.0, 4 * docs_per_lang / n + 1e-9) * 2**64) - 2**63, 2**63 - 1)) for lang, n in counts]
    langs, caps = zip(*caps, strict=True)
    cap = small_table(docs.sparkSession, lang=pa.array(langs, pa.string()), cap=pa.array(caps, pa.int64()))
    spans = known.join(F.broadcast(cap), "lang").filter(h <= F.col("cap")).select(
        "lang", h.alias("h"), F.col("text").substr(at.cast("int"), F.lit(span_chars)).alias("t"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    rows = spans.withColumn("k", first).filter(F.col("k") <= docs_per_lang).collect()
    return [(r["lang"], r["t"]) for r in sorted(rows, key=lambda r: (r["lang"], r["k"]))]


def learn(docs: DataFrame, docs_per_lang: int = 250, span_chars: int = 1500, max_langs: int | None = None) -> Model | None:
    """Model learned from rows with a language whose crc32(doc_id) mod 5 is not 0."""
    return fit(training_rows(docs, docs_per_lang, span_chars, max_langs))


def _cached(model: Model, words: list[str], cache: dict[str, np.ndarray]) -> np.ndarray:
    """Emission scores of the words; ``cache`` is only a cache, emptied when full."""
    ids, uniq = pd.factorize(np.array(words, object))
    if len(cache) > model.sized(CACHE_WORDS):
        cache.clear()
    missing = [w for w in uniq if w not in cache]
    if missing:
        cache.update(zip(missing, model.emissions(missing), strict=True))
    return np.array([cache[w] for w in uniq])[ids]


def _labelled(model: Model | None, texts: list[str | None], cache: dict[str, np.ndarray]):
    """Per text: its word matches' posteriors (None without a model or a letter)."""
    words, first = [], [0]
    for t in texts:
        if t and model is not None:
            words += LETTERS.findall(t.lower())
        first.append(len(words))
    if not words:
        return np.zeros((0, 1)), np.asarray(first)
    return posteriors(_cached(model, words, cache), np.asarray(first), model), np.asarray(first)


def _segments(model: Model, text: str, cache: dict[str, np.ndarray], size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """A long text in segments of ``size`` words, last one first: (from, to, posteriors).

    ``text`` is lower-case. The forward message entering each segment is kept from a first
    pass, the backward message is carried along, so the posteriors are those of the whole
    sequence while only one segment's arrays exist at a time.
    """
    starts = [m.start() for k, m in enumerate(LETTERS.finditer(text)) if k % size == 0]
    ends = [*starts[1:], len(text)]
    t = np.exp(model.transitions - model.transitions.max())
    enter = [np.exp(model.start - model.start.max())]
    for lo, hi in zip(starts[:-1], ends[:-1], strict=True):
        e = _scaled(_cached(model, LETTERS.findall(text, lo, hi), cache))
        a = enter[-1]
        for row in e:
            a = (a * row) @ t
            a /= a.sum()
        enter.append(a)
    leave = np.ones(len(model.langs))
    for lo, hi, begin in reversed(list(zip(starts, ends, enter, strict=True))):
        e = _scaled(_cached(model, LETTERS.findall(text, lo, hi), cache))
        alpha, beta = np.empty_like(e), np.empty_like(e)
        a = begin
        for i, row in enumerate(e):
            alpha[i] = a * row
            a = alpha[i] @ t
            a /= a.sum()
        for i in range(len(e) - 1, -1, -1):
            beta[i] = leave
            leave = t @ (e[i] * leave)
            leave /= leave.sum()
        alpha *= beta
        yield lo, hi, alpha / np.maximum(alpha.sum(axis=1, keepdims=True), 1e-300)


def _scaled(emit: np.ndarray) -> np.ndarray:
    return np.exp(emit - emit.max(axis=1, keepdims=True))


def _shares(model: Model | None, texts: list[str | None], cache: dict[str, np.ndarray], piece: int = PIECE_CHARS) -> list[tuple[int, np.ndarray]]:
    """(words, summed posteriors) of each text. Texts are worked through by length, in pieces of at most
    ``piece`` characters, as sequences of a piece advance together; a longer text goes by itself, in segments."""
    order = sorted(range(len(texts)), key=lambda k: len(texts[k] or ""))
    out: list = [(0, 0.0)] * len(texts)
    lo = 0
    while lo < len(texts):
        hi, room = lo, piece
        while hi < len(texts) and (room := room - len(texts[order[hi]] or "")) >= 0:
            hi += 1
        if hi > lo:
            post, first = _labelled(model, [texts[k] for k in order[lo:hi]], cache)
            for k, a, b in zip(order[lo:hi], first, first[1:], strict=False):
                out[k] = int(b - a), post[a:b].sum(axis=0)
        else:
            hi, n, total = lo + 1, 0, 0.0
            if model is not None:
                for _, _, post in _segments(model, texts[order[lo]].lower(), cache, model.sized(SEGMENT_WORDS)):
                    n, total = n + len(post), total + post.sum(axis=0)
            out[order[lo]] = n, total
        lo = hi
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, thash, lang_pred, score, n_words`` for every row of ``docs``.

    ``docs`` needs doc_id, thash and text (see ``common.identity``).
    """
    ship_package(docs.sparkSession)

    @returns_memory
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_DOCS):
                part = batch.slice(lo, SLICE_DOCS)
                langs, scores, sizes = [], [], []
                for n, total in _shares(model, part.column(2).to_pylist(), cache):
                    best = int(total.argmax()) if n else 0
                    langs.append(model.langs[best] if n else UND)
                    scores.append(min(1.0, float(total[best]) / n) if n else 0.0)
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())],
                    names=["doc_id", "thash", "lang_pred", "score", "n_words"])

    return docs.select("doc_id", "thash", "text").mapInArrow(
        score, "doc_id long, thash long, lang_pred string, score double, n_words long")


def label_words(docs: DataFrame, model: Model | None) -> DataFrame:
    """Runs of equally labelled words: doc_id, thash, start and end character, words, lang."""
    ship_package(docs.sparkSession)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lower, last, mine = (text or "").lower(), None, []
                # labels follow the lower-cased text, whose length can differ from the original's
                for lo, hi, post in (_segments(model, lower, cache, model.sized(SEGMENT_WORDS)) if model and lower else ()):
                    for m, lab in zip(reversed(list(LETTERS.finditer(lower, lo, hi))), post.argmax(axis=1)[::-1], strict=True):
                        if last and last[5] == model.langs[lab]:
                            last[2], last[4] = m.start(), last[4] + 1
                        else:
                            last = [doc, th, m.start(), m.end(), 1, model.langs[lab]]
                            mine.append(last)
                out += reversed(mine)
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.string()], strict=True)],
                                             names=["doc_id", "thash", "start", "end", "words", "lang"])

    return docs.select("doc_id", "thash", "text").mapInArrow(
        spans, "doc_id long, thash long, start long, end long, words long, lang string")


def identified(docs: DataFrame, model: Model | None, min_score: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is identified with at least ``min_score``;
    texts that are ``und`` go."""
    kept_ids = predict(identity(docs), model)
    gone = spill(kept_ids.filter((F.col("lang_pred") == UND) | (F.col("score") < min_score)).select(
        F.xxhash64("doc_id", "thash").alias("gone_key"), F.col("doc_id").alias("gone_doc"), F.col("thash").alias("gone_hash")).distinct(), "unidentified")
    # only rows that may be among the rejected ones are joined; texts never come back out of Python
    maybe, sure = split(docs, KeyFilter(gone.select("gone_key")))
    return sure.unionByName(maybe.join(gone, on_identity(maybe, gone, "gone_doc", "gone_hash"), "left_anti"))
