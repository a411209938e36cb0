"""Operator 2: toxicity by a weighted finite-state pattern grammar.

Tokens are classed as insult, threat, target (second person), negation, report (speech
verbs, quotation marks), clause end or other. Small transducers over these classes are
composed into one automaton that reads each clause once:

* insult: an insult emits its learned weight; another in the same clause adds less;
* threat: a threat verb emits only with a target within reach, before or after it;
* target: an insult near a target emits more, whichever comes first;
* negation: what follows closely a negation emits less;
* reported speech: after a report the rest of the clause emits less.

The score is the logistic of the clauses' emissions (sum, strongest clause, share of
clauses that emit, density), fitted on the training sample. A word alone has no score; it
counts by the clause it stands in.

Learning. Labels are read of at most ``sample_rows`` documents (smallest by a hash of
doc_id; the documented bound). Their words and word beginnings are counted per label in
Spark; beginnings whose log odds are surely high (two standard errors) form the insult
lexicon, the surest ``lexicon_size`` of them. The logistic weights are fitted on the same
documents, all of them. Function-word lists below are fixed.

Defined cases: null, empty and wordless texts have no clause and get the score of a text
without emissions; null labels and labels of unknown documents are ignored; a document
labelled more than once counts as toxic if any label says so; without a training row of
each class all texts score 0; repeated rows score alike; a null doc_id is scored and
never learned from; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identity, ship_package

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"“”„«»]")
LONG = pa.int64()
SHORTEST, LONGEST = 3, 9  # word beginnings in the lexicon

# Closed word classes of the grammar (en, de, fr, es).
TARGET = {"you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "ton",
          "ta", "vous", "votre", "ti", "tú", "usted", "ustedes", "vosotros"}
NEGATION = {"not", "no", "never", "nobody", "isn", "aren", "wasn", "don", "doesn", "cannot", "nicht", "kein", "keine", "nie",
            "niemals", "pas", "jamais", "aucun", "nunca", "jamás", "tampoco"}
REPORT = {"said", "says", "say", "called", "calls", "wrote", "claims", "claimed", "quoted", "sagte", "sagt", "nannte", "schrieb",
          "dit", "disait", "appelé", "écrit", "dijo", "dice", "llamó", "escribió", '"', "“", "”", "„", "«", "»"}
THREAT = {"kill", "hurt", "destroy", "beat", "shoot", "stab", "burn", "töten", "umbringen", "schlagen", "tuer", "frapper",
          "matar", "golpear"}
ENDS = {".", "!", "?", ";", "\n"}

OTHER, INSULT, THREATS, TARGETS, NEGATIONS, REPORTS = range(6)
SURE = 1.2  # least log odds of a lexicon entry, less two standard errors
REACH = 4  # words over which target and negation work


@dataclass(frozen=True)
class Transducer:
    """States 0..; ``step(state, cls) -> (state, factor)``: factors of composed machines multiply."""

    step: Callable[[int, int], tuple[int, float]]


def _insult(state: int, cls: int) -> tuple[int, float]:
    # state: insults so far (0, 1, 2 or more)
    return (min(2, state + 1), (1.0, 0.8, 0.6)[state]) if cls == INSULT else (state, 1.0)


def _target(state: int, cls: int) -> tuple[int, float]:
    # state: words left in which a target is near
    if cls == TARGETS:
        return REACH, 1.0
    return max(0, state - 1), 1.5 if cls in (INSULT, THREATS) and state else 1.0


def _threat(state: int, cls: int) -> tuple[int, float]:
    # a threat verb without a target in reach emits nothing
    if cls == TARGETS:
        return REACH, 1.0
    return max(0, state - 1), 0.0 if cls == THREATS and not state else 1.0


def _negation(state: int, cls: int) -> tuple[int, float]:
    if cls == NEGATIONS:
        return REACH, 1.0
    return max(0, state - 1), 0.4 if state and cls in (INSULT, THREATS) else 1.0


def _report(state: int, cls: int) -> tuple[int, float]:
    return (1, 1.0) if cls == REPORTS else (state, 0.6 if state and cls in (INSULT, THREATS) else 1.0)


GRAMMAR = tuple(Transducer(f) for f in (_insult, _target, _threat, _negation, _report))
REACHING = (_target, _threat)  # work in both directions; the others run forwards only


@dataclass
class Automaton:
    """The composition of transducers; product states are numbered as they are met."""

    parts: tuple[Transducer, ...] = GRAMMAR
    states: dict[tuple[int, ...], int] = field(default_factory=dict)
    names: list[tuple[int, ...]] = field(default_factory=list)
    arcs: dict[tuple[int, int], tuple[int, float]] = field(default_factory=dict)
    shares: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)  # of an arc's factor: forward-only, reaching

    def __post_init__(self) -> None:
        self._number((0,) * len(self.parts))

    def _number(self, state: tuple[int, ...]) -> int:
        if state not in self.states:
            self.states[state] = len(self.names)
            self.names.append(state)
        return self.states[state]

    def step(self, state: int, cls: int) -> tuple[int, float]:
        arc = self.arcs.get((state, cls))
        if arc is None:
            moved = [t.step(s, cls) for t, s in zip(self.parts, self.names[state], strict=True)]
            factor, shares = 1.0, [1.0, 1.0]
            for t, (_, f) in zip(self.parts, moved, strict=True):
                factor *= f
                shares[t.step in REACHING] *= f
            self.shares[state, cls] = (shares[0], shares[1])
            arc = self.arcs[state, cls] = (self._number(tuple(s for s, _ in moved)), factor)
        return arc

    def clause(self, classes: list[tuple[int, float]]) -> float:
        """Emission of one clause of (class, weight): read forwards and backwards, the stronger
        reading of each word counts, so a target may follow its insult or threat."""
        total, scopes = [0.0] * len(classes), [1.0] * len(classes)
        for way in (range(len(classes)), range(len(classes) - 1, -1, -1)):
            state = 0
            for i in way:
                cls, weight = classes[i]
                at, (state, _) = (state, cls), self.step(state, cls)
                if weight:
                    scope, reach = self.shares[at]
                    if way.step > 0:
                        scopes[i] = scope
                    total[i] = max(total[i], scopes[i] * reach * weight)
        return sum(total)


@dataclass
class Model:
    """``lexicon``: word beginnings (``word$`` for whole words) and weights; logistic weights over ``signals``."""

    lexicon: dict[str, float]
    weights: np.ndarray
    threat: float = 2.0

    def class_of(self, word: str) -> tuple[int, float]:
        w = word.lower()
        if w in TARGET:
            return TARGETS, 0.0
        if w in NEGATION:
            return NEGATIONS, 0.0
        if w in REPORT:
            return REPORTS, 0.0
        best = self.lexicon.get(w + "$", 0.0)
        for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
            best = max(best, self.lexicon.get(w[:n], 0.0))
        if best:
            return INSULT, best
        return (THREATS, self.threat) if w in THREAT else (OTHER, 0.0)


def signals(text: str | None, model: Model, automaton: Automaton, cache: dict[str, tuple[int, float]]) -> tuple[float, ...]:
    """(sum, strongest clause, emitting share of clauses, emission per 100 words) of one text."""
    total = best = 0.0
    clauses = emitting = words = 0
    clause: list[tuple[int, float]] = []
    hot = False
    tokens = TOKEN.findall(text) if text else []
    for tok in itertools.chain(tokens, (".",)):
        if tok in ENDS:
            if clause:
                clauses += 1
                if hot:
                    e = automaton.clause(clause)
                    if e > 0:
                        emitting += 1
                        total += e
                        best = max(best, e)
            clause, hot = [], False
            continue
        c = cache.get(tok)
        if c is None:
            c = cache[tok] = model.class_of(tok)
        clause.append(c)
        words += 1
        if c[1]:
            hot = True
    return np.log1p(total), np.log1p(best), emitting / max(1, clauses), np.log1p(100 * total / max(1, words))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights (last: intercept) by Newton steps; row k counts ``n[k]`` times."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (n * (p - y)) / n.sum() + l2 * w
        h = (a * (n * p * (1 - p))[:, None]).T @ a / n.sum() + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def lexicon_from(counts: list[tuple[str, int, int]], toxic: int, clean: int, size: int) -> dict[str, float]:
    """Weights of entries whose log odds are surely high; (entry, toxic texts, clean texts)."""
    out = []
    for entry, t, c in counts:
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        sure = odds - 2 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if sure > SURE:
            out.append((-sure, entry))
    return {entry: -s for s, entry in sorted(out)[:size]}


def entries(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample_rows: int = 20_000,
          lexicon_size: int = 3_000) -> Model | None:
    """Model learned from the documents (doc_id, thash, text) that ``labels`` (doc_id, target) marks."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).filter(
        "doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, 2 * sample_rows / max(1, known.count()))  # a hash range of about twice the bound, then the bound
    h = F.xxhash64("doc_id")
    known = known.filter(h <= int((share - 0.5) * 2**64) if share < 1 else F.lit(True))
    rows = known.select(h.alias("h"), "doc_id", "y").orderBy("h", "doc_id").limit(sample_rows).collect()
    marks = {r["doc_id"]: r["y"] for r in rows}
    if len(set(marks.values())) < 2:
        return None
    chosen = docs.join(F.broadcast(docs.sparkSession.createDataFrame(
        [(k, v) for k, v in marks.items()], "doc_id long, y int")), "doc_id").select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {e for w in {w.lower() for w in TOKEN.findall(text or "")} if w[0].isalpha() for e in entries(w)}
                for e in found:
                    seen.setdefault(e, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([b[1] for b in seen.values()], LONG),
                                              pa.array([b[0] for b in seen.values()], LONG)], names=["entry", "t", "c"])

    size = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    if len(size) < 2:
        return None
    sums = (chosen.mapInArrow(count, "entry string, t long, c long").groupBy("entry")
            .agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    # the bound of lexicon_from, with room for rounding
    sure = F.expr(f"ln((t + 0.5) / ({size[1]} + 1)) - ln((c + 0.5) / ({size[0]} + 1)) - 2 * sqrt(1 / (t + 0.5) + 1 / (c + 0.5))")
    sums = sums.withColumn("sure", sure).filter(F.col("sure") > SURE - 1e-6).orderBy(F.desc("sure"), "entry").limit(lexicon_size)
    got = [(r["entry"], r["t"], r["c"]) for r in sums.collect()]
    model = Model(lexicon_from(got, size[1], size[0], lexicon_size), np.zeros(5))
    pairs = chosen.mapInArrow(_signal_rows(model, 1, ["y"]), "y int, x array<double>").groupBy("y", "x").count().orderBy("y", "x").collect()
    x, y, n = (np.array([r[k] for r in pairs], float) for k in ("x", "y", "count"))
    model.weights = _logistic(x, y, n)
    return model


def _signal_rows(model: Model, at: int, names: list[str]):
    """Rows with the text at column ``at`` -> the leading columns and the signals of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = Automaton(), {}
        for batch in batches:
            out = []
            for text in batch.column(at):
                out.append(signals(text.as_py(), model, automaton, cache))
                if len(cache) > 300_000:
                    cache.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.list_(pa.float64()))], names=[*names, "x"])
    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, thash, score and signals ``x`` of every row (doc_id, thash, text)."""
    ship_package(docs.sparkSession)
    if model is None:
        return docs.select("doc_id", "thash", F.lit(0.0).alias("score"), F.array().cast("array<double>").alias("x"))
    rows = docs.select("doc_id", "thash", "text").mapInArrow(_signal_rows(model, 2, ["doc_id", "thash"]),
                                                            "doc_id long, thash long, x array<double>")
    line = F.lit(float(model.weights[-1]))
    for k, w in enumerate(model.weights[:-1]):
        line = line + F.col("x")[k] * float(w)
    return rows.select("doc_id", "thash", (1 / (1 + F.exp(-line))).alias("score"), "x")
