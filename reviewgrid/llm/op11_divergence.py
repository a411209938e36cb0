"""Operator 11: audit of how the sources of a language diverge in their words.

Counting is a pipeline of Arrow compute kernels inside ``mapInArrow``: ``ascii_lower``,
``split_pattern_regex``, ``dictionary_encode`` and hash ``group_by`` give partial counts
per (lang, source, term), occurrences and documents, which Spark sums. Terms in fewer than
``min_docs`` documents of their language go. The rest is dealt to columnar shards of a
language (by hash of the term), where a matrix terms x sources gives each source's smoothed
shares, the partial divergence of each pair of sources, and each source's leading terms;
partial divergences are summed over the shards.

All arithmetic is exact integers: ``p = 1 + floor(10**9 (count + 2) / (N + 2 V))`` by long
division in base 1000 (right up to 9 * 10**15 occurrences), ``f = floor((p - q)**2 / (p + q))``.

Scale. Texts never leave the first stage. A shard holds some ``SHARD_ROWS`` counts and
``SHARD_CELLS`` matrix cells whatever the corpus, a hot language has more shards, a hot term
is one row per source after map-side sums. Every pair of sources of a language is in the result by definition.

Defined cases: null text, lang or source read as ''; texts without a term count as
documents of their group and nothing else; a language without a kept term has pairs of
value 0 and no terms; a source alone in its language has no pair; repeated rows are documents of
their own; ties rank by the item's UTF-8 bytes; a very long text is read whole, in pieces of
``SLICE_BYTES`` cut between terms; further columns, whatever their names, are ignored; an
empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, spill

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
#: FIXED VALUE: what separates terms.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SLICE_BYTES = 1 << 23
SHARD_ROWS = 100_000
SHARD_CELLS = 4_000_000
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row and term of every term of the texts."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    flat, row = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.greater(pc.binary_length(flat), 0)
    return np.asarray(row.filter(some)), flat.filter(some).dictionary_encode()


def _per_document(row: np.ndarray, terms: pa.DictionaryArray) -> pa.Table:
    """(row, code, n): occurrences of each term in each document."""
    return pa.table({"row": row, "code": terms.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])


def count_slice(lang: pa.Array, source: pa.Array, texts: pa.Array) -> pa.Table:
    """Counts of a slice of documents, and a row without term for each of its groups."""
    row, terms = terms_of(texts)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = np.asarray(langs.indices).astype(np.int64) * len(sources.dictionary) + np.asarray(sources.indices)
    per = _per_document(row, terms)
    sums = pa.table({"g": group[np.asarray(per["row"])], "code": per["code"], "n": per["count_all"]}).group_by(
        ["g", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    g = np.concatenate([np.asarray(sums["g"]), np.unique(group)])
    extra = len(g) - len(sums)
    words = pa.concat_arrays([terms.dictionary.take(sums["code"].combine_chunks()), pa.nulls(extra, pa.string())])
    return pa.table([langs.dictionary.take(pa.array(g // max(1, len(sources.dictionary)))), sources.dictionary.take(pa.array(g % max(1, len(sources.dictionary)))),
                     words, np.concatenate([np.asarray(sums["n_sum"]), np.zeros(extra, np.int64)]),
                     np.concatenate([np.asarray(sums["n_count"]), np.zeros(extra, np.int64)])], schema=COUNTS)


def count_long(lang: str, source: str, text: bytes, size: int) -> pa.Table:
    """Counts of one document longer than a slice, piece by piece; a document counts once for a term."""
    total, lo = None, 0
    while lo < len(text):
        hi = lo + size
        while hi < len(text) and (text[hi] >= 0x80 or 65 <= text[hi] & 0xDF <= 90):
            hi += 1  # to the next separator
        row, terms = terms_of(pa.array([text[lo:hi].decode()]))
        per = _per_document(row, terms)
        part = pa.table({"term": terms.dictionary.take(per["code"].combine_chunks()), "n": per["count_all"].combine_chunks()})
        total = part if total is None else pa.concat_tables([total, part]).group_by("term", use_threads=False).aggregate([("n", "sum")]).rename_columns(["term", "n"])
        lo = hi
    n = len(total)
    return pa.table([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), total["term"], total["n"], pa.array([1] * n, pa.int64())], schema=COUNTS)


def partial_counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, n, d per slice; groups also have a row without a term."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, text = (pc.fill_null(c.cast(pa.string()), "") for c in batch.columns)
            size = np.cumsum(np.asarray(pc.binary_length(text)).astype(np.int64))
            lo = 0
            while lo < len(text):
                before = size[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(size, before + slice_bytes, side="right")))
                if size[lo] - before > slice_bytes:
                    hi = lo + 1
                    got = count_slice(lang.slice(lo, 1), source.slice(lo, 1), pa.array([""]))
                    yield from got.to_batches()
                    got = count_long(lang[lo].as_py(), source[lo].as_py(), text[lo].as_buffer().to_pybytes(), slice_bytes)
                else:
                    got = count_slice(lang.slice(lo, hi - lo), source.slice(lo, hi - lo), text.slice(lo, hi - lo))
                yield from got.combine_chunks().to_batches()
                lo = hi

    cols = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]
    return docs.select(*cols).mapInArrow(run, "lang string, source string, term string, n long, d long")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total) by long division, three digits a step."""
    q = count // total
    rest = count - q * total
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        rest -= digit * total
        q = q * 1000 + digit
    return q + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shard_result(counts: pa.Table, info: pa.Table, top: int) -> pa.Table:
    """Partial divergences (item b after source a only) and leading terms of one shard of a language."""
    lang = info["lang"][0].as_py()
    order = pc.sort_indices(info["source"])
    sources, total = info["source"].take(order).combine_chunks(), np.asarray(info["n_source"].take(order))
    v, n_lang = info["v"][0].as_py(), info["n_lang"][0].as_py()
    terms = counts["term"].combine_chunks().dictionary_encode()
    matrix = np.zeros((len(sources), len(terms.dictionary)), np.int64)
    matrix[np.asarray(pc.index_in(counts["source"], value_set=sources)), np.asarray(terms.indices)] = np.asarray(counts["n"])
    p = shares(matrix + 2, (total + 2 * v)[:, None])
    q = shares(matrix.sum(axis=0) + 2, np.full(matrix.shape[1], n_lang + 2 * v))
    rank = np.empty(len(terms.dictionary), np.int64)
    rank[np.asarray(pc.sort_indices(terms.dictionary))] = np.arange(len(rank))
    part, a, b, value = [], [], [], []
    for k in range(len(sources)):
        if k + 1 < len(sources):
            part.append(divergence(p[k], p[k + 1:]).sum(axis=1))
            a.append(np.full(len(sources) - k - 1, k))
            b.append(np.arange(k + 1, len(sources)))
        at = np.flatnonzero((matrix[k] > 0) & (p[k] > q))
        f = divergence(p[k, at], q[at])
        best = np.lexsort((rank[at], -f))[:top]
        value.append((np.full(len(best), k), at[best], f[best]))
    empty = np.zeros(0, np.int64)
    pairs = (np.concatenate([*a, empty]), np.concatenate([*b, empty]), np.concatenate([*part, empty]))
    lead = [np.concatenate([*(x[i] for x in value), empty]) for i in range(3)]
    n, m = len(pairs[0]), len(lead[0])
    return pa.table({
        "lang": pa.array([lang] * (n + m), pa.string()), "part": pa.array(["pair"] * n + ["term"] * m, pa.string()),
        "source": sources.take(pa.array(np.concatenate([pairs[0], lead[0]]))),
        "item": pa.concat_arrays([sources.take(pa.array(pairs[1])), terms.dictionary.take(pa.array(lead[1]))]),
        "value": pa.array(np.concatenate([pairs[2], lead[2]]), pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_rows: int = SHARD_ROWS,
          shard_cells: int = SHARD_CELLS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank (see the module notes)."""
    merged = spill(partial_counts(docs, slice_bytes).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "terms")
    groups = merged.filter("term is null").select("lang", "source")
    of_term = Window.partitionBy("lang", "term")
    kept = spill(merged.filter("term is not null").withColumn("df", F.sum("d").over(of_term)).withColumn("one", F.min("source").over(of_term))
                 .filter(F.col("df") >= min_docs).select("lang", "source", "term", "n", (F.col("one") == F.col("source")).cast("long").alias("one")), "kept-terms")

    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.sum("one").alias("v"), F.count(F.lit(1)).alias("rows"))
    in_lang = Window.partitionBy("lang")
    info = spill(groups.join(per_source, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("n_source", F.lit(0)).alias("n_source"),
        F.sum(F.coalesce("n_source", F.lit(0))).over(in_lang).alias("n_lang"), F.sum(F.coalesce("v", F.lit(0))).over(in_lang).alias("v"),
        F.sum(F.coalesce("rows", F.lit(0))).over(in_lang).alias("rows"), F.count(F.lit(1)).over(in_lang).alias("sources")), "sources")
    shards = info.withColumn("shards", (1 + F.floor(F.greatest(F.col("rows") / shard_rows, F.col("v") * F.col("sources") / shard_cells))).cast("int"))

    per_lang = shards.groupBy("lang").agg(F.max("shards").alias("shards"))
    left = kept.join(per_lang, "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    right = shards.filter("v > 0").select("lang", "source", "n_source", "n_lang", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def run(counts: pa.Table, about: pa.Table) -> pa.Table:
        return shard_result(counts, about, top)

    found = spill(left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(
        run, "lang string, part string, source string, item string, value long"), "shards")
    half = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    silent = shards.filter("v = 0").select("lang", "source")  # languages without a kept term
    pairs = (half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
             .union(silent.join(silent.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select(
                 "lang", "source", "item", F.lit(0).cast("long").alias("value"))))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    lead = found.filter("part = 'term'").withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return (pairs.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
            .union(lead.select("lang", "source", "part", "item", "value", "rank")))


ORACLE = f"""
WITH src AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
word AS (SELECT k, lang, source, unnest(w) AS term FROM src),
keep AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}),
cnt AS (SELECT lang, source, term, count(*) AS c FROM word JOIN keep USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM src),
vv AS (SELECT lang, count(*) AS v FROM keep GROUP BY lang),
tot AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL),
ltot AS (SELECT lang, sum(c) AS n FROM cnt GROUP BY ALL),
lc AS (SELECT lang, term, sum(c) AS c FROM cnt GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
  1 + ({UNIT}::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(t.n, 0) + 2 * v.v) AS p
  FROM grp g JOIN keep k USING (lang) JOIN vv v USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source),
q AS (SELECT lc.lang, lc.term, 1 + ({UNIT}::HUGEINT * (lc.c + 2)) // (ltot.n + 2 * v.v) AS q FROM lc JOIN ltot USING (lang) JOIN vv v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
res AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM res) WHERE part = 'pair' OR rank <= {TOP}
"""
