"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, kept, removes_shuffles, work_path
from ..session import ship_package as _ship
from ..sources.tables import table

__all__ = ["KeyFilter", "components", "discard", "documents", "identity", "null_safe", "on_identity", "removes_shuffles",
           "returns_memory", "row_key", "ship_package", "small_table", "spill", "split", "table", "unused"]


BATCH_ROWS = 2048
BATCH_BYTES = 1 << 22


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and bound the Arrow batches of texts that travel to
    them by rows and bytes (a session's own lower bounds stay): a batch lies in the executor, in its buffers and in the worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    _ship(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of the driver's own values. It goes to Spark as Arrow data; from a list of rows, Spark
    would start a second family of Python workers beside those of ``mapInArrow``, in every executor."""
    return spark.createDataFrame(pa.table(columns))


def returns_memory(run: Callable) -> Callable:
    """A ``mapInArrow`` function that gives freed memory back to the system when its task ends: workers are
    kept between tasks, and what their allocators keep would count beside the heap in all later stages."""
    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; elsewhere there is none
            if trim is not None:
                trim(0)
    return task


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs only the tasks
    that were reading it, and the plan above is never run twice.
    """
    path = work_path(df.sparkSession, f"llm-{name}")
    with removes_shuffles(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return kept(df.sparkSession.read.schema(df.schema).parquet(path), path)


def identity(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``thash``. (doc_id, thash) names a row's content: repeated rows
    share it and get the same result, different texts under one doc_id do not."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("thash"))


def null_safe(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


class KeyFilter:
    """A bitmap of fixed size (``1 << BITS`` bits, 4 MB) over hashed long keys.

    Tasks keep rows whose key may be wanted before anything is shuffled; an exact join
    follows, so a full bitmap costs time and nothing else. Partial bitmaps travel
    compressed and meet in slices; the driver gets the 4 MB.
    """

    BITS = 25
    SLICE = 1 << 16  # bytes

    def __init__(self, keys: DataFrame):
        bits, step = self.BITS, self.SLICE

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros(1 << bits, bool)
            for b in batches:
                got[KeyFilter.slot(np.asarray(b.column(0)))] = True
            yield from KeyFilter._parts(np.packbits(got), step)

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << (bits - 3), np.uint8)
            for b in batches:
                for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    total[k * step:(k + 1) * step] |= np.frombuffer(zlib.decompress(part), np.uint8)
            yield from KeyFilter._parts(total, step)

        with removes_shuffles(keys.sparkSession):
            rows = keys.mapInArrow(mark, "k int, part binary").repartition(8, "k").mapInArrow(unite, "k int, part binary").collect()
        self.bits = np.zeros(1 << (bits - 3), np.uint8)
        for r in rows:
            self.bits[r["k"] * step:(r["k"] + 1) * step] |= np.frombuffer(zlib.decompress(r["part"]), np.uint8)

    @staticmethod
    def _parts(packed: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
        used = [k for k in range(len(packed) // step) if packed[k * step:(k + 1) * step].any()]
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()),
                 pa.array([zlib.compress(packed[k * step:(k + 1) * step].tobytes(), 1) for k in used], pa.binary())],
                names=["k", "part"])

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - KeyFilter.BITS)).astype(np.int64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (in any letter case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: ``node``, ``root`` = smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round is a
    map-side combined minimum and a join, written to the shared folder; the number of
    rounds grows with the logarithm of the longest chain. A hot node is only ever
    joined, never gathered. Nodes without an edge are not listed.
    """
    def flat(df: DataFrame, name: str) -> DataFrame:
        return spill(df.filter(F.col("u") != F.col("v")).distinct(), name)

    e = flat(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour is tied to the smallest one around
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = flat(large, "large")
        # small star: the smaller neighbours and the node itself are tied to the smallest
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        last, e = e, flat(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(small.select("u", F.col("m").alias("v"))), "small")
        discard(last, large)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
    roots = spill(e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    discard(e)
    return roots


def split(docs: DataFrame, wanted: KeyFilter) -> tuple[DataFrame, DataFrame]:
    """(rows whose identity may be in ``wanted``, rows whose identity surely is not), all columns.

    Only the first part needs a shuffle afterwards; the second never leaves its tasks.
    """
    key = unused(docs, "split_key")
    keyed = docs.withColumn(key, row_key(docs))
    columns = docs.columns
    at = len(columns)

    def part(hold: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = wanted.may_hold(np.asarray(batch.column(at))) == hold
                if mask.any():
                    yield pa.RecordBatch.from_arrays(batch.filter(pa.array(mask)).columns[:at], names=columns)
        return run

    return keyed.mapInArrow(part(True), docs.schema), keyed.mapInArrow(part(False), docs.schema)


def row_key(docs: DataFrame) -> Column:
    """64-bit hash of a row's identity (see ``identity``); equal for repeated rows."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))


def on_identity(docs: DataFrame, other: DataFrame, doc: str, thash: str) -> Column:
    """Join condition between full rows of ``docs`` and identities in ``other``."""
    return docs["doc_id"].cast("long").eqNullSafe(other[doc]) & (
        F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == other[thash])
