"""A ledger of model calls (A2): what has been answered is not asked again.

A call is known by the hash of reviewer, file path and prompt. Equal calls are made once;
the ones the ledger has no answer for are written down and dealt into slices of at most about
``slice_rows`` calls.

All slices are made by one job: every task makes one caller's part of a slice and moves its
answers into the ledger when it is through (the committer's second algorithm, so not only when the
job is). If the job dies, the answers of the finished tasks stay: the next run makes the calls
of the open tasks, together about a slice, and those after them. An executor that is lost costs its open
tasks. With ``concurrency`` fewer callers than cores may be wanted, which one job cannot hold; then the slices
are made one after the other, a job of so many tasks each, and the open slice is made again.

Each row of the ledger stands for itself, so rows of a slice that was only partly moved
into place are as good as any. Failed calls are kept for the run they happened in and are
made again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..session import work_path
from .reviewers import call_batches

CALL = ["agent", "file_path", "prompt"]
LEDGER = StructType([StructField(c, StringType()) for c in ("call", "response", "error", "run")])


def call_key():
    """Hash of a call; each part carries its length, a null part is marked, so no two calls look alike."""
    part = [F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))
            for c in CALL]
    return F.sha2(F.concat(*part), 256)


def init_ledger(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], LEDGER).drop("run").write.mode("ignore").parquet(f"{path}/run=none")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def ledger_calls(tasks: DataFrame, fn: Callable[[str, str, str], str], path: str, run: str,
                 slice_rows: int = 100_000, concurrency: int | None = None, attempts: int = 3,
                 backoff: float = 1.0) -> DataFrame:
    """``tasks`` (agent, file_path, prompt and any other columns but ``call``) with ``response`` and ``error``.

    ``run`` names this run in the ledger at ``path``; running it again under the same name
    goes on where it stopped. ``concurrency`` bounds the callers (partitions) of a slice.
    """
    spark = tasks.sparkSession
    init_ledger(spark, path)
    work = work_path(spark, "calls")
    keyed = tasks.withColumn("call", call_key())
    answered = read_ledger(spark, path).filter(F.col("error").isNull() & F.col("response").isNotNull()).select("call")
    open_calls = (keyed.groupBy("call").agg(*[F.first(c).alias(c) for c in CALL])
                  .join(answered, "call", "left_anti"))
    open_calls.write.parquet(f"{work}/open")
    open_calls = spark.read.schema(open_calls.schema).parquet(f"{work}/open")
    slices = -(-open_calls.count() // slice_rows)
    answers_to = f"{path}/run={run}"
    if slices and not concurrency:
        parts = open_calls.repartition(slices * spark.sparkContext.defaultParallelism, "call")
        made = call_batches(parts, fn, None, attempts, backoff)
        (made.select("call", "response", "error").write.mode("append")
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(answers_to))
    elif slices:
        dealt = f"{work}/slices"
        (open_calls.withColumn("slice", F.pmod(F.xxhash64("call"), F.lit(slices)).cast("int"))
         .repartition("slice", F.pmod(F.xxhash64("call", F.lit(1)), F.lit(concurrency)))
         .write.partitionBy("slice").parquet(dealt))
        stored = spark.read.schema(StructType([*open_calls.schema.fields, StructField("slice", IntegerType())])).parquet(dealt)
        for k in range(slices):
            part = stored.filter(F.col("slice") == k).drop("slice")
            made = call_batches(part, fn, concurrency, attempts, backoff)
            made.select("call", "response", "error").write.mode("append").parquet(answers_to)
    mine = F.col("run") == F.lit(run)
    ok = F.col("error").isNull() & F.col("response").isNotNull()
    answers = (read_ledger(spark, path).filter(ok | mine).groupBy("call")
               .agg(F.max_by(F.struct("response", "error"), F.struct(ok, mine)).alias("_r")))
    return keyed.join(answers, "call", "left").select(
        *tasks.columns, F.col("_r.response").alias("response"), F.col("_r.error").alias("error"))

