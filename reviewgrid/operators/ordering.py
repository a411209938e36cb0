"""Dense positions within groups, by many tasks per group.

``row_number() over (partition by g order by o)`` sorts each group in a
single task, so a group holding a third of all rows would serialise the
job. ``position_within`` numbers all groups in one way, whatever their size:
the rows are range-partitioned on ``(g, o)``, numbered inside each range, and
offset by the row counts of the earlier ranges of the same group.

Range boundaries come from a sample and are drawn anew each time the plan
runs, so the partitioned rows are written once, with their range id, and
both the numbering and the counts read that one table. The counts table has
at most (ranges + groups) rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import work_path


def _null_safe_on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def position_within(df: DataFrame, group: list[str], order: list[Column | str],
                    name: str = "position", range_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its group by ``order``.

    ``order`` must be a total order inside a group (ties broken by the caller).
    The ranged rows are written to the session's shared folder: the upstream
    plan runs once, and a lost executor does not recompute it.
    """
    spark = df.sparkSession
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = range_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_path(spark, "ranged")
    (df.repartitionByRange(parts, *[F.col(g) for g in group], *order_cols)
     .withColumn("_range_id", F.spark_partition_id()).write.parquet(path))
    schema = StructType([*df.schema.fields, StructField("_range_id", IntegerType())])
    ranged = spark.read.schema(schema).parquet(path)

    keys = ["_range_id", *group]
    local = ranged.withColumn("_local_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols)))
    counts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_range_rows"))
    earlier = Window.partitionBy(*group).orderBy("_range_id").rowsBetween(Window.unboundedPreceding, -1)
    # only ranges that are not their group's first have an offset
    offsets = counts.withColumn("_offset", F.sum("_range_rows").over(earlier)).filter("_offset is not null").drop("_range_rows")
    joined = local.join(offsets, _null_safe_on(local, offsets, keys), "left")
    keep = [local[c] for c in df.columns]
    return joined.select(*keep, (F.coalesce(offsets["_offset"], F.lit(0)) + local["_local_pos"]).cast("int").alias(name))
