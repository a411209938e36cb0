"""Dashboard and report aggregates.

The stored findings table can be huge; every aggregate here is a
``groupBy`` whose partial aggregation runs map-side, and the few-row
results (at most severities x categories) are the only inputs of the
unpartitioned windows and domain joins that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DASHBOARD_CATEGORIES, REDUCTION_TARGET_PCT, SEVERITIES


ERROR_ROW = " agent error: "


def severity_category_counts(reviews: DataFrame, exclude_errors: bool = False) -> DataFrame:
    """G1: COUNT(*) GROUP BY severity, category ORDER BY severity.

    ``exclude_errors`` (off by default, parity) is the opt-in repair of
    SURVEY note 14: reviewer-error rows (line 0, low, "<Name> agent error: ...")
    are left out of the dashboard.
    """
    if exclude_errors:
        is_error = (F.coalesce(F.col("line_number"), F.lit(-1)) == 0) & \
            F.coalesce(F.col("description").contains(ERROR_ROW), F.lit(False))
        reviews = reviews.filter(~is_error)
    return (reviews.groupBy("severity", "category")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("severity").asc_nulls_first(), F.col("category").asc_nulls_first()))


def _severity_domain(spark) -> DataFrame:
    rows = [(s, i) for i, s in enumerate(SEVERITIES)]
    return spark.createDataFrame(rows, "severity string, rank int")


def by_severity(counts: DataFrame) -> DataFrame:
    """Totals over the four known severities, zero-filled, unknown dropped.

    ``counts`` is the G1 result (tiny), so the fixed four-row domain is
    joined against an already-aggregated table.
    """
    sev = counts.groupBy("severity").agg(F.sum("count").alias("n"))
    dom = _severity_domain(counts.sparkSession)
    return (F.broadcast(dom).join(sev, "severity", "left")
            .select("severity", "rank", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count"))
            .orderBy("rank"))


def by_category(counts: DataFrame) -> DataFrame:
    """Totals per category (null kept), share of the total; three zero rows if empty."""
    cat = counts.groupBy("category").agg(F.sum("count").cast("bigint").alias("count"))
    spark = counts.sparkSession
    fallback = spark.createDataFrame([(c, 0) for c in DASHBOARD_CATEGORIES],
                                     "category string, count bigint")
    # Fallback rows only when there is no category row at all (few-row window).
    both = (cat.withColumn("_fallback", F.lit(False))
            .unionByName(fallback.withColumn("_fallback", F.lit(True))))
    real_rows = F.sum(F.when(~F.col("_fallback"), 1).otherwise(0)).over(Window.partitionBy())
    both = (both.withColumn("_real_rows", real_rows)
            .filter(~F.col("_fallback") | (F.col("_real_rows") == 0)).drop("_fallback", "_real_rows"))
    total = F.sum("count").over(Window.partitionBy())
    return both.withColumn(
        "share", F.when(total > 0, F.col("count") / total).otherwise(F.lit(0.0)))


def kpis(counts: DataFrame) -> DataFrame:
    """Total (known severities), critical+high, security, performance."""
    known = F.col("severity").isin(*SEVERITIES)
    return counts.agg(
        F.coalesce(F.sum(F.when(known, F.col("count"))), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum(F.when(F.col("severity").isin("critical", "high"), F.col("count"))),
                   F.lit(0)).cast("bigint").alias("critical_high"),
        F.coalesce(F.sum(F.when(F.col("category") == "security", F.col("count"))),
                   F.lit(0)).cast("bigint").alias("security"),
        F.coalesce(F.sum(F.when(F.col("category") == "performance", F.col("count"))),
                   F.lit(0)).cast("bigint").alias("performance"))


def reduction_pct(chunk_tokens="chunk_tokens", original_tokens="original_tokens"):
    """round((1 - c / max(o, 1)) * 100, 1), half-even."""
    c, o = F.col(chunk_tokens), F.col(original_tokens)
    return F.bround((F.lit(1.0) - c / F.greatest(o, F.lit(1))) * 100, 1)


def chunk_log(metrics: DataFrame) -> DataFrame:
    """Total chunks, average reduction (1 dp), target and whether it is met.

    Always one row; with no chunks the count is 0 and the average null.
    """
    agg = metrics.agg(F.count(F.lit(1)).alias("total_chunks"),
                      F.bround(F.avg("reduction_pct"), 1).alias("average_token_reduction_pct"))
    return agg.select(
        "total_chunks", "average_token_reduction_pct",
        F.lit(REDUCTION_TARGET_PCT).cast("int").alias("target_pct"),
        (F.col("average_token_reduction_pct") >= F.lit(REDUCTION_TARGET_PCT)).alias("target_met"))
