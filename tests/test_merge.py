"""Dedup / prioritise against a plain loop; properties."""

import random
from itertools import groupby

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewgrid.operators import merge
from reviewgrid.operators.ordering import position_within

RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def by_definition(rows):
    """Per key the finding of least (rank, seq); keys in order of (rank, first seq of the key)."""
    rank = lambda r: RANK.get(r["severity"], 3)
    keyed = sorted(rows, key=lambda r: (str(r["file_path"]), str(r["line_number"]), str(r["category"])))
    groups = [list(g) for _, g in groupby(keyed, key=lambda r: (r["file_path"], r["line_number"], r["category"]))]
    best = [(min(g, key=lambda r: (rank(r), r["seq"])), min(r["seq"] for r in g)) for g in groups]
    return [r for r, first in sorted(best, key=lambda x: (rank(x[0]), x[1]))]


def make_rows(n, seed=7):
    rnd = random.Random(seed)
    sev = ["critical", "high", "medium", "low", "High", None]
    return [dict(repo="r", pr_number=1, seq=i, file_path=rnd.choice(["a.py", "b.py", "", None]),
                 line_number=rnd.choice([0, 1, 2, None]), category=rnd.choice(["security", "style", None]),
                 severity=rnd.choice(sev), description=f"d{i}", suggested_fix=None) for i in range(n)]


SCHEMA = ("repo string, pr_number int, seq bigint, file_path string, line_number int, category string, "
          "severity string, description string, suggested_fix string")


def spark_merge(spark, rows, partitions=3):
    df = spark.createDataFrame([tuple(r[c] for c in [s.split()[0] for s in SCHEMA.split(", ")]) for r in rows],
                               SCHEMA).repartition(partitions)
    return [r.asDict() for r in merge.prioritise(merge.dedup(df, order_col="seq")).orderBy("position").collect()]


def test_matches_plain_loop(spark):
    rows = make_rows(300)
    expect = [r["seq"] for r in by_definition(rows)]
    got = [r["seq"] for r in spark_merge(spark, rows)]
    assert got == expect


def test_independent_of_partitioning(spark):
    rows = make_rows(200, seed=3)
    a, b = spark_merge(spark, rows, partitions=1), spark_merge(spark, rows, partitions=7)
    assert [r["seq"] for r in a] == [r["seq"] for r in b]
    assert [r["position"] for r in a] == list(range(1, len(a) + 1))


def test_positions_of_a_large_group(spark):
    """200,000 rows of one group over many ranges, partly null and tied order keys, against row_number()."""
    df = spark.range(260_000).select(
        F.when(F.col("id") < 200_000, "hot").when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("g"),
        (F.xxhash64("id") % 5).alias("a"), F.when(F.col("id") % 7 > 0, F.xxhash64("id", F.lit(1))).alias("b"), "id")
    got = position_within(df, ["g"], ["a", "b", "id"], range_partitions=40)
    want = F.row_number().over(Window.partitionBy("g").orderBy("a", "b", "id"))
    assert got.withColumn("want", want).filter("position != want").count() == 0
    assert got.count() == 260_000


def test_dedup_idempotent(spark):
    rows = make_rows(150, seed=11)
    df = spark.createDataFrame([tuple(r[c] for c in [s.split()[0] for s in SCHEMA.split(", ")]) for r in rows], SCHEMA)
    once = merge.dedup(df, order_col="seq").select(*df.columns)
    twice = merge.dedup(once, order_col="seq").select(*df.columns)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_first_position_rule(spark):
    rows = [dict(repo="r", pr_number=1, seq=0, file_path="a", line_number=1, category="c", severity="low",
                 description="first", suggested_fix=None),
            dict(repo="r", pr_number=1, seq=1, file_path="b", line_number=1, category="c", severity="low",
                 description="other", suggested_fix=None),
            dict(repo="r", pr_number=1, seq=2, file_path="a", line_number=1, category="c", severity="critical",
                 description="replaces", suggested_fix=None)]
    got = spark_merge(spark, rows)
    assert [(r["description"], r["position"]) for r in got] == [("replaces", 1), ("other", 2)]
