"""Quality discriminant: densities, exact sums, held-out accuracy, cases of the docstring."""

import zlib

import numpy as np
from corpus_helpers import docs, with_extra
from pyspark.sql import functions as F

from reviewgrid.llm import op5_quality_qda as op
from reviewgrid.llm import queries


def sums(x, y):
    return (np.array([(y == k).sum() for k in (0, 1)]), np.stack([x[y == k].sum(axis=0) for k in (0, 1)]),
            np.stack([x[y == k].T @ x[y == k] for k in (0, 1)]))


def test_score_is_the_posterior_of_the_densities():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.normal(size=(400, 3)) * np.where(y[:, None], 1, 2) + y[:, None]
    m = op.fit(*sums(x, y), shrink=0.0, ridge=0.0)
    dens = []
    for k in (0, 1):
        c = np.cov(x[y == k].T, bias=True)
        d = x - x[y == k].mean(axis=0)
        dens.append(np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)) / np.sqrt(np.linalg.det(c)) * (y == k).mean())
    assert np.allclose(m.score(x), dens[1] / (dens[0] + dens[1]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_quality_discriminant(spark, sf)
    held = got.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = held.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("ok"),
                 F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept")).first()
    assert r.n > 800 and r.ok > 0.985 and r.kept > 0.995
    some = got.limit(200).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in some)


def test_defined_cases(spark):
    rows = [None, "", " \n", "one", "A! B? " * 500, "É ñ", (5, "É ñ"), (None, "a b")] + [f"text number {i} here." for i in range(20)]
    df = with_extra(docs(spark, rows))
    labels = spark.createDataFrame([(i, i % 2) for i in range(28)] + [(3, None), (None, 1), (999, 0)], "doc_id bigint, quality int")
    got = op.assess(df, labels, F.lit(True)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1 and len({r.score for r in got if r.doc_id == 5}) == 1
    ones = labels.withColumn("quality", F.lit(1))
    alone = {r.score for r in op.assess(df, ones, F.lit(True)).collect()}
    assert len(alone) == 1 and alone.pop() > 0.9  # a single class: its share
    assert {r.score for r in op.assess(df, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert op.assess(df.limit(0), labels, F.lit(True)).collect() == []
