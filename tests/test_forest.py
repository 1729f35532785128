"""Forests on cells against a plain tree over repeated rows and against Spark ML's forest."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinflow.operators import forest as W
from clinflow.plans import registry


def plain(rows, depth, least):
    """Leaves of (bins, class) rows below: each row's share of class 1. Twin leaves that predict the same class are one."""
    gini = lambda some: 1 - sum((sum(y == c for _, y in some) / len(some)) ** 2 for c in (0, 1))
    best = (1e-12, None)
    if depth:
        for f in range(len(rows[0][0])):
            for b in range(max(x[f] for x, _ in rows)):
                left, right = [r for r in rows if r[0][f] <= b], [r for r in rows if r[0][f] > b]
                if min(len(left), len(right)) >= least:
                    fall = gini(rows) - (len(left) * gini(left) + len(right) * gini(right)) / len(rows)
                    if fall > best[0] + 1e-12:
                        best = (fall, (left, right))
    share = sum(y for _, y in rows) / len(rows)
    if best[1] is None:
        return share, True, {x: share for x, _ in rows}
    (p, one, a), (q, two, b) = (plain(side, depth - 1, least) for side in best[1])
    if one and two and (p > 0.5) == (q > 0.5):
        return share, True, {x: share for x, _ in rows}
    return share, False, a | b


@pytest.mark.parametrize(("depth", "least"), [(1, 5), (3, 20), (6, 4), (12, 50)])
def test_tree_equals_a_tree_of_repeated_rows(depth, least):
    draw = random.Random(depth)
    cells = [(a, b, c) for a in range(6) for b in range(5) for c in range(2)]
    counts = np.array([[draw.randrange(9) * (a + b > 3), draw.randrange(9) * (b != 2)] for a, b, c in cells]).T
    rows = [(x, y) for i, x in enumerate(cells) for y in (0, 1) for _ in range(counts[y, i])]
    wanted = plain(rows, depth, least)[2]
    got = W.grow(np.array(cells, np.uint8).T, counts, depth, least)
    assert {x: round(float(p), 9) for x, p in zip(cells, got, strict=True) if x in wanted} == {x: round(p, 9) for x, p in wanted.items()}
    assert len(set(wanted.values())) > 1 or depth == 12


def frame(spark, n=3000):
    x = spark.range(n).select("id", (F.col("id") % 3 + 1).cast("int").alias("fold"), F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(60)) / 60).alias("a"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000).alias("b"), (F.col("id") % 2).cast("double").alias("c"))
    return x.withColumn("y", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(100)) < F.when(F.col("a") > 0.5, 80).otherwise(20) + 15 * F.col("c")).cast("int"))


def test_forest_is_as_spark_mls(spark):
    df = frame(spark)
    one, two, ml = ({r["id"]: r["probability"] for r in W.crossfit_forest(df.repartition(n), ["a", "b"], ["c"], "y", "fold", "id", folds=3, trees=25, depth=5, cells=c).collect()} for n, c in ((1, None), (5, None), (2, 0)))
    assert one == two and len(one) == 3000  # neither partitions nor order matter
    apart = np.array([one[i] - ml[i] for i in ml])
    assert len(ml) == 3000 and np.abs(apart).mean() < 0.02 and abs(apart.mean()) < 0.005 and np.corrcoef(list(one.values()), [ml[i] for i in one])[0, 1] > 0.99


def test_split_points():
    assert W.split_points(np.array([3.0, 1.0, 1.0, np.nan, 2.0])).tolist() == [1.5, 2.5]
    assert len(W.split_points(np.arange(1000.0))) == 31 and len(W.split_points(np.full(5, 2.0))) == len(W.split_points(np.array([]))) == 0


def test_forest_of_odd_tables(spark):
    df = frame(spark, 400)
    odd = df.where("id < 40").select((F.col("id") + 1000).alias("id"), F.when(F.col("id") % 2 == 0, F.col("fold")).alias("fold"), F.lit(float("nan")).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("int").alias("y"))
    got = W.crossfit_forest(df.unionByName(odd), ["a", "b"], ["c"], "y", "fold", "id", folds=3, trees=12, depth=3).collect()
    assert len(got) == 420 and all(0 <= r["probability"] <= 1 for r in got)
    assert W.crossfit_forest(df.limit(0), ["a", "b"], ["c"], "y", "fold", "id").count() == 0
    alone = W.crossfit_forest(df.withColumn("fold", F.lit(1)), ["a", "b"], ["c"], "y", "fold", "id", folds=2, trees=12).collect()
    assert len(alone) == 400 and all(r["probability"] is None for r in alone)  # no other fold to learn from


def test_forest_query_has_no_job_for_a_level(spark, tiny):
    """Five fits of Spark ML are over a hundred jobs, each over all rows."""
    spark.sparkContext.setJobGroup("forest", "forest")
    got = registry.QUERIES["forest_crossfit"](spark, tiny)
    assert got.count() == got.select("case_id").distinct().count() == spark.read.parquet(f"{tiny}/orders.parquet").count()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) < 40
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
