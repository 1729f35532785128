"""Vectors of draws against plain loops over repeated rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinflow.operators import resampling as Z
from clinflow.operators import stats as I


def area(y, s):
    p, q = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q)) if p and q else None


def drawn_counts(spark, clusters, replicates):
    rows = spark.createDataFrame([(c,) for c in clusters], "c int").select("c", Z.draws(F.col("c"), replicates).alias("m")).collect()
    return {r["c"]: r["m"] for r in rows}


def test_draws_are_those_of_one_replicate_at_a_time(spark):
    got = drawn_counts(spark, range(30), 9)
    one = spark.range(30).selectExpr("cast(id as int) c").crossJoin(spark.range(1, 10).selectExpr("cast(id as int) r")).withColumn("m", I.multiplicity(F.col("c"), F.col("r"))).collect()
    assert all(got[r["c"]][r["r"] - 1] == r["m"] for r in one)


@pytest.mark.parametrize("parts", [1, 6])
def test_areas_equal_repeated_rows(spark, parts):
    draw = random.Random(2)
    rows = [(i % 20, int(draw.random() < 0.4), draw.randrange(11) / 11, draw.randrange(13) / 13) for i in range(150)]
    df = spark.createDataFrame([*rows, (3, 1, None, 0.5), (4, None, 0.1, 0.5)], "c int, y int, a double, b double").repartition(parts)
    got = {r["replicate"]: r for r in Z.cluster_bootstrap(df, "c", "y", "a", "b", 20).collect()}
    assert sorted(got) == list(range(1, 21))
    m = drawn_counts(spark, range(20), 21)
    k = 0
    for r in range(21):
        again = [x for x in rows for _ in range(m[x[0]][r])]
        a, b = (area([x[1] for x in again], [x[j] for x in again]) for j in (2, 3))
        if a is None or k == 20:
            continue
        k += 1
        assert got[k]["auc_base"] == pytest.approx(a) and got[k]["auc_other"] == pytest.approx(b) and got[k]["delta"] == pytest.approx(b - a)


def test_replaced_replicates(spark):
    """One case in one cluster: a third of the draws lack it, which is more than may be replaced; with twenty clusters of both classes none does."""
    few = spark.createDataFrame([(i, int(i == 0), i / 9, i / 7) for i in range(9)], "c int, y int, a double, b double")
    with pytest.raises(Exception, match="lack a class"):
        Z.cluster_bootstrap(few, "c", "y", "a", "b", 100).collect()
    # a case in each of four clusters: about one draw in 55 lacks all of them
    some = spark.createDataFrame([(i % 5, int(i < 4), i / 9, i / 7) for i in range(10)], "c int, y int, a double, b double")
    got = Z.cluster_bootstrap(some, "c", "y", "a", "b", 100).collect()
    assert sorted(r["replicate"] for r in got) == list(range(1, 101)) and all(r["auc_base"] is not None for r in got)


def plain_refit(rows, m, folds, penalty):
    """Areas of both models of one replicate, each fitted by its own loop on repeated rows."""
    again = np.array([x for x in rows for _ in range(m[x[0]])], float)
    y, fold, out = again[:, 1], again[:, 2], []
    for columns in ([3], [3, 4]):
        x, s = again[:, columns], np.zeros(len(again))
        for f in folds:
            here, train = fold == f, fold != f
            middle, spread = x[train].mean(0), x[train].std(0) + 1e-12
            z = np.column_stack([np.ones(len(x)), (x - middle) / spread])
            beta, ridge = np.zeros(z.shape[1]), np.r_[0.0, np.full(len(columns), penalty)]
            for _ in range(40):
                p = 1 / (1 + np.exp(-(z[train] @ beta)))
                h = (z[train] * (p * (1 - p))[:, None]).T @ z[train] + np.diag(ridge + 1e-9)
                beta -= np.linalg.solve(h, z[train].T @ (p - y[train]) + ridge * beta)
            s[here] = z[here] @ beta
        out.append(area(y.astype(int).tolist(), np.round(s, 9).tolist()))
    return out


@pytest.mark.parametrize(("parts", "most"), [(1, 4_000_000), (5, 40)])
def test_refits_equal_a_loop(spark, monkeypatch, parts, most):
    """In one range of scores, and in several."""
    monkeypatch.setattr(Z, "RANGE", most)
    draw = random.Random(7)
    rows = []
    for i in range(240):
        a, b = draw.gauss(0, 2) + 5, draw.randrange(9)
        rows.append((i % 40, int(draw.random() < 1 / (1 + np.exp(-(0.4 * (a - 5) + 0.5 * (b - 4))))), i % 40 % 4 + 1, a, float(b)))
    df = spark.createDataFrame(rows, "c int, y int, fold int, a double, b double").repartition(parts)
    got = {r["replicate"]: r for r in Z.refit_bootstrap(df, "c", "y", "fold", ["a"], ["b"], 6, penalty=0.7).collect()}
    m = drawn_counts(spark, range(40), 6)
    assert sorted(got) == list(range(1, 7))
    for r in range(6):
        base, more = plain_refit(rows, {c: v[r] for c, v in m.items()}, range(1, 5), 0.7)
        assert got[r + 1]["auc_base"] == pytest.approx(base, abs=2e-4) and got[r + 1]["auc_more"] == pytest.approx(more, abs=2e-4)
        assert got[r + 1]["delta"] == pytest.approx(more - base, abs=3e-4)


def test_refit_of_nothing(spark):
    assert Z.refit_bootstrap(spark.createDataFrame([], "c int, y int, fold int, a double, b double"), "c", "y", "fold", ["a"], ["b"], 5).count() == 0


def test_means_by_group(spark):
    rows = [(i, "u" if i % 3 else None, float(i % 17)) for i in range(90)] + [(900, "one", 4.0), (901, "u", float("nan")), (902, "u", None)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(3)
    got = {r["g"]: r for r in Z.mean_bootstrap(df, ["g"], "id", "v", 40).collect()}
    m = drawn_counts(spark, [r[0] for r in rows], 40)
    for g in ("u", None):
        own = [(i, v) for i, h, v in rows if h == g and v is not None and v == v]
        means = [sum(m[i][r] * v for i, v in own) / sum(m[i][r] for i, _ in own) for r in range(40)]
        assert got[g]["n"] == len(own) and got[g]["low"] == pytest.approx(np.quantile(means, 0.025)) and got[g]["high"] == pytest.approx(np.quantile(means, 0.975))
    assert got["one"]["n"] == 1 and got["one"]["low"] is None


def test_counts_of_workers_are_the_draws(spark):
    rows = spark.createDataFrame([("a",), ("7",), (None,), ("é|1",), ("",)], "c string").select(Z._key(F.col("c")).alias("k"), Z.draws(F.col("c"), 60, 3).alias("m")).collect()
    assert Z._counts([r["k"] for r in rows], 60, 3).tolist() == [r["m"] for r in rows]
    assert Z._counts([r["k"] for r in rows], 20, 3, first=41).tolist() == [r["m"][40:] for r in rows]


def test_rows_of_one_file_are_drawn_in_many_tasks(spark):
    """A row costs a digest for each replicate, so one partition of a small file is too much for a task."""
    df = spark.range(400).selectExpr("id", "cast(id % 7 as double) v").coalesce(1)
    plan = Z.mean_bootstrap(df, [], "id", "v", 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("RoundRobinPartitioning")


@pytest.mark.parametrize(("block", "width"), [(1 << 19, 105), (16, 4)])
def test_draws_of_equal_rows_are_added_up(spark, monkeypatch, block, width):
    """Rows of many clusters that agree in label, fold and features are one row for the refits."""
    monkeypatch.setattr(Z, "BLOCK", block)
    monkeypatch.setattr(Z, "WIDTH", width)
    rows = [(i % 40 if i % 7 else 1000, float(i % 2), i % 3, (i % 4) / 7, 1 + (i % 5 == 0) * 40_000) for i in range(300)]
    df = spark.createDataFrame(rows, "c int, y double, f int, x double, n long").repartition(3)
    got = {(r["y"], r["f"], r["x"]): np.frombuffer(r["_m"], np.int32) for r in Z._summed(df, "c", ["y", "f", "x"], "n", 10, 1, 300).collect()}
    m, wanted = drawn_counts(spark, [*range(40), 1000], 10), {}
    for c, y, f, x, n in rows:
        wanted[y, f, x] = wanted.get((y, f, x), 0) + n * np.array(m[c], np.int64)
    assert len(got) == 12 and all((got[k] == v).all() for k, v in wanted.items())
