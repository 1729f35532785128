"""Boosted trees against a plain version, row by row in whole numbers and fractions of Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clinflow.operators import boosting as B

RULES = B.Boosting(rounds=25, least=20)


def plain(rows, held, rules, borders):
    """Probabilities of the rows of fold `held`, learnt from all others. rows: (id, features, y, fold)."""
    bins = [[B.MISSING if x is None else sum(e < x for e in es) for x, es in zip(r[1], borders, strict=True)] for r in rows]
    learn = [i for i, r in enumerate(rows) if r[3] != held and r[2] is not None]
    share = sum(rows[i][2] for i in learn) / len(learn)
    raw = [math.log(share / (1 - share))] * len(rows)

    def split_of(here):
        whole = [sum(slopes[i][k] for i in here) / B.SCALE for k in (0, 1)]
        own, best = whole[0] ** 2 / (whole[1] + rules.l2), (0.0, None)
        for f in range(len(borders)):
            missing = any(bins[i][f] == B.MISSING for i in here)
            for side in (False, True) if missing else (False,):
                g = h = n = 0
                if side:
                    for i in here:
                        if bins[i][f] == B.MISSING:
                            g, h, n = g + slopes[i][0], h + slopes[i][1], n + 1
                per = {}
                for i in here:
                    if bins[i][f] != B.MISSING:
                        a = per.setdefault(bins[i][f], [0, 0, 0])
                        a[0], a[1], a[2] = a[0] + slopes[i][0], a[1] + slopes[i][1], a[2] + 1
                for b in sorted(per):
                    g, h, n = g + per[b][0], h + per[b][1], n + per[b][2]
                    lg, lh, rg, rh = g / B.SCALE, h / B.SCALE, whole[0] - g / B.SCALE, whole[1] - h / B.SCALE
                    if n < rules.least or len(here) - n < rules.least or min(lh, rh) < 1e-3:
                        continue
                    gain = lg**2 / (lh + rules.l2) + rg**2 / (rh + rules.l2) - own
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b, side))
        return best

    for _ in range(rules.rounds):
        slopes = {}
        for i in range(len(rows)):
            p = 1 / (1 + math.exp(-raw[i]))
            slopes[i] = (round((p - (rows[i][2] or 0)) * B.SCALE), round(p * (1 - p) * B.SCALE))
        leaves = [("", learn, list(range(len(rows))), *split_of(learn))]
        while len(leaves) < rules.leaves:
            leaves.sort(key=lambda x: (-x[3], len(x[0]), x[0]))
            path, here, every, gain, split = leaves[0]
            if gain <= 0:
                break
            f, b, side = split
            left = lambda i, f=f, b=b, side=side: side if bins[i][f] == B.MISSING else bins[i][f] <= b
            leaves.pop(0)
            for name, keep in (("0", left), ("1", lambda i, left=left: not left(i))):
                part = [i for i in here if keep(i)]
                leaves.append((path + name, part, [i for i in every if keep(i)], *split_of(part)))
        for _, here, every, _, _ in leaves:
            value = -rules.rate * sum(slopes[i][0] for i in here) / B.SCALE / (sum(slopes[i][1] for i in here) / B.SCALE + rules.l2)
            for i in every:
                raw[i] += value
    return {r[0]: 1 / (1 + math.exp(-raw[i])) for i, r in enumerate(rows) if r[3] == held}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    out = []
    for i in range(2000):
        a, b, c = draw.randrange(60) / 7, draw.choice([None, None, draw.random()]), draw.gauss(0, 1)
        chance = 0.2 + 0.3 * (a > 4) + (0.25 if b is None else 0.2 * b) * (c > 0)
        out.append((i, (a, b, round(c, 1)), int(draw.random() < chance) if i % 97 else None, i % 3))
    return out


@pytest.mark.parametrize(("cells", "parts"), [(B.CELLS, 3), (0, 2)])
def test_equals_plain_boosting(spark, rows, cells, parts):
    """In one block, and by a job a level with scores written anew after ten rounds."""
    rules = RULES if cells else B.Boosting(rounds=12, least=20)
    df = spark.createDataFrame([(i, *x, y, f) for i, x, y, f in rows], "id long, a double, b double, c double, y int, fold int").repartition(parts)
    got = {r["id"]: r["probability"] for r in B.crossfit_boosted(df, ["a", "b", "c"], "y", "fold", "id", [0, 2], rules, cells).collect()}
    known = [r for r in rows if r[2] is not None]
    borders = [B.bin_edges(B.np.array([math.nan if r[1][k] is None else r[1][k] for r in known])).tolist() for k in range(3)]
    wanted = plain(rows, 0, rules, borders) | plain(rows, 2, rules, borders)
    assert got.keys() == wanted.keys()
    assert max(abs(got[i] - wanted[i]) for i in wanted) < 1e-9


def test_both_ways_are_the_same_bit_for_bit(spark, rows):
    df = spark.createDataFrame([(i, *x, y, f) for i, x, y, f in rows], "id long, a double, b double, c double, y int, fold int")
    models = [B.learn(df.repartition(n), ["a", "b", "c"], "y", "fold", [1], B.Boosting(rounds=3), cells) for n, cells in ((1, B.CELLS), (5, B.CELLS), (4, 0))]
    assert models[0].trees == models[1].trees == models[2].trees and models[0].trees[1]


def test_edges(spark):
    kind = "id long, x double, y int, fold int"
    df = spark.createDataFrame([(1, 0.5, 1, 1), (2, None, 1, 2), (3, float("nan"), None, 1), (4, 1.0, 0, None)], kind)
    got = {r["id"]: r["probability"] for r in B.crossfit_boosted(df, ["x"], "y", "fold", "id", [1, 2]).collect()}
    assert got.keys() == {1, 2, 3} and min(got.values()) > 0.99  # one class
    assert B.crossfit_boosted(df.limit(0), ["x"], "y", "fold", "id", [1, 2]).count() == 0
    few = spark.range(300).select("id", F.lit(None).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("fold"))
    got = B.crossfit_boosted(few, ["x"], "y", "fold", "id", [0, 1], B.Boosting(rounds=4))  # nothing to split on: the share stays
    assert got.select(F.round("probability", 3)).distinct().collect()[0][0] == pytest.approx(1 / 3, abs=0.01)


def test_borders():
    assert B.bin_edges(B.np.array([3.0, 1.0, B.np.nan, 1.0])).tolist() == [2.0]
    assert len(B.bin_edges(B.np.arange(10_000.0))) == B.BINS - 1
    assert B.binned(B.np.array([0.5, 2.0, 2.5, B.np.nan]), B.np.array([2.0])).tolist() == [0, 0, 1, B.MISSING]
