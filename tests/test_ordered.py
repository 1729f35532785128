"""Orders dealt by ranges: as-of search, positions, ranks, hashes; and rules of single operators at their edges."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clinflow.operators import aggregates as A
from clinflow.operators import cohort as C
from clinflow.operators import ordered as O
from clinflow.operators import ordering as E
from clinflow.operators import stats as I


def test_a_hot_key_is_spread(spark):
    """Half of all rows have one key: no range holds more than its share, and searches over the ranges' borders are right."""
    draw = random.Random(1)
    left = [(i, "hot" if i % 2 else f"k{i % 5}", draw.choice([None, *range(400)])) for i in range(400)]
    right = [("hot" if i % 2 else f"k{i % 7}", draw.randrange(400)) for i in range(400)] + [("hot", None), (None, 3)]
    a, b = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, u int")
    held = O.sliced(a.withColumn("_t", F.col("t")), ["k"], ["_t"], 8).groupBy("_part").count().collect()
    assert len(held) >= 6 and max(r["count"] for r in held) < 150
    after = {r["i"]: r["next_time"] for r in O.next_after(a, b, "k", "t", "u").collect()}
    near = {r["i"]: (r["previous_time"], r["following_time"]) for r in O.nearest(a, b, "k", "t", "u").collect()}
    for i, k, t in left:
        own = [u for g, u in right if g == k and u is not None]
        assert after[i] == (None if t is None else min((u for u in own if u > t), default=None))
        assert near[i] == ((None, None) if t is None else (max((u for u in own if u <= t), default=None), min((u for u in own if u >= t), default=None)))


def test_positions(spark):
    rows = [(i, "ab"[i % 2] if i % 9 else None, (i * 37) % 50) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, v int").repartition(5)
    got = {r["i"]: (r["p"], r["n"]) for r in O.positions(df, ["v", "i"], ["k"], "p", "n").collect()}
    for key in ("a", "b", None):
        order = sorted((v, i) for i, k, v in rows if k == key)
        assert all(got[i] == (p, len(order)) for p, (_, i) in enumerate(order, 1))
    assert O.positions(df.limit(0), ["v"]).count() == 0


def test_rank_matrix(spark):
    draw = random.Random(2)
    rows = [tuple(draw.choice([None, draw.randrange(6), draw.random()]) for _ in range(3)) + (1.0, None) for _ in range(200)]
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in rows], "a double, b double, c double, same double, none double")
    got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in A.correlation_matrix(df, ["a", "b", "c", "same", "none"]).collect()}
    import pandas as pd

    for i, x in enumerate("abc"):
        for j, y in list(enumerate("abc"))[i + 1 :]:
            both = pd.DataFrame([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None], dtype=float)
            assert got[x, y][0] == len(both) and got[x, y][1] == pytest.approx(both[0].rank().corr(both[1].rank()))
    assert got["a", "same"][1] is None and got["a", "none"] == (0, None) and len(got) == 10


def test_streamed_hash(spark):
    rows = [(k, i, None if i % 5 == 0 else f"v{i % 3}") for k in ("x", "y", None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(6)
    digest = lambda some: hashlib.sha256("\n".join(sorted((f"{i}|{v or ''}" for _, i, v in some), key=str.encode)).encode()).hexdigest()
    got = {r["k"]: r["sha256"] for r in E.rows_hash(df, ["i", "v"], keys=["k"]).collect()}
    assert got == {k: digest([r for r in rows if r[0] == k]) for k in ("x", "y", None)}
    assert E.rows_hash(df, ["i", "v"]).first()[0] == digest(rows) and E.rows_hash(df.limit(0), ["i"]).first()[0] == hashlib.sha256().hexdigest()


def test_incident_boundaries(spark):
    """An endpoint exactly at the wash-out's end counts; other evidence before it makes the stay prevalent; at it, it does not."""
    start = datetime(2100, 1, 1)
    at = lambda stay, h, tag: (stay, stay // 10, int(h * 10) + stay, start + timedelta(hours=h), tag)
    evidence = [at(10, 6, "end"), at(20, 5.9, "other"), at(20, 8, "end"), at(30, 6, "other"), at(30, 7, "end"), at(40, 5, "end"), at(40, 9, "end"), at(50, 7, "none"), at(60, 8, "end"), at(61, 7, "end")]
    df = spark.createDataFrame(evidence, "stay_id int, subject_id int, event_id int, event_time timestamp, evidence string")
    stays = spark.createDataFrame([(s, start) for s in (10, 20, 30, 40, 50, 60, 61)], "stay_id int, intime timestamp")
    got = C.incident(df, stays, ("end",), ("end", "other"), 6)
    assert {r["stay_id"] for r in got.collect()} == {10, 30, 61}


def test_power_of_groups(spark):
    draw = random.Random(3)
    rows = [(g, int(draw.random() < 0.4), draw.random()) for g in "uv" for _ in range(150)] + [("w", 1, 0.5), ("w", 0, 0.4), ("x", 1, 0.2)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {(r["g"], r["correlation"]): r for r in I.power_table(df, ["g"], "y", "s", 0.05, [0.2, 0.8]).collect()}
    assert {g for g, _ in got} == {"u", "v", "w"} and got["w", 0.2]["power"] is None
    normal = __import__("statistics").NormalDist()

    def variance(a, n, m):
        q, p = a / (2 - a), 2 * a * a / (1 + a)
        return (a * (1 - a) + (n - 1) * (q - a * a) + (m - 1) * (p - a * a)) / (n * m)

    for g in "uv":
        cases, controls = [s for h, y, s in rows if h == g and y], [s for h, y, s in rows if h == g and not y]
        n, m = len(cases), len(controls)
        a = sum((x > z) + 0.5 * (x == z) for x in cases for z in controls) / (n * m)
        for c in (0.2, 0.8):
            power = lambda d, a=a, n=n, m=m, c=c: normal.cdf(d / math.sqrt((v := variance(a, n, m)) + (w := variance(a + d, n, m)) - 2 * c * math.sqrt(v * w)) - normal.inv_cdf(0.95))
            assert got[g, c]["auroc"] == pytest.approx(a) and got[g, c]["power"] == pytest.approx(power(0.05))
            found = got[g, c]["detectable"]
            assert power(0.2) < 0.8 if found is None else power(found) == pytest.approx(0.8, abs=1e-6)


def test_top_values(spark):
    rows = [("a" if i < 12 else "b" if i < 24 else f"r{i}", "5" if i % 2 else "", "on" if i % 3 == 0 else None) for i in range(40)]
    got = [tuple(r) for r in A.top_values(spark.createDataFrame(rows, "f string, g string, h string"), ["f", "g", "h"], ["h"], least=5, most=2).orderBy("field", "rank").collect()]
    assert got == [("f", 1, "a", 12, 4), ("f", 2, "b", 12, 4), ("g", 1, "5", 20, 7), ("h", 1, "on", 14, None)]


def test_windows_with_pseudo_anchors(spark):
    start = datetime(2100, 1, 1)
    notes = [(1, 1, "nursing", 0), (2, 1, "physician", 20), (3, 1, "nursing", 30), (4, 1, "nursing", 21), (5, 2, "general", 0), (6, 2, "general", 40), (7, 3, "nursing", 5)]
    notes = spark.createDataFrame([(i, s, c, start + timedelta(hours=h)) for i, s, c, h in notes], "note_id int, stay_id int, category string, chart_time timestamp")
    events = spark.createDataFrame([(1, start + timedelta(hours=32))], "stay_id int, event_time timestamp")
    anchors = C.anchors(events, notes, "stay_id", 3)
    assert {(r["stay_id"], r["anchor_type"], (r["event_time"] - start).total_seconds() / 3600) for r in anchors.collect()} == {(1, "event", 32.0), (2, "stable_control", 43.0), (3, "stable_control", 8.0)}
    bins = [(0.0, 24.0, "near"), (24.0, 72.0, "far")]
    binned = C.binned_notes(anchors, notes, "stay_id", bins)
    keys = ["stay_id", "anchor_type"]
    assert {(r["stay_id"], r["time_bin"], r["note_id"]) for r in C.closest_of_bins(binned, keys).collect()} == {(1, "near", 3), (1, "far", 1), (2, "near", 6), (2, "far", 5), (3, "near", 7)}
    one = C.one_category(binned, keys, ["near", "far"], ["general"])
    assert {(r["stay_id"], r["note_id"]) for r in one.collect()} == {(1, 3), (1, 1), (2, 6), (2, 5)}
    assert C.sampled_sets(one, "anchor_type", "stay_id", 1, 4).select("stay_id").distinct().count() == 2
