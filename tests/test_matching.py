"""Greedy choices against plain-Python versions, and generated tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clinflow.operators import cohort as C
from clinflow.operators import features as H
from clinflow.plans import registry
from clinflow.sources import generator as G


def unit(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def test_snapshot_match_equals_brute_force(spark):
    draw = random.Random(4)
    row = lambda i, s: (i, s, draw.choice("xy"), draw.choice(["a", "b", "c", None]), draw.randrange(0, 80) / 2)
    cases, controls = [row(i, i) for i in range(12)], [row(100 + i, 50 + i // 2) for i in range(160)]
    kind = "id long, subject_id long, source string, category string, clock double"
    whole = lambda rows: spark.createDataFrame(rows, kind).withColumn("all", F.lit(1))
    got = C.match(whole(cases), whole(controls), "all", "clock", k=3, seed=8, category="category", exact="source").collect()
    wanted, used = set(), set()
    for i, s, source, cat, clock in sorted(cases, key=lambda c: (c[2], c[3] is None, c[3] or "", c[4], c[1])):
        options = []
        for j, t, b, other, at in controls:
            d = abs(at - clock)
            if b == source and d <= 12 and t not in used:
                same = cat is not None and cat == other
                options.append(((0 if d <= 6 else 1) if same else (2 if d <= 6 else 3), d, unit(8, j), j, t))
        options.sort()
        seen = {}
        for o in options:
            seen.setdefault(o[4], o)
        if len(seen) >= 3:
            best = sorted(seen.values())[:3]
            used |= {o[4] for o in best}
            wanted |= {(str(i), i, 1, 0)} | {(str(i), o[3], 0, o[0]) for o in best}
    assert wanted and {(r["match_set"], r["id"], r["label"], r["match_priority"]) for r in got} == wanted


@pytest.mark.parametrize("total", [False, True])
def test_balanced_allocation_equals_brute_force(spark, total):
    draw = random.Random(5)
    rows = [(f"c{i}", o, draw.randrange(1, 9 if i else 40)) for i in range(120) for o in ("u", "v", None) if draw.random() < 0.6]
    got = {r["component"]: r["part"] for r in C.allocate_balanced(spark.createDataFrame(rows, "component string, outcome string, n int"), "component", "outcome", "n", seed=3, total=total).collect()}
    sizes = {}
    for c, o, n in rows:
        sizes.setdefault(c, {})[o] = n
    totals = {o: sum(s.get(o, 0) for s in sizes.values()) for o in ("u", "v", None)}
    held, wanted = [{}, {}, {}], {}
    for c in sorted(sizes, key=lambda c: (-sum(sizes[c].values()), unit(3, c))):
        costs = []
        for share, h in zip((0.70, 0.15, 0.15), held, strict=True):
            whole = share * sum(totals.values())

            def cost(more, h=h, share=share, whole=whole):
                each = sum((h.get(o, 0) + more.get(o, 0) - share * totals[o]) ** 2 / max(share * totals[o], 1) for o in totals)
                return each + 0.25 * (sum(h.values()) + sum(more.values()) - whole) ** 2 / max(whole, 1)

            costs.append(round(cost(sizes[c]) - (cost({}) if total else 0), 9))
        wanted[c] = costs.index(min(costs))
        for o, n in sizes[c].items():
            held[wanted[c]][o] = held[wanted[c]].get(o, 0) + n
    assert got == wanted


def test_balanced_allocation_of_many_keeps_the_shares(spark):
    rows = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("component"), F.lit("u").alias("outcome"), (F.col("id") % 5 + 1).alias("n"))
    got = C.allocate_balanced(rows, "component", "outcome", "n", total=True)
    assert got.count() == got.select("component").distinct().count() == 3000
    parts = {r["part"]: r["n"] for r in rows.join(got, "component").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    assert [round(parts[p] / 9000, 2) for p in range(3)] == [0.70, 0.15, 0.15]


def test_ties_of_size_go_by_rows(spark):
    rows = [("a", "u", 2, 1), ("b", "u", 2, 9), ("c", "u", 2, 5)]
    got = {r["component"]: r["part"] for r in C.allocate_balanced(spark.createDataFrame(rows, "component string, outcome string, n int, r int"), "component", "outcome", "n", shares=(0.34, 0.33, 0.33), rows="r").collect()}
    assert got == {"b": 1, "c": 2, "a": 0}  # the smaller shares lie nearest to two, the largest component by rows takes the first of them


def test_balanced_allocation_of_nothing(spark):
    none = spark.createDataFrame([], "component string, outcome string, n int")
    assert C.allocate_balanced(none, "component", "outcome", "n").count() == 0


@pytest.mark.parametrize("name", ["snapshot_match", "balanced_components"])
def test_greedy_queries_keep_their_rules(spark, tiny, name):
    got = registry.QUERIES[name](spark, tiny).toPandas()
    if name == "snapshot_match":
        assert (got.groupby("match_set")["label"].agg(["size", "sum"]) == [4, 1]).all(axis=None)
        assert not got["subject_id"].duplicated().any() and got["distance"].max() <= 12
    else:
        assert len(got) == got["match_set"].nunique() and (got.groupby("component")["part"].nunique() == 1).all()


def test_snapshots_of_one_stay_have_their_own_windows(spark):
    at = lambda h: f"2100-01-01 {h:02d}:00:00"
    m = spark.createDataFrame([(1, at(1), "hr", 80.0), (1, at(3), "hr", 90.0), (1, at(3), "hr", 94.0), (1, at(5), "hr", 900.0), (2, at(2), "hr", 70.0)], "stay_id int, charttime string, feature string, value double").withColumn("charttime", F.to_timestamp("charttime"))
    n = spark.createDataFrame([(1, 1, at(2)), (2, 1, at(6)), (3, 2, None), (4, None, at(4))], "note_id int, stay_id int, chart_time string").withColumn("chart_time", F.to_timestamp("chart_time"))
    got = {r["note_id"]: (r["hr_last"], r["hr_delta"]) for r in H.per_snapshot(m, n, ["hr"], 24).collect()}
    assert got == {1: (80.0, None), 2: (92.0, 12.0), 3: (None, None), 4: (None, None)}


def test_generated_tables_hang_together(spark):
    subjects = spark.createDataFrame([(i,) for i in [*range(1, 41), 7, None]], "subject_id long")
    made = G.related_tables(subjects, seed=2)
    stays = made["icustays"]
    assert stays.count() == 40 and made["chartevents"].count() == 40 * 36 * 5
    for name in ("chartevents", "inputevents_mv", "inputevents_cv", "procedureevents_mv"):
        assert made[name].join(stays, ["subject_id", "hadm_id", "icustay_id"], "left_anti").count() == 0
    assert made["chartevents"].join(made["d_items"], "itemid", "left_anti").count() == 0
    again = G.related_tables(subjects.repartition(5), seed=2)["labevents"]
    assert made["labevents"].exceptAll(again).count() == 0
    assert made["labevents"].exceptAll(G.related_tables(subjects, seed=3)["labevents"]).count() > 0
    assert all(t.count() == 0 for n, t in G.related_tables(subjects.limit(0)).items() if not n.startswith("d_"))


def test_made_charts_are_not_broadcast(spark, tiny):
    """Spark's estimate of the charts is that of their subjects."""
    plan = registry.QUERIES["synthetic_charts"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning(subject_id") == 2  # charts and courses stay where their subjects are


def one_pass(cases, controls, k, near=6.0, far=12.0, seed=1):
    """(match_set, id) of the one pass over all cases by falling clock. Rows: (id, subject, block, clock)."""
    wanted = set()
    for block in {c[2] for c in cases}:
        used = set()
        for i, s, _, clock in sorted((c for c in cases if c[2] == block), key=lambda c: (-c[3], c[0])):
            if s in used:
                continue
            options = sorted((abs(at - clock) > near, abs(at - clock), unit(seed, j), j, t) for j, t, b, at in controls if b == block and abs(at - clock) <= far and t not in used and t != s)
            best = {}
            for o in options:
                best.setdefault(o[4], o)
            if len(best) >= k:
                took = sorted(best.values())[:k]
                used |= {s} | {o[4] for o in took}
                wanted |= {(str(i), i)} | {(str(i), o[3]) for o in took}
    return wanted


@pytest.mark.parametrize(("parts", "chunk", "length", "piece"), [(1, 2000, 8, 50_000), (3, 4, 1, 7), (20, 3, 2, 5), (3, 1, 1, 1)])
def test_rounds_equal_one_pass(spark, monkeypatch, parts, chunk, length, piece):
    """Scarce controls, subjects on both sides and in many rows, ties of the clock: for several partitionings, chunks, lists and slices."""
    from clinflow.operators import matching

    monkeypatch.setattr(matching, "CHUNK", chunk)
    monkeypatch.setattr(matching, "LIST", length)
    monkeypatch.setattr(matching, "SLICE", piece)
    draw = random.Random(11)
    cases = [(i, draw.randrange(60), draw.choice("uv"), draw.randrange(0, 120) / 2) for i in range(24)]
    controls = [(100 + i, draw.randrange(40, 95), draw.choice("uuv"), draw.randrange(0, 140) / 2) for i in range(110)]
    df = lambda rows: spark.createDataFrame([*rows, (-1, 5, None, 1.0), (-2, 5, "u", None)] if rows is controls else rows, "id long, subject_id long, block string, clock double").repartition(parts)
    got = {(r["match_set"], r["id"]) for r in C.match(df(cases), df(controls), "block", "clock", k=2).collect()}
    assert got == one_pass(cases, controls, 2) and len(got) > 15


def test_more_controls_than_a_slice(spark):
    cases = [(i, i, "a", float(i)) for i in range(8)]
    controls = spark.range(60_000).selectExpr("1000 + id as id", "1000 + id % 50000 as subject_id", "'a' as block", "cast(id % 97 as double) / 4 as clock")
    got = {(r["match_set"], r["id"]) for r in C.match(spark.createDataFrame(cases, "id long, subject_id long, block string, clock double"), controls, "block", "clock", k=3).collect()}
    assert got == one_pass(cases, [tuple(r) for r in controls.select("id", "subject_id", "block", "clock").collect()], 3)


def test_matching_of_nothing(spark):
    none = spark.createDataFrame([], "id long, subject_id long, block string, clock double")
    some = spark.createDataFrame([(1, 1, "a", 1.0)], none.schema)
    assert C.match(none, some, "block", "clock").count() == 0 and C.match(some, none, "block", "clock").count() == 0


@pytest.mark.parametrize("most", [0, 60])
def test_large_blocks_go_in_rounds(spark, monkeypatch, most):
    """All blocks in rounds, or the one of 85 rows, and that of 49 in one task."""
    from clinflow.operators import matching

    monkeypatch.setattr(matching, "PASS", most)
    test_rounds_equal_one_pass(spark, monkeypatch, 3, 4, 1, 7)
    test_snapshot_match_equals_brute_force(spark)


@pytest.mark.parametrize("near", [6.0, 0.3])
def test_scarce_controls_and_equal_clocks_take_few_jobs(spark, near):
    """Many subjects share every clock and most controls are soon taken: rounds settle a handful of cases each."""
    draw = random.Random(3)
    at = [draw.randrange(0, 40) / 4 for _ in range(20)]
    cases = [(i, i % 170, draw.choice("uv"), at[i % 20]) for i in range(200)]
    controls = [(1000 + i, 150 + i % 140, draw.choice("uv"), at[i % 20] + draw.choice([0, 0, 0.25])) for i in range(260)]
    df = lambda rows: spark.createDataFrame(rows, "id long, subject_id long, block string, clock double").repartition(3)
    spark.sparkContext.setJobGroup(f"match {near}", "match")
    got = {(r["match_set"], r["id"]) for r in C.match(df(cases), df(controls), "block", "clock", k=3, near=near, far=2.0).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"match {near}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == one_pass(cases, controls, 3, near, 2.0) and len(got) > 100 and jobs < 40


def test_scarce_snapshots_take_few_jobs(spark):
    """More cases than controls can serve, of several categories and sources, with equal clocks."""
    draw = random.Random(9)
    row = lambda i, s: (i, s, draw.choice("xy"), draw.choice(["a", "b", None]), draw.randrange(0, 60) / 2)
    cases, controls = [row(i, i) for i in range(90)], [row(100 + i, 80 + i // 2) for i in range(220)]
    whole = lambda rows: spark.createDataFrame(rows, "id long, subject_id long, source string, category string, clock double").withColumn("all", F.lit(1))
    spark.sparkContext.setJobGroup("snapshots", "snapshots")
    got = {(r["match_set"], r["id"], r["match_priority"]) for r in C.match(whole(cases), whole(controls), "all", "clock", k=3, category="category", exact="source").collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("snapshots"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    wanted, used = set(), set()
    for i, s, source, cat, clock in sorted(cases, key=lambda c: (c[2], c[3] is None, c[3] or "", c[4], c[1])):
        options = sorted((2 * (cat is None or cat != other) + (abs(at - clock) > 6), abs(at - clock), unit(1, j), j, t) for j, t, b, other, at in controls if b == source and abs(at - clock) <= 12 and t not in used and t != s)
        best = {}
        for o in options:
            best.setdefault(o[4], o)
        if s not in used and len(best) >= 3:
            took = sorted(best.values())[:3]
            used |= {s} | {o[4] for o in took}
            wanted |= {(str(i), i, 0)} | {(str(i), o[3], o[0]) for o in took}
    assert got == wanted and len(got) > 60 and jobs < 40
