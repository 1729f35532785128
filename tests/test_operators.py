import math

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clinflow.operators import aggregates as A
from clinflow.operators import cohort as C
from clinflow.operators import joins as J
from clinflow.operators import models as M
from clinflow.operators import ordered as O
from clinflow.operators import ordering as E
from clinflow.operators import stats as I
from clinflow.operators import text as T

T0 = datetime(2024, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


def test_risk_set_edges(spark):
    stays = spark.createDataFrame([(i, at(0), at(out), at(12), at(24)) for i, out in ((1, 30), (2, 30), (3, 30), (4, 12), (5, 23), (6, 24), (7, 30))], "stay_id long, intime timestamp_ntz, outtime timestamp_ntz, landmark_time timestamp_ntz, horizon_end timestamp_ntz")
    ev = spark.createDataFrame([(1, at(12), "e"), (2, at(24), "e"), (3, at(13), "d"), (7, at(12.5), "e"), (5, at(13), "x")], "stay_id long, event_time timestamp_ntz, evidence string")
    o = C.Outcome("o", ("e",), ("e", "d"))
    got = {r["stay_id"]: (r["label"], r["event_time"]) for r in C.risk_set(stays, ev, o).collect()}
    # 1 is not at risk, 3 has a disqualifier, 4 left at the landmark, 5 left before the horizon
    assert got == {2: (1, at(24)), 6: (0, None), 7: (1, at(12.5))}
    assert {r["stay_id"] for r in C.risk_set(stays, ev, o, v1=True).collect()} == {2, 3, 6, 7}


def test_next_after_is_strict(spark):
    a = spark.createDataFrame([(1, 1, 5), (2, 1, 7), (3, 2, 1), (4, 1, 7)], "i int, k int, t int")
    b = spark.createDataFrame([(1, 5), (1, 7), (1, 9)], "k int, u int")
    assert {r["i"]: r["next_time"] for r in O.next_after(a, b, "k", "t", "u").collect()} == {1: 7, 2: 9, 4: 9, 3: None}
    got = {r["i"]: (r["previous_time"], r["following_time"]) for r in O.nearest(a, b, "k", "t", "u").collect()}
    assert got == {1: (5, 5), 2: (7, 7), 4: (7, 7), 3: (None, None)}


def test_checked_join(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="repeat"):
        J.checked_join(a, b, ["k"])


def test_first_last_guards(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 7.0), ("b", 1, 5.0), ("b", 2, None), ("b", 3, 8.0)], "k string, t int, v double")
    one = {r["k"]: (r["last_value"], r["delta"]) for r in A.first_last(A.collapse_times(df, ["k"], "t", "v"), ["k"], "t", "v").collect()}
    assert one == {"a": (6.0, None), "b": (8.0, 3.0)}


def test_latest_breaks_ties(spark):
    df = spark.createDataFrame([("a", 2, 1, "x"), ("a", 2, 2, None), ("a", None, 9, "z")], "k string, t int, tie int, v string")
    assert [tuple(r) for r in E.latest(df, ["k"], "t", "tie").collect()] == [("a", 2, 2, None)]


def test_weighted_auc_by_hand(spark):
    y, p = [0, 1, 1, 0, 0, 1, 0, 1], [0.05, 0.8, 0.2, 0.65, 0.4, 0.55, 0.1, 0.9]
    w = [2, 2, 0, 1, 1, 3, 1, 1]
    rows = [(a, b, c) for a, b, c in zip(y, p, w, strict=True)]
    pairs = [(wi * wj, 1.0 if pi > pj else 0.5 if pi == pj else 0.0) for yi, pi, wi in rows for yj, pj, wj in rows if yi == 1 and yj == 0]
    wanted = sum(a * b for a, b in pairs) / sum(a for a, _ in pairs)
    df = spark.createDataFrame(rows, "y int, p double, w int")
    assert I.auroc(df, "y", "p", weight="w").first()["auroc"] == pytest.approx(wanted)
    assert I.auroc(df.where("y = 1"), "y", "p").first()["auroc"] is None


def test_centred_p(spark):
    df = spark.createDataFrame([(x,) for x in (0.016, 0.018, 0.019, 0.020, 0.021, 0.023)], "d double")
    assert I.centred_p(df, "d", 0.02).first()["p"] == pytest.approx(1 / 7)


def test_newton_solves_score_equations(spark):
    rows = [(1 if (i * 7) % 10 < 3 else 0, ((i * 13) % 19 + 0.5) / 20) for i in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    a, (b, c) = I.calibration_in_the_large(df, "y", "p"), I.recalibration(df, "y", "p")
    import math

    lg = [math.log(p / (1 - p)) for _, p in rows]
    assert sum(y - 1 / (1 + math.exp(-(a + z))) for (y, _), z in zip(rows, lg, strict=True)) == pytest.approx(0, abs=1e-6)
    for k in (0, 1):
        assert sum((y - 1 / (1 + math.exp(-(b + c * z)))) * z**k for (y, _), z in zip(rows, lg, strict=True)) == pytest.approx(0, abs=1e-5)


def test_bootstrap_weights_are_whole_clusters(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(70)], "c int, i int").withColumn("w", I.multiplicity(F.col("c"), F.lit(3)))
    assert df.groupBy("c").agg(F.countDistinct("w").alias("n")).where("n > 1").count() == 0
    mean = spark.range(20000).select(I.multiplicity(F.col("id"), F.lit(1)).alias("w")).agg(F.avg("w")).first()[0]
    assert mean == pytest.approx(1, abs=0.03)


def test_folds(spark):
    df = spark.createDataFrame([(i % 101, int(i % 9 == 0)) for i in range(2000)], "g int, y int")
    folds = M.group_folds(df, "g", "y")
    assert folds.count() == 101 and folds.groupBy("fold").count().where("count < 15 or count > 27").count() == 0
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, M.group_folds(df, "g", "y").collect()))


def test_match_rules(spark):
    cases = spark.createDataFrame([(1, 1, "a", 10.0), (2, 2, "a", 50.0), (3, 3, "b", 5.0)], "id long, subject_id long, b string, t double")
    controls = spark.createDataFrame([(10, 10, "a", 11.0), (11, 11, "a", 16.0), (12, 12, "a", 30.0), (13, 1, "a", 10.0), (14, 14, "a", 21.0), (20, 20, "b", 6.0)], "id long, subject_id long, b string, t double")
    got = C.match(cases, controls, "b", "t", k=2)
    assert sorted((r["match_set"], r["id"]) for r in got.collect()) == [("1", 1), ("1", 10), ("1", 11)]
    assert C.bad_sets(got, 2).count() == 0


def test_components(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 3), ("e", 4), ("f", 4)], "match_set string, subject_id int")
    assert dict(map(tuple, C.set_components(df).collect())) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e"}


def test_derangement(spark):
    df = spark.createDataFrame([(i, i // 3, "s", float(i)) for i in range(30)], "id int, subject int, stratum string, v double")
    got = E.deranged(df, "stratum", "subject", "id", ["v"])
    assert got.count() == 30 and got.where("donor_subject is null or donor_subject = subject").count() == 0
    assert sorted(r["v"] for r in got.collect()) == [float(i) for i in range(30)]


def test_text(spark):
    df = spark.createDataFrame([("thinking {\"a\": 2} {\"a\": 0.5, \"b\": 1} {\"a\": \"x\"}",), ("none",)], "t string")
    assert [r[0] for r in df.select(T.last_scores(F.col("t"), ["a", "b"])).collect()] == [{"a": 0.5, "b": 1.0}, None]
    hit = T.mentions(F.col("t"), [r"\bre-?intubated\b", r"started (?:hemo)?dialysis", "withdrawal of care"])
    texts = ["Reintubated", "started hemodialysis today", "withdrawal of care", "BiPAP continued", "HD stable", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(hit).collect()] == [True, True, True, False, False, False]


def greedy(lengths, base, most, size):
    out, open_, used = [], [], base
    for i, n in enumerate(lengths):
        if open_ and (len(open_) >= size or used + n > most):
            out.append(open_)
            open_, used = [], base
        open_, used = open_ + [i], used + n
    return out + ([open_] if open_ else [])


def test_packs(spark):
    cases = [[5, 5, 5, 5, 5], [50, 1, 1], [], [19, 1, 1, 1, 1, 30, 2]]
    df = spark.createDataFrame([(c,) for c in cases], "x array<int>")
    assert [r[0] for r in df.select(T.packs(F.col("x"), 10, 30, 4)).collect()] == [greedy(c, 10, 30, 4) for c in cases]


def test_power():
    assert I.hanley_mcneil(0.5, 100, 100) == pytest.approx(0.00168, abs=1e-4)
    assert math.isnan(I.hanley_mcneil(0.7, 1, 50)) and math.isnan(I.hanley_mcneil(0.7, 50, 1))
    assert I.hanley_mcneil(1.0, 10, 10) == I.hanley_mcneil(1 - 1e-6, 10, 10) > 0
    for alpha, wanted in ((0.05, 0.8), (0.01, 0.9)):
        d = I.detectable(0.8, 300, 6000, 0.5, alpha, wanted)
        assert I.power(0.8, d, 300, 6000, 0.5, alpha) == pytest.approx(wanted, abs=1e-6)
    assert I.power(0.8, 1e-9, 300, 6000, 0.5, 0.05) == pytest.approx(0.05, abs=1e-3)
    assert I.detectable(0.6, 5, 20, 0.0) is None and I.detectable(0.99, 5000, 50000, 0.9) <= 0.009


def test_allocate_keeps_components_whole(spark):
    got = C.allocate(spark.range(200).selectExpr("id as c", "1 + id % 3 as n"), "c", "n")
    share = {r["part"]: r["n"] for r in got.join(spark.range(200).selectExpr("id as c", "1 + id % 3 as n"), "c").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    assert got.count() == 200 and abs(share[0] / sum(share.values()) - 0.7) < 0.03


@pytest.mark.parametrize("falling", [False, True])
def test_running_sums_over_ranges_equal_one_pass(spark, falling):
    rows = [(k, float(v) / 7, v % 5) for k in ("a", "b", None) for v in range(-150, 150, 1 if k == "a" else 3)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    for keys in ([], ["k"]):
        one = df if keys else df.where("k = 'a'")
        ranged, plain = (sorted(map(str, A.running_sums(one, "v", {"n": "s"}, keys, parts, falling).collect())) for parts in (8, 1))
        assert ranged == plain and len(ranged) == one.count()
    assert A.running_sums(df.where("false"), "v", {"n": "s"}, ["k"]).count() == 0
