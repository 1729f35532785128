from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clinflow.functions import scalars as S


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_both_scales_at_their_bounds(spark):
    inside = {0.005: 0.5, 0.4: 40.0, 1.0: 100.0, 20.0: 20.0, 35.5: 35.5, 100.0: 100.0}
    outside = [-0.3, 0.0, 1.0001, 5.0, 19.999, 100.5]
    got = column(spark, [*inside, *outside, None], "double", S.percent_of_fraction)
    assert got[: len(inside)] == pytest.approx(list(inside.values())) and got[len(inside) :] == [None] * (len(outside) + 1)


def test_who_is_eligible(spark):
    cases = {(18.5, "TSICU"): True, (17.5, "TSICU"): False, (18.0, "NICU "): False, (18.0, "nIcU"): False, (90.0, ""): True, (-1.0, "CCU"): False, (None, None): False}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, age double, unit string")
    assert [r[0] for r in df.orderBy("i").select(S.eligible(F.col("age"), F.col("unit"))).collect()] == list(cases.values())


def test_airway(spark):
    assert column(spark, ["1.0 ET/Trach", " No Response-ETT", "1", "No Response", None], "string", S.airway_coded) == [True, True, False, False, False]


def test_ages_of_any_length(spark):
    df = spark.createDataFrame([(datetime(1999, 3, 1), datetime(1999, 3, 1)), (datetime(1650, 5, 5), datetime(2050, 5, 5)), (datetime(2000, 1, 2), datetime(2000, 1, 1)), (None, datetime(2000, 1, 1))], "b timestamp_ntz, t timestamp_ntz")
    got = [r[0] for r in df.select(S.age_years(F.col("b"), F.col("t"))).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(400, abs=0.01) and got[2] < 0 and got[3] is None


def test_casts(spark):
    assert column(spark, ["1.5", "abc", "nan", None, " 7 "], "string", S.number) == [1.5, None, None, None, 7.0]
    assert column(spark, ["1.5", "abc"], "string", S.whole_number) == [1, None]
    assert column(spark, ["\t a \n", "", None], "string", S.not_blank) == [True, False, False]


def test_error_rules_differ(spark):
    values = ["0", "1", "1.0", None, "x"]
    assert column(spark, values, "string", S.error_is_zero) == [True, False, False, True, True]
    assert column(spark, values, "string", S.error_not_one) == [True, False, True, True, True]


def test_bins_at_edges(spark):
    assert column(spark, [0.0, 0.1, 0.3, 0.7, 0.9999, 1.0, None], "double", S.equal_width_bin) == [0, 1, 3, 7, 9, 9, None]
    assert column(spark, [0.0, 6.0, 6.1, 12.0, 24.0, 24.1], "double", S.time_bin) == [None, "0-6", "6-12", "6-12", "12-24", None]


def test_ranges(spark):
    df = spark.createDataFrame([("hr", 0.0), ("hr", 299.0), ("spo2", 100.0), ("gcs_eye", 1.0), ("ph", 8.5), ("other", 1.0), ("hr", None)], "n string, v double")
    assert [r[0] for r in df.select(S.in_range(F.col("n"), F.col("v"))).collect()] == [False, True, True, True, False, False, False]


def test_closed_levels_raise(spark):
    df = spark.createDataFrame([("a",), ("z",)], "x string")
    with pytest.raises(Exception, match="unexpected level"):
        df.select(*S.one_hot(F.col("x"), ["a", "b"], "x_")).collect()
    with pytest.raises(Exception, match="neither M nor F"):
        df.select(S.sex_code(F.col("x"))).collect()


def test_misc(spark):
    assert column(spark, [98.6, 60.0, None], "double", lambda x: F.round(S.celsius(x), 6)) == [37.0, None, None]
    assert column(spark, ["TRUE", " y", "0", None], "string", S.truthy) == [True, True, False, False]
    assert column(spark, ["abc", "中文", None], "string", S.has_cjk) == [False, True, False]
    assert column(spark, ["Physician ", "RESP care", "x", None], "string", S.note_group) == ["physician", "respiratory", "other", None]
