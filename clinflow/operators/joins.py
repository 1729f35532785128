"""Joins of events with intervals, anchors and each other, by key and a range condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinflow.functions.scalars import after


def containment(events: DataFrame, stays: DataFrame, key: str, time: str = "event_time", start: str = "intime", end: str = "outtime") -> DataFrame:
    """Events with the interval of the same key that holds them, both ends closed. Null keys and times match nothing."""
    return events.join(stays, key).where(F.col(time).between(F.col(start), F.col(end)))


def two_path(events: DataFrame, stays: DataFrame, stay: str = "stay_id", admission: str = "admission_id", time: str = "event_time", tag: str = "evidence", start: str = "intime", end: str = "outtime") -> DataFrame:
    """stay, time, tag: events with a stay id join on it, those without on the admission; both must lie in the stay. No repeats."""
    direct = events.where(F.col(stay).isNotNull()).select(stay, time, tag).join(stays.select(stay, start, end), stay)
    loose = events.where(F.col(stay).isNull() & F.col(admission).isNotNull()).select(admission, time, tag).join(stays.select(stay, admission, start, end), admission)
    both = direct.select(stay, time, tag, start, end).unionByName(loose.select(stay, time, tag, start, end))
    return both.where(F.col(time).between(F.col(start), F.col(end))).select(stay, time, tag).distinct()


def lookback(events: DataFrame, anchors: DataFrame, key: str, time: str, anchor: str, h: float, floor: Column | None = None) -> DataFrame:
    """Events of the same key in [anchor - h hours, anchor]; floor: nothing before it."""
    low = after(F.col(anchor), -h)
    return events.join(anchors, key).where((F.col(time) <= F.col(anchor)) & (F.col(time) >= (low if floor is None else F.greatest(low, floor))))


def active_at(intervals: DataFrame, anchors: DataFrame, key: str, anchor: str, start: str = "starttime", end: str = "endtime", rate: str | None = "rate") -> DataFrame:
    """Intervals with start <= anchor < end whose rate, if known, is above 0."""
    out = intervals.join(anchors, key).where((F.col(start) <= F.col(anchor)) & (F.col(anchor) < F.col(end)))
    return out if rate is None else out.where(F.col(rate).isNull() | (F.col(rate) > 0))


def strictly_before(left: DataFrame, right: DataFrame, key: str, time: str, event: str, h: float) -> DataFrame:
    """Rows of left less than h hours, or exactly h, before the event of the same key, and not at it."""
    return left.join(right, key).where((F.col(time) < F.col(event)) & (F.col(time) >= after(F.col(event), -h)))


def unique_on(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """df, after a check that no key repeats."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{name}: {keys} repeat")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """Join after a check of the sides that `validate` calls one."""
    if validate.startswith("one_to"):
        unique_on(left, keys, "left")
    if validate.endswith("to_one"):
        unique_on(right, keys, "right")
    return left.join(right, keys, how)


def same_rows(before: DataFrame, after_: DataFrame) -> DataFrame:
    """after_, after a check that it has as many rows as before."""
    if (n := before.count()) != (m := after_.count()):
        raise ValueError(f"rows changed from {n} to {m}")
    return after_


def lookup(df: DataFrame, table: dict, column: str, name: str) -> DataFrame:
    """df with `name` from a literal map; values without an entry give null."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return df.withColumn(name, F.try_element_at(m, F.col(column)))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: n_a, n_b, n_both, n_either, jaccard of two sets of ids."""
    x = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    y = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    got = x.join(y, key, "full").agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count("*").alias("n_either"))
    return got.withColumn("jaccard", F.try_divide(F.col("n_both"), F.col("n_either")))


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: n_missing (in a alone), n_extra (in b alone)."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    missing = x.join(y, key, "left_anti").agg(F.count("*").alias("n_missing"))
    return missing.join(y.join(x, key, "left_anti").agg(F.count("*").alias("n_extra")), how="cross")


def changed_columns(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Per column the rows that differ (numbers by more than the tolerance, a null from a value) or lack a partner."""
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    kinds = dict(a.dtypes)

    def differs(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        lone = F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()
        if kinds[c] in ("double", "float"):
            return lone | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
        return lone | ~x.eqNullSafe(y)

    wide = both.agg(*[F.count_if(differs(c)).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_changed")) for c in columns])).alias("x")).select("x.*")
