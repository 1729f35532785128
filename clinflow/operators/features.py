"""Point-in-time features of anchored stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinflow.functions.scalars import capped, hours, in_range
from clinflow.operators.joins import active_at, lookback


def block(measures: DataFrame, anchors: DataFrame, names: list[str], h: float, delta: bool = False, key: str = "stay_id", time: str = "charttime", anchor: str = "landmark_time") -> DataFrame:
    """key and name_last (and name_delta) of each measurement in [anchor - h hours, anchor], over every anchor.

    Values out of range are dropped, values of one time are averaged, and a delta needs two times. One join,
    and one aggregation by (key, name, time) whose result is aggregated by key, for all names together.
    """
    near = lookback(measures.where(F.col("feature").isin(names)), anchors.select(key, anchor), key, time, anchor, h).where(in_range(F.col("feature"), F.col("value")))
    points = near.groupBy(key, "feature", time).agg(F.avg("value").alias("value"))
    aggs: list[Column] = []
    for n in names:
        own = F.col("feature") == n
        last, first = F.max_by(F.when(own, F.col("value")), F.when(own, F.col(time))), F.min_by(F.when(own, F.col("value")), F.when(own, F.col(time)))
        aggs.append(last.alias(f"{n}_last"))
        if delta:
            aggs.append(F.when(F.count_if(own) >= 2, last - first).alias(f"{n}_delta"))
    return anchors.select(key).join(points.groupBy(key).agg(*aggs), key, "left")


def per_snapshot(measures: DataFrame, snapshots: DataFrame, names: list[str], h: float, snapshot: str = "note_id", key: str = "stay_id", time: str = "charttime", at: str = "chart_time") -> DataFrame:
    """snapshot, name_last and name_delta of each measurement in [at - h hours, at] of the snapshot's own stay, over every snapshot.

    A stay may have many snapshots, each with a time of its own. Values of one time are averaged before the join, so repeated rows are not carried through it; a delta needs two times.
    Snapshots without a time or a stay have nulls.
    """
    points = measures.where(F.col("feature").isin(names)).where(in_range(F.col("feature"), F.col("value"))).groupBy(key, "feature", time).agg(F.avg("value").alias("value"))
    near = lookback(points, snapshots.select(snapshot, key, at), key, time, at, h)
    aggs: list[Column] = []
    for n in names:
        own = F.col("feature") == n
        v, t = F.when(own, F.col("value")), F.when(own, F.col(time))
        aggs += [F.max_by(v, t).alias(f"{n}_last"), F.when(F.count_if(own) >= 2, F.max_by(v, t) - F.min_by(v, t)).alias(f"{n}_delta")]
    return snapshots.select(snapshot).join(near.groupBy(snapshot).agg(*aggs), snapshot, "left")


def last_values(measures: DataFrame, anchors: DataFrame, names: list[str], h: float, tie: str, key: str = "stay_id", time: str = "charttime", anchor: str = "landmark_time") -> DataFrame:
    """key, name_last: the value of each measurement's last row in [anchor - h hours, anchor] with a value, as it stands; rows of one time by tie, then by value."""
    near = lookback(measures.where(F.col("feature").isin(names)), anchors.select(key, anchor), key, time, anchor, h).where("value is not null")
    last = lambda n: F.max_by("value", F.when(F.col("feature") == n, F.struct(time, tie, "value")))
    return anchors.select(key).join(near.groupBy(key).agg(*[last(n).alias(f"{n}_last") for n in names]), key, "left")


def signed_sum(volumes: DataFrame, anchors: DataFrame, h: float, name: str, key: str = "stay_id", time: str = "charttime", anchor: str = "landmark_time") -> DataFrame:
    """key, name: sum of `volume` in the window; null without rows."""
    near = lookback(volumes, anchors.select(key, anchor), key, time, anchor, h)
    return anchors.select(key).join(near.groupBy(key).agg(F.sum("volume").alias(name)), key, "left")


def demographics(stays: DataFrame, key: str = "stay_id") -> DataFrame:
    """key, age_capped in 0..90, sex as given."""
    return stays.select(key, capped(F.col("age"), 0, 90).alias("age_capped"))


def note_behaviour(notes: DataFrame, anchors: DataFrame, h: float, key: str = "stay_id", time: str = "chart_time", anchor: str = "landmark_time") -> DataFrame:
    """key, n_notes, n_categories, total_chars, latest_chars, mean_chars, hours_since_latest of the notes in the window; counts are 0 without notes."""
    near = lookback(notes, anchors.select(key, anchor), key, time, anchor, h)
    n = F.length("text")
    got = near.groupBy(key).agg(
        F.count("*").alias("n_notes"), F.countDistinct("category").alias("n_categories"), F.sum(n).alias("total_chars"),
        F.max_by(n, F.struct(time, "note_id")).alias("latest_chars"), F.avg(n).alias("mean_chars"), F.max(time).alias("_t"),
    )
    out = anchors.select(key, anchor).join(got, key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_notes", "n_categories", "total_chars")], "latest_chars", "mean_chars", hours(F.col(anchor), F.col("_t")).alias("hours_since_latest"))


def latest_and_flags(events: DataFrame, anchors: DataFrame, last: dict[str, Column], any_: dict[str, Column], h: float, key: str = "stay_id", time: str = "charttime", anchor: str = "landmark_time") -> DataFrame:
    """key, the latest non-null value of each `last`, 0/1 for each of `any_`, over the window."""
    near = lookback(events, anchors.select(key, anchor), key, time, anchor, h)
    aggs = [F.max_by(v, F.when(v.isNotNull(), F.col(time))).alias(n) for n, v in last.items()] + [F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in any_.items()]
    out = anchors.select(key).join(near.groupBy(key).agg(*aggs), key, "left")
    return out.select(key, *last, *[F.coalesce(n, F.lit(0)).alias(n) for n in any_])


def infusions(intervals: DataFrame, anchors: DataFrame, h: float, key: str = "stay_id", anchor: str = "landmark_time") -> DataFrame:
    """key, active_any, active_agents at the anchor, recent_any, recent_agents started in the window."""
    active = active_at(intervals, anchors.select(key, anchor), key, anchor).groupBy(key).agg(F.countDistinct("agent").alias("active_agents"))
    recent = lookback(intervals, anchors.select(key, anchor), key, "starttime", anchor, h).groupBy(key).agg(F.countDistinct("agent").alias("recent_agents"))
    out = anchors.select(key).join(active, key, "left").join(recent, key, "left").na.fill(0, ["active_agents", "recent_agents"])
    return out.select(key, (F.col("active_agents") > 0).cast("int").alias("active_any"), "active_agents", (F.col("recent_agents") > 0).cast("int").alias("recent_any"), "recent_agents")


def matrix(anchors: DataFrame, parts: list[DataFrame], expected: int, key: str = "stay_id") -> DataFrame:
    """anchors with every part's columns; the number of features is checked, and no key may repeat in a part."""
    out = anchors
    for p in parts:
        out = out.join(p, key, "left")
    found = sum(len(p.columns) - 1 for p in parts)
    if found != expected:
        raise ValueError(f"{found} features where {expected} were expected")
    return out


def fallback(first: Column, second: Column) -> Column:
    """The first source's value, else the second's."""
    return F.coalesce(first, second)


def levels(parts: dict[str, list[str]], all_features: list[str]) -> dict[str, list[str]]:
    """Nested feature lists A, AB, ...; together they must be all features, each once."""
    flat = [f for p in parts.values() for f in p]
    if sorted(flat) != sorted(all_features):
        raise ValueError("the levels are not all features, each once")
    out, so_far = {}, []
    for name, own in parts.items():
        so_far = so_far + own
        out[name] = list(so_far)
    return out
