"""Cohorts: landmark risk sets, incident events, prospective notes, matched sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinflow.functions.scalars import after, hours, unit_interval
from clinflow.operators.matching import match as match
from clinflow.operators.ordering import earliest, latest
from clinflow.shared import materialise


@dataclass(frozen=True)
class Outcome:
    """endpoint, disqualifiers: evidence tags. risk: which of them, at or before the landmark, takes a stay out of the risk set."""

    name: str
    endpoint: tuple[str, ...]
    disqualifiers: tuple[str, ...]
    risk: str = "disqualifiers"


def first_times(evidence: DataFrame, stay: str, tags: tuple[str, ...], name: str) -> DataFrame:
    return evidence.where(F.col("evidence").isin(*tags)).groupBy(stay).agg(F.min("event_time").alias(name))


def risk_set(stays: DataFrame, evidence: DataFrame, outcome: Outcome, stay: str = "stay_id", v1: bool = False) -> DataFrame:
    """stays at risk at landmark_time, with label and event_time (cases only).

    At risk: outtime after the landmark and none of the risk tags at or before it. Case: first endpoint in
    (landmark_time, horizon_end]. Control: no case, in the unit to the horizon, and (but for v1) no disqualifier by then; other stays are left out.
    """
    tags = evidence.where(F.col("evidence").isin(*set(outcome.endpoint + outcome.disqualifiers)))
    when = lambda names: F.when(F.col("evidence").isin(*names), F.col("event_time"))
    # a pass over the evidence: first endpoint, first disqualifier, first endpoint after the landmark
    joined = tags.join(stays.select(stay, "landmark_time"), stay)
    per = joined.groupBy(stay).agg(
        F.min(when(outcome.endpoint)).alias("_end"), F.min(when(outcome.disqualifiers)).alias("_dis"),
        F.min(F.when(F.col("event_time") > F.col("landmark_time"), when(outcome.endpoint))).alias("_next"),
        F.min(F.when(F.col("event_time") > F.col("landmark_time"), when(outcome.disqualifiers))).alias("_next_dis"),
    )
    rows = stays.join(per, stay, "left")
    before = F.col("_dis") if outcome.risk == "disqualifiers" else F.col("_end")
    rows = rows.where((F.col("outtime") > F.col("landmark_time")) & (before.isNull() | (before > F.col("landmark_time"))))
    case = F.coalesce(F.col("_next") <= F.col("horizon_end"), F.lit(False))
    clear = F.lit(True) if v1 else F.coalesce(F.col("_next_dis") > F.col("horizon_end"), F.lit(True))
    control = ~case & (F.col("outtime") >= F.col("horizon_end")) & clear
    out = rows.where(case | control).withColumn("label", case.cast("int")).withColumn("event_time", F.when(case, F.col("_next")))
    return out.drop("_end", "_dis", "_next", "_next_dis")


def landmark_grid(stays: DataFrame, evidence: DataFrame, outcome: Outcome, landmarks: list[int], horizon: int, stay: str = "stay_id") -> DataFrame:
    """landmark_hours, n_rows, n_cases of the risk sets at several landmarks (the older rules), from one pass over the evidence."""
    grid = stays.select("*", F.explode(F.array(*[F.lit(h) for h in landmarks])).alias("landmark_hours"))
    at = F.timestamp_add("HOUR", F.col("landmark_hours"), F.col("intime"))
    grid = grid.withColumn("landmark_time", at).withColumn("horizon_end", F.timestamp_add("HOUR", F.lit(horizon), F.col("landmark_time")))
    grid = grid.withColumn("_key", F.concat_ws(":", F.col(stay), F.col("landmark_hours")))
    tagged = evidence.join(grid.select(stay, "_key"), stay).drop(stay)
    got = risk_set(grid, tagged, outcome, "_key", v1=True)
    return got.groupBy("landmark_hours").agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_cases"))


def latest_note(stays: DataFrame, notes: DataFrame, h: float, stay: str = "stay_id", available: str = "available_time", tie: str = "note_id") -> DataFrame:
    """stay and the latest note available in [landmark - h hours, landmark]."""
    near = notes.join(stays.select(stay, "landmark_time"), stay).where((F.col(available) <= F.col("landmark_time")) & (F.col(available) >= after(F.col("landmark_time"), -h)))
    return latest(near.drop("landmark_time"), [stay], available, tie)


def incident(evidence: DataFrame, stays: DataFrame, endpoint: tuple[str, ...], prevalent: tuple[str, ...], washout: float, stay: str = "stay_id", subject: str = "subject_id", tie: str = "event_id") -> DataFrame:
    """First endpoint per stay, then per subject, at or after `washout` hours, of stays without any of the `prevalent` tags strictly before.

    evidence: stay, subject, event_time, evidence. An event exactly at the wash-out's end is an endpoint and makes no stay prevalent.
    """
    joined = evidence.join(stays.select(stay, "intime"), stay).withColumn("_early", F.col("event_time") < after(F.col("intime"), washout))
    early = joined.where(F.col("_early") & F.col("evidence").isin(*prevalent)).select(stay).distinct()
    fresh = joined.where(~F.col("_early") & F.col("evidence").isin(*endpoint)).join(early, stay, "left_anti").drop("intime", "_early")
    return earliest(earliest(fresh, [stay], "event_time", tie), [subject], "event_time", tie)


def concordance(anchors: DataFrame, comparators: DataFrame, key: str, t: str, u: str, windows: list[int]) -> DataFrame:
    """n_both, and how many pairs of first times lie within each number of hours."""
    a = anchors.groupBy(key).agg(F.min(t).alias("_t"))
    b = comparators.groupBy(key).agg(F.min(u).alias("_u"))
    d = F.abs(hours(F.col("_t"), F.col("_u")))
    return a.join(b, key).agg(F.count("*").alias("n_both"), *[F.count_if(d <= w).alias(f"within_{w}h") for w in windows])


def anchored_notes(events: DataFrame, notes: DataFrame, key: str, bins: list[tuple[float, float, str]], tie: str = "note_id") -> DataFrame:
    """key, event_time, time_bin, note: the closest note before the event in each bin."""
    from clinflow.functions.scalars import time_bin

    far = max(b[1] for b in bins)
    near = notes.join(events.select(key, "event_time"), key).where((F.col("chart_time") < F.col("event_time")) & (F.col("chart_time") >= after(F.col("event_time"), -far)))
    near = near.withColumn("time_bin", time_bin(hours(F.col("event_time"), F.col("chart_time")), bins)).where("time_bin is not null")
    return latest(near, [key, "event_time", "time_bin"], "chart_time", tie)


def anchors(events: DataFrame, notes: DataFrame, key: str, later: int) -> DataFrame:
    """key, anchor_type, event_time of every key with notes: its first event ('event'), or without one `later` hours after its last note ('stable_control')."""
    first = events.groupBy(key).agg(F.min("event_time").alias("_first"))
    last = notes.groupBy(key).agg(F.max("chart_time").alias("_last"))
    both = last.join(first, key, "left")
    return both.select(key, F.when(F.col("_first").isNull(), "stable_control").otherwise("event").alias("anchor_type"), F.coalesce("_first", F.timestamp_add("HOUR", F.lit(later), F.col("_last"))).alias("event_time"))


def binned_notes(anchors_: DataFrame, notes: DataFrame, key: str, bins: list[tuple[float, float, str]]) -> DataFrame:
    """key, anchor_type, note_id, category, time_bin, hours_before of the notes in a bin before their anchor."""
    from clinflow.functions.scalars import time_bin

    both = notes.join(anchors_, key).withColumn("hours_before", hours(F.col("event_time"), F.col("chart_time"))).withColumn("time_bin", time_bin(F.col("hours_before"), bins))
    return both.where("time_bin is not null").select(key, "anchor_type", "note_id", "category", "time_bin", "hours_before")


def closest_of_bins(binned: DataFrame, keys: list[str]) -> DataFrame:
    """The note closest to the anchor of each key and bin."""
    return earliest(binned, [*keys, "time_bin"], "hours_before", "note_id")


def one_category(binned: DataFrame, keys: list[str], bins: list[str], preference: list[str]) -> DataFrame:
    """For keys with a note of one category in all bins: the closest notes of that category, the first by preference (others after it, by name)."""
    closest = earliest(binned, [*keys, "time_bin", "category"], "hours_before", "note_id")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("category")), F.lit(0)), F.lit(99))
    whole = closest.groupBy(*keys, "category").agg(F.countDistinct("time_bin").alias("_n")).where(F.col("_n") == len(bins))
    chosen = whole.groupBy(*keys).agg(F.min_by("category", F.struct(rank, "category")).alias("category"))
    return closest.join(chosen, [*keys, "category"])


def sampled_sets(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """The rows of n keys of each stratum, drawn by seed; all keys where there are fewer."""
    from clinflow.operators.ordering import stratified_sample

    drawn = stratified_sample(rows.select(stratum, key).distinct(), [stratum], key, n, seed)
    return rows.join(drawn, [stratum, key], "left_semi")


def bad_sets(matched: DataFrame, controls: int, match_set: str = "match_set", label: str = "label") -> DataFrame:
    """Sets that do not have one case and `controls` controls."""
    per = matched.groupBy(match_set).agg(F.count("*").alias("n"), F.sum(label).alias("cases"))
    return per.where((F.col("n") != controls + 1) | (F.col("cases") != 1))


def whole_sets(matched: DataFrame, condition, match_set: str = "match_set") -> DataFrame:
    """Rows of the sets all of whose rows meet the condition."""
    good = matched.groupBy(match_set).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("_ok")).where("_ok").select(match_set)
    return matched.join(good, match_set, "left_semi")


def set_components(matched: DataFrame, match_set: str = "match_set", subject: str = "subject_id", rounds: int = 50) -> DataFrame:
    """match_set, component: sets that share a subject, directly or by way of others, have the smallest set's name in common."""
    pairs = materialise(matched.select(match_set, subject).distinct())
    labels = materialise(pairs.select(match_set).distinct().withColumn("component", F.col(match_set)))
    for _ in range(rounds):
        by_subject = pairs.join(labels, match_set).groupBy(subject).agg(F.min("component").alias("_c"))
        lower = pairs.join(by_subject, subject).groupBy(match_set).agg(F.min("_c").alias("component"))
        jump = lower.alias("a").join(lower.select(F.col(match_set).alias("component"), F.col("component").alias("_up")), "component", "left")
        new = materialise(jump.select(match_set, F.least("component", F.coalesce("_up", "component")).alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "_was"), match_set).where("component <> _was").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def clock_shifts(left: DataFrame, right: DataFrame, key: str, t: str, u: str, shifts: list[int], within: float = 1.0) -> DataFrame:
    """shift_hours, n_close, median_distance of left's times moved by each shift to the nearest of right's."""
    from clinflow.operators.ordered import nearest

    moved = left.select(key, t, F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift_hours")).withColumn("_moved", F.timestamp_add("HOUR", F.col("shift_hours"), F.col(t)))
    got = nearest(moved, right, key, "_moved", u)
    back, on = hours(F.col("_moved"), F.col("previous_time")), hours(F.col("following_time"), F.col("_moved"))
    d = F.least(back, on)
    return got.groupBy("shift_hours").agg(F.count_if(d <= within).alias("n_close"), F.percentile(d, 0.5).alias("median_distance"))


def best_shift(scan: DataFrame) -> DataFrame:
    """The shift with most close pairs, then the smallest median, then the smallest move, then the smallest shift."""
    return scan.orderBy(F.desc("n_close"), F.asc_nulls_last("median_distance"), F.abs("shift_hours"), "shift_hours").limit(1)


def filter_effect(before: DataFrame, after_: DataFrame, key: str, time: str) -> DataFrame:
    """n_before, n_lost (no note is left), n_older (the latest note is an older one) of a note filter."""
    a = before.groupBy(key).agg(F.max(time).alias("_a"))
    b = after_.groupBy(key).agg(F.max(time).alias("_b"))
    return a.join(b, key, "left").agg(F.count("*").alias("n_before"), F.count_if(F.col("_b").isNull()).alias("n_lost"), F.count_if(F.col("_b") < F.col("_a")).alias("n_older"))


def allocate(sizes: DataFrame, component: str, size: str, shares: tuple[float, ...] = (0.70, 0.15, 0.15), seed: int = 1) -> DataFrame:
    """component, part (0 ..): components in a seeded order are cut where the rows so far pass the shares, so no component is divided."""
    from clinflow.operators.ordered import carried, sliced
    from clinflow.operators.ordering import hash_order

    rows = sizes.select(component, F.col(size).alias("_n")).withColumn("_at", hash_order(seed, F.col(component)))
    rows = carried(sliced(rows, [], ["_at", component]), [], {"_rows": F.sum("_n")}, {"_before": (F.sum("_rows"), False), "_after": (F.sum("_rows"), True)})
    part = Window.partitionBy("_part")
    inside = F.sum("_n").over(part.orderBy("_at", component).rowsBetween(Window.unboundedPreceding, 0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = F.sum("_n").over(part) + zero("_before") + zero("_after")
    middle = (inside - F.col("_n") / 2 + zero("_before")) / whole
    out, edge = F.lit(len(shares) - 1), 1.0
    for k in range(len(shares) - 1, 0, -1):
        edge -= shares[k]
        out = F.when(middle < F.lit(edge), k - 1).otherwise(out)
    return rows.select(component, out.alias("part"))


def allocate_balanced(sizes: DataFrame, component: str, outcome: str, size: str, shares: tuple[float, ...] = (0.70, 0.15, 0.15), seed: int = 1, total: bool = False, rows: str | None = None) -> DataFrame:
    """component, part (0 ..): largest components first, each goes to the part whose own squared deviation of the outcomes' counts from its share is then least.

    total: the deviation of all parts together counts instead. A part's own deviation favours small parts while large ones are empty, and many small components can then miss the shares;
    the sum keeps them.

    Components of equal size go by falling `rows` (where given, a column that adds up as size does), then by a seeded draw. sizes: rows of component, outcome, size; repeated rows add up, null
    outcomes are one outcome, rows without a component are left out. Ties go to the first part. Each choice depends on the sums of all before it, so components, a row each, are sorted outside
    memory and streamed through one task that holds the sums of the parts alone.
    """
    known = sizes.where(F.col(component).isNotNull())
    per = known.groupBy(F.col(component).alias("_c"), F.coalesce(F.col(outcome).cast("string"), F.lit("")).alias("_o")).agg(F.sum(size).cast("double").alias("_n"), F.sum(rows or F.lit(0)).cast("double").alias("_r"))
    per = materialise(per)
    totals = {r["_o"]: r["n"] for r in per.groupBy("_o").agg(F.sum("_n").alias("n")).collect()}  # a row for each outcome
    names = sorted(totals)
    n = np.array([totals[o] for o in names])
    targets = np.outer(shares, np.append(n, n.sum()))
    weights = np.append(np.ones(len(names)), 0.25) / np.maximum(targets, 1.0)
    place = {o: i for i, o in enumerate(names)}
    whole = per.groupBy("_c").agg(F.collect_list("_o").alias("_o"), F.collect_list("_n").alias("_n"), F.sum("_n").alias("_all"), F.sum("_r").alias("_rows"))
    ordered = whole.withColumn("_u", unit_interval(F.lit(seed), F.col("_c"))).repartition(1).sortWithinPartitions(F.desc("_all"), F.desc("_rows"), "_u", "_c")

    def assign(batches):
        held = np.zeros_like(targets)
        for batch in batches:
            parts = np.zeros(len(batch), int)
            for i, (outcomes, counts) in enumerate(zip(batch["_o"], batch["_n"], strict=True)):
                full = np.zeros(targets.shape[1])
                full[[place[o] for o in outcomes]] = counts
                full[-1] = full.sum()
                costs = ((held + full - targets) ** 2 * weights).sum(1) - (((held - targets) ** 2 * weights).sum(1) if total else 0)
                parts[i] = costs.round(9).argmin()
                held[parts[i]] += full
            yield pd.DataFrame({component: batch["_c"], "part": parts})

    kind = sizes.schema[component].dataType.simpleString()
    return ordered.select("_c", "_o", "_n").mapInPandas(assign, f"`{component}` {kind}, part int")
