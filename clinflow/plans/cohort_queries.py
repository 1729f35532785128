"""Queries over stays, evidence, notes and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.functions import scalars as S
from clinflow.operators import aggregates as A
from clinflow.operators import cohort as C
from clinflow.operators import features as H
from clinflow.operators import joins as J
from clinflow.operators import ordered as O
from clinflow.operators import ordering as E
from clinflow.plans import fixtures as X
from clinflow.plans.register import Register

R = Register()
DEATH = C.Outcome("endpoint_only", ("purchase",), ("purchase", "error"), risk="endpoint")
ENDPOINT = C.Outcome("all", ("purchase",), ("purchase", "error"))


def r6(c, name):
    return F.round(c, 6).alias(name)


def _risk(kind: str) -> str:
    before = "dis" if kind == "all" else "endp"
    return f"""
fi AS (
  SELECT st.stay_id, min(CASE WHEN evidence = 'purchase' THEN event_time END) AS endp, min(event_time) AS dis,
         min(CASE WHEN evidence = 'purchase' AND event_time > landmark_time THEN event_time END) AS nxt, min(CASE WHEN event_time > landmark_time THEN event_time END) AS nxtd
  FROM st JOIN evi ON evi.stay_id = st.stay_id GROUP BY 1
),
rs AS (
  SELECT st.*, CASE WHEN coalesce(nxt <= horizon_end, false) THEN 1 ELSE 0 END AS label, CASE WHEN nxt <= horizon_end THEN nxt END AS event_time
  FROM st LEFT JOIN fi ON fi.stay_id = st.stay_id
  WHERE outtime > landmark_time AND ({before} IS NULL OR {before} > landmark_time)
    AND (coalesce(nxt <= horizon_end, false) OR (outtime >= horizon_end AND coalesce(nxtd > horizon_end, true)))
)"""


@R.add(_risk("all") + " SELECT stay_id, subject_id, label, epoch_us(landmark_time) AS landmark_us, epoch_us(event_time) AS event_us FROM rs")
def landmark_risk_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 with all disqualifiers."""
    got = C.risk_set(X.stays(spark, sf_dir), X.evidence(spark, sf_dir), ENDPOINT)
    return got.select("stay_id", "subject_id", "label", S.micros(F.col("landmark_time")).alias("landmark_us"), S.micros(F.col("event_time")).alias("event_us"))


@R.add(_risk("endpoint") + " SELECT stay_id, label, dbsource FROM rs")
def landmark_risk_set_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 where only the endpoint itself takes a stay out of the risk set."""
    return C.risk_set(X.stays(spark, sf_dir), X.evidence(spark, sf_dir), DEATH).select("stay_id", "label", "dbsource")


@R.add("""
g AS (SELECT stay_id, h AS landmark_hours, outtime, intime + to_hours(h) AS lm, intime + to_hours(h + 12) AS hz FROM st, (SELECT unnest([6, 12, 24, 36]) AS h)),
fi AS (
  SELECT g.stay_id, landmark_hours, min(event_time) AS dis, min(CASE WHEN evidence = 'purchase' AND event_time > lm THEN event_time END) AS nxt
  FROM g JOIN evi ON evi.stay_id = g.stay_id GROUP BY 1, 2
)
SELECT landmark_hours, count(*) AS n_rows, sum(CASE WHEN coalesce(nxt <= hz, false) THEN 1 ELSE 0 END)::BIGINT AS n_cases
FROM g LEFT JOIN fi USING (stay_id, landmark_hours)
WHERE outtime > lm AND (dis IS NULL OR dis > lm) AND (coalesce(nxt <= hz, false) OR outtime >= hz) GROUP BY 1
""")
def landmark_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    return C.landmark_grid(X.stays(spark, sf_dir), X.evidence(spark, sf_dir), ENDPOINT, [6, 12, 24, 36], 12)


@R.add("""
av AS (SELECT nt.*, coalesce(greatest(chart_time, store_time), chart_time) AS available_time FROM nt)
SELECT stay_id, note_id, epoch_us(available_time) AS available_us FROM (
  SELECT av.*, row_number() OVER (PARTITION BY st.stay_id ORDER BY available_time DESC, note_id DESC) AS rn
  FROM av JOIN st ON st.stay_id = av.stay_id WHERE available_time <= landmark_time AND available_time >= landmark_time - INTERVAL 12 HOUR) WHERE rn = 1
""")
def prospective_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest note by availability."""
    n = X.notes(spark, sf_dir).withColumn("available_time", S.later_of(F.col("chart_time"), F.col("store_time")))
    return C.latest_note(X.stays(spark, sf_dir), n, 12).select("stay_id", "note_id", S.micros(F.col("available_time")).alias("available_us"))


@R.add("""
d AS (SELECT greatest(1, ceil(quantile_cont(date_diff('microsecond', chart_time, store_time) / 3.6e9, 0.9))) AS q FROM nt WHERE store_time IS NOT NULL)
SELECT note_id, epoch_us(CASE WHEN store_time IS NULL THEN chart_time + to_hours(CAST(q AS BIGINT)) ELSE greatest(chart_time, store_time) END) AS available_us FROM nt, d
""")
def fallback_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a missing store time is the chart time and the usual delay."""
    n = X.notes(spark, sf_dir)
    delay = n.where("store_time is not null").agg(F.greatest(F.lit(1.0), F.ceil(F.percentile(S.hours(F.col("store_time"), F.col("chart_time")), 0.9))).cast("int").alias("q"))
    late = F.timestamp_add("HOUR", F.col("q"), F.col("chart_time"))
    return n.join(F.broadcast(delay), how="cross").select("note_id", S.micros(F.when(F.col("store_time").isNull(), late).otherwise(S.later_of(F.col("chart_time"), F.col("store_time")))).alias("available_us"))


@R.add("""
x AS (SELECT ev.*, intime FROM ev JOIN st USING (stay_id)),
f AS (SELECT * FROM x WHERE event_type = 'purchase' AND event_time >= intime + INTERVAL 6 HOUR AND stay_id NOT IN (SELECT stay_id FROM x WHERE event_type IN ('purchase', 'error') AND event_time < intime + INTERVAL 6 HOUR)),
a AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY event_time, event_id) AS r1 FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY event_time, event_id) AS r2 FROM a WHERE r1 = 1)
SELECT subject_id, stay_id, event_id FROM b WHERE r2 = 1
""")
def incident_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from the sixth hour on, of stays without a purchase or error before it."""
    return C.incident(X.evidence(spark, sf_dir), X.stays(spark, sf_dir), ("purchase",), ("purchase", "error"), 6).select("subject_id", "stay_id", "event_id")


@R.add("""
a AS (SELECT stay_id, min(event_time) AS t FROM evi WHERE evidence = 'error' GROUP BY 1), b AS (SELECT stay_id, min(event_time) AS u FROM evi WHERE evidence = 'purchase' GROUP BY 1),
d AS (SELECT abs(date_diff('microsecond', u, t)) / 3.6e9 AS d FROM a JOIN b USING (stay_id))
SELECT count(*) AS n_both, count(*) FILTER (d <= 1) AS within_1h, count(*) FILTER (d <= 6) AS within_6h, count(*) FILTER (d <= 12) AS within_12h FROM d
""")
def endpoint_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    e = X.evidence(spark, sf_dir)
    return C.concordance(e.where("evidence = 'error'"), e.where("evidence = 'purchase'"), "stay_id", "event_time", "event_time", [1, 6, 12])


@R.add("""
f AS (SELECT stay_id, min(event_time) AS event_time FROM evi GROUP BY 1),
x AS (SELECT nt.stay_id, note_id, chart_time, date_diff('microsecond', chart_time, event_time) / 3.6e9 AS h FROM nt JOIN f USING (stay_id)),
y AS (SELECT *, CASE WHEN h > 0 AND h <= 6 THEN '0-6' WHEN h > 6 AND h <= 12 THEN '6-12' WHEN h > 12 AND h <= 24 THEN '12-24' END AS time_bin FROM x)
SELECT stay_id, time_bin, note_id FROM (SELECT *, row_number() OVER (PARTITION BY stay_id, time_bin ORDER BY chart_time DESC, note_id DESC) AS rn FROM y WHERE time_bin IS NOT NULL) WHERE rn = 1
""")
def anchored_note_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6, C12, E2, B32."""
    first = X.evidence(spark, sf_dir).groupBy("stay_id").agg(F.min("event_time").alias("event_time"))
    return C.anchored_notes(first, X.notes(spark, sf_dir), "stay_id", S.TIME_BINS).select("stay_id", "time_bin", "note_id")


@R.add("""
f AS (SELECT stay_id, min(event_time) AS event_time FROM evi GROUP BY 1),
x AS (SELECT me.stay_id, feature FROM me JOIN f USING (stay_id) WHERE charttime < event_time)
SELECT stay_id, count(*) AS n FROM x WHERE stay_id IN (SELECT stay_id FROM x WHERE feature IN ('hr', 'sbp', 'rr') GROUP BY 1 HAVING count(DISTINCT feature) = 3) GROUP BY 1
""")
def complete_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays with every member of the set."""
    from clinflow.operators.text import complete_sets

    first = X.evidence(spark, sf_dir).groupBy("stay_id").agg(F.min("event_time").alias("event_time"))
    before = X.measures(spark, sf_dir).join(first, "stay_id").where("charttime < event_time").select("stay_id", "feature")
    return complete_sets(before, ["stay_id"], "feature", ["hr", "sbp", "rr"]).groupBy("stay_id").agg(F.count("*").alias("n"))


@R.add("SELECT evi.stay_id, event_id FROM evi JOIN st ON st.subject_id = evi.subject_id WHERE event_time BETWEEN intime AND outtime")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7."""
    e = X.evidence(spark, sf_dir).drop("stay_id")
    return J.containment(e, X.stays(spark, sf_dir), "subject_id").select("stay_id", "event_id")


@R.add("""
l AS (SELECT CASE WHEN event_id % 3 <> 0 THEN stay_id END AS stay_id, subject_id AS admission_id, event_time, evidence FROM evi),
b AS (
  SELECT l.stay_id, event_time, evidence, intime, outtime FROM l JOIN st ON st.stay_id = l.stay_id
  UNION ALL SELECT st.stay_id, event_time, evidence, intime, outtime FROM l JOIN st ON st.subject_id = admission_id WHERE l.stay_id IS NULL)
SELECT DISTINCT stay_id, epoch_us(event_time) AS event_us, evidence FROM b WHERE event_time BETWEEN intime AND outtime
""")
def two_path_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, G11."""
    e = X.evidence(spark, sf_dir).select(F.when(F.col("event_id") % 3 != 0, F.col("stay_id")).alias("stay_id"), F.col("subject_id").alias("admission_id"), "event_time", "evidence")
    s = X.stays(spark, sf_dir).withColumnRenamed("subject_id", "admission_id")
    return J.two_path(e, s).select("stay_id", S.micros(F.col("event_time")).alias("event_us"), "evidence")


@R.add("SELECT me.stay_id, count(*) AS n, round(sum(value), 6) AS total FROM me JOIN st USING (stay_id) WHERE charttime BETWEEN greatest(landmark_time - INTERVAL 6 HOUR, intime + INTERVAL 20 HOUR) AND landmark_time GROUP BY 1")
def clipped_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9, C10."""
    s = X.stays(spark, sf_dir).select("stay_id", "landmark_time", "intime")
    got = J.lookback(X.measures(spark, sf_dir), s, "stay_id", "charttime", "landmark_time", 6, S.after(F.col("intime"), 20))
    return got.groupBy("stay_id").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


@R.add("SELECT st.stay_id, agent FROM inf JOIN st USING (stay_id) WHERE starttime <= landmark_time AND landmark_time < endtime AND (rate IS NULL OR rate > 0)")
def active_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11."""
    return J.active_at(X.infusions(spark, sf_dir), X.stays(spark, sf_dir).select("stay_id", "landmark_time"), "stay_id", "landmark_time").select("stay_id", "agent")


@R.add("""
SELECT a.event_id, epoch_us((SELECT min(b.event_time) FROM evi b WHERE b.subject_id = a.subject_id AND b.evidence = 'purchase' AND b.event_time > a.event_time)) AS next_us FROM evi a WHERE a.evidence = 'error'
""")
def next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of forward, strictly after; a key of any size is spread over ranges of time."""
    e = X.evidence(spark, sf_dir)
    left = e.where("evidence = 'error'").select("event_id", "subject_id", "event_time")
    got = O.next_after(left, e.where("evidence = 'purchase'").select("subject_id", F.col("event_time").alias("t2")), "subject_id", "event_time", "t2")
    return got.select("event_id", S.micros(F.col("next_time")).alias("next_us"))


@R.add("""
SELECT a.event_id, epoch_us(max(CASE WHEN b.event_time <= a.event_time THEN b.event_time END)) AS previous_us, epoch_us(min(CASE WHEN b.event_time >= a.event_time THEN b.event_time END)) AS following_us
FROM evi a LEFT JOIN evi b ON b.subject_id = a.subject_id AND b.evidence = 'purchase' WHERE a.evidence = 'error' GROUP BY 1
""")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: as C13 in both directions."""
    e = X.evidence(spark, sf_dir)
    left = e.where("evidence = 'error'").select("event_id", "subject_id", "event_time")
    got = O.nearest(left, e.where("evidence = 'purchase'").select("subject_id", F.col("event_time").alias("t2")), "subject_id", "event_time", "t2")
    return got.select("event_id", S.micros(F.col("previous_time")).alias("previous_us"), S.micros(F.col("following_time")).alias("following_us"))


@R.add("""
a AS (SELECT stay_id, event_time FROM evi WHERE evidence = 'error'), b AS (SELECT stay_id, event_time AS u FROM evi WHERE evidence = 'purchase'),
s AS (SELECT stay_id, h AS shift_hours, event_time + to_hours(h) AS t FROM a, (SELECT unnest(generate_series(-6, 6)) AS h)),
d AS (SELECT shift_hours, (SELECT min(abs(date_diff('microsecond', u, t))) FROM b WHERE b.stay_id = s.stay_id) / 3.6e9 AS d FROM s)
SELECT shift_hours::INT AS shift_hours, count(*) FILTER (d <= 1) AS n_close, round(median(d), 6) AS median_distance FROM d GROUP BY 1
""")
def clock_shift_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15."""
    e = X.evidence(spark, sf_dir)
    got = C.clock_shifts(e.where("evidence = 'error'"), e.where("evidence = 'purchase'").select("stay_id", F.col("event_time").alias("u")), "stay_id", "event_time", "u", list(range(-6, 7)))
    return got.select("shift_hours", "n_close", r6(F.col("median_distance"), "median_distance"))


@R.add("""
p AS (
  SELECT me.stay_id, feature, charttime, avg(value) AS v FROM me JOIN st USING (stay_id)
  WHERE charttime BETWEEN landmark_time - INTERVAL 24 HOUR AND landmark_time
    AND CASE feature WHEN 'hr' THEN value > 0 AND value < 300 WHEN 'sbp' THEN value > 0 AND value < 400 WHEN 'rr' THEN value > 0 AND value < 70 END GROUP BY 1, 2, 3),
q AS (SELECT stay_id, feature, arg_max(v, charttime) AS l, CASE WHEN count(*) >= 2 THEN arg_max(v, charttime) - arg_min(v, charttime) END AS d FROM p GROUP BY 1, 2)
SELECT st.stay_id, round(max(CASE WHEN feature = 'hr' THEN l END), 6) AS hr_last, round(max(CASE WHEN feature = 'hr' THEN d END), 6) AS hr_delta,
  round(max(CASE WHEN feature = 'sbp' THEN l END), 6) AS sbp_last, round(max(CASE WHEN feature = 'sbp' THEN d END), 6) AS sbp_delta,
  round(max(CASE WHEN feature = 'rr' THEN l END), 6) AS rr_last, round(max(CASE WHEN feature = 'rr' THEN d END), 6) AS rr_delta
FROM st LEFT JOIN q ON q.stay_id = st.stay_id GROUP BY 1
""")
def vitals_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, B16, D7, D8, D9."""
    got = H.block(X.measures(spark, sf_dir), X.stays(spark, sf_dir), ["hr", "sbp", "rr"], 24, delta=True)
    return got.select("stay_id", *[r6(F.col(c), c) for c in got.columns if c != "stay_id"])


@R.add("""
p AS (
  SELECT me.stay_id, charttime, avg(value) AS v FROM me JOIN st USING (stay_id)
  WHERE charttime BETWEEN landmark_time - INTERVAL 24 HOUR AND landmark_time AND feature = 'lactate' AND value > 0 AND value < 50 GROUP BY 1, 2)
SELECT st.stay_id, round(arg_max(v, charttime), 6) AS lactate_last FROM st LEFT JOIN p ON p.stay_id = st.stay_id GROUP BY 1
""")
def labs_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H3."""
    got = H.block(X.measures(spark, sf_dir), X.stays(spark, sf_dir), ["lactate"], 24)
    return got.select("stay_id", r6(F.col("lactate_last"), "lactate_last"))


@R.add("""
v AS (SELECT stay_id, charttime, CASE WHEN itemid % 10 = 0 THEN -value ELSE value END AS volume FROM me)
SELECT st.stay_id, round(sum(volume), 6) AS net_volume FROM st LEFT JOIN v ON v.stay_id = st.stay_id AND volume < 200 AND charttime BETWEEN landmark_time - INTERVAL 6 HOUR AND landmark_time GROUP BY 1
""")
def net_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4, B20."""
    v = X.measures(spark, sf_dir).withColumn("volume", S.signed_volume(F.col("itemid"), F.col("value"), list(range(0, 1000, 10)), 200)).where("volume is not null")
    got = H.signed_sum(v, X.stays(spark, sf_dir), 6, "net_volume")
    return got.select("stay_id", r6(F.col("net_volume"), "net_volume"))


@R.add("SELECT stay_id, least(greatest(age, 0), 90) AS age_capped FROM st WHERE coalesce(age >= 18 AND upper(trim(unit)) <> 'NICU', false)")
def eligible_adults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B14, B15, H5."""
    s = X.stays(spark, sf_dir).where(S.eligible(F.col("age"), F.col("unit")))
    return H.demographics(s)


@R.add("""
w AS (SELECT nt.*, landmark_time FROM nt JOIN st USING (stay_id) WHERE chart_time BETWEEN landmark_time - INTERVAL 12 HOUR AND landmark_time),
g AS (SELECT stay_id, count(*) AS n_notes, count(DISTINCT category) AS n_categories, sum(length(text))::BIGINT AS total_chars, arg_max(length(text), (chart_time, note_id)) AS latest_chars, avg(length(text)) AS mean_chars, max(chart_time) AS t FROM w GROUP BY 1)
SELECT st.stay_id, coalesce(n_notes, 0) AS n_notes, coalesce(n_categories, 0) AS n_categories, coalesce(total_chars, 0) AS total_chars, latest_chars::INT AS latest_chars, round(mean_chars, 6) AS mean_chars, round(date_diff('microsecond', t, landmark_time) / 3.6e9, 6) AS hours_since_latest
FROM st LEFT JOIN g ON g.stay_id = st.stay_id
""")
def note_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, E7, F10."""
    got = H.note_behaviour(X.notes(spark, sf_dir), X.stays(spark, sf_dir), 12)
    return got.select("stay_id", "n_notes", "n_categories", "total_chars", F.col("latest_chars").cast("int").alias("latest_chars"), r6(F.col("mean_chars"), "mean_chars"), r6(F.col("hours_since_latest"), "hours_since_latest"))


@R.add("""
w AS (SELECT me.*, CASE WHEN value > 0 AND value <= 1 THEN value * 100 WHEN value >= 20 AND value <= 100 THEN value END AS pct FROM me JOIN st USING (stay_id) WHERE charttime BETWEEN landmark_time - INTERVAL 24 HOUR AND landmark_time),
g AS (SELECT stay_id, arg_max(pct, charttime) FILTER (pct IS NOT NULL) AS l, max(CASE WHEN itemid < 30 THEN 1 ELSE 0 END) AS a, max(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS b FROM w GROUP BY 1)
SELECT st.stay_id, round(l, 6) AS percent_last, coalesce(a, 0) AS low_item, coalesce(b, 0) AS high_value FROM st LEFT JOIN g ON g.stay_id = st.stay_id
""")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last non-null value and flags."""
    got = H.latest_and_flags(X.measures(spark, sf_dir), X.stays(spark, sf_dir), {"percent_last": S.percent_of_fraction(F.col("value"))}, {"low_item": F.col("itemid") < 30, "high_value": F.col("value") > 100}, 24)
    return got.select("stay_id", r6(F.col("percent_last"), "percent_last"), "low_item", "high_value")


@R.add("""
a AS (SELECT st.stay_id, count(DISTINCT agent) AS n FROM inf JOIN st USING (stay_id) WHERE starttime <= landmark_time AND landmark_time < endtime AND (rate IS NULL OR rate > 0) GROUP BY 1),
b AS (SELECT st.stay_id, count(DISTINCT agent) AS n FROM inf JOIN st USING (stay_id) WHERE starttime BETWEEN landmark_time - INTERVAL 6 HOUR AND landmark_time GROUP BY 1)
SELECT st.stay_id, CASE WHEN coalesce(a.n, 0) > 0 THEN 1 ELSE 0 END AS active_any, coalesce(a.n, 0) AS active_agents, CASE WHEN coalesce(b.n, 0) > 0 THEN 1 ELSE 0 END AS recent_any, coalesce(b.n, 0) AS recent_agents
FROM st LEFT JOIN a ON a.stay_id = st.stay_id LEFT JOIN b ON b.stay_id = st.stay_id
""")
def infusion_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8, D17."""
    return H.infusions(X.infusions(spark, sf_dir), X.stays(spark, sf_dir), 6)


@R.add(_risk("all") + """,
e AS (SELECT stay_id, age FROM rs), v AS (SELECT stay_id, count(*) AS n FROM nt GROUP BY 1)
SELECT dbsource, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, count(*) FILTER (label = 1) AS n_cases, count(*) FILTER (label = 0) AS n_controls, round(avg(label), 6) AS prevalence,
  round(avg(CASE WHEN label = 1 THEN CASE WHEN n IS NULL THEN 0 ELSE 1 END END), 6) AS covered_cases, round(avg(CASE WHEN label = 0 THEN CASE WHEN n IS NULL THEN 0 ELSE 1 END END), 6) AS covered_controls
FROM rs LEFT JOIN v ON v.stay_id = rs.stay_id GROUP BY 1
""")
def population_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D28."""
    rs = C.risk_set(X.stays(spark, sf_dir), X.evidence(spark, sf_dir), ENDPOINT)
    noted = X.notes(spark, sf_dir).select("stay_id").distinct().withColumn("noted", F.lit(True))
    rows = rs.join(noted, "stay_id", "left").withColumn("has_note", F.coalesce("noted", F.lit(False)))
    got = A.population(rows, ["dbsource"], "label", "subject_id", "has_note")
    return got.select("dbsource", "n_rows", "n_subjects", "n_cases", "n_controls", *[r6(F.col(c), c) for c in ("prevalence", "covered_cases", "covered_controls")])


@R.add("""
f AS (SELECT DISTINCT stay_id, event_time FROM evi WHERE evidence = 'purchase'),
h AS (SELECT f.stay_id, f.event_time, date_diff('microsecond', chart_time, event_time) / 3.6e9 AS h FROM f JOIN nt USING (stay_id) WHERE chart_time < event_time),
w AS (SELECT unnest([6, 12, 24, 48]) AS window_hours),
p AS (SELECT window_hours, f.stay_id, f.event_time, count(h.h) AS k, min(h.h) AS c FROM f CROSS JOIN w LEFT JOIN h ON h.stay_id = f.stay_id AND h.event_time = f.event_time AND h.h <= window_hours GROUP BY 1, 2, 3)
SELECT window_hours::INT AS window_hours, count(*) AS n_events, count(*) FILTER (k >= 1) AS n_covered, round(100 * avg(CASE WHEN k >= 1 THEN 1.0 ELSE 0.0 END), 6) AS percent_covered, count(*) FILTER (k >= 2) AS n_two, round(median(c), 6) AS median_closest_hours FROM p GROUP BY 1
""")
def note_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D21, D1, D12."""
    got = A.coverage(X.evidence(spark, sf_dir).where("evidence = 'purchase'"), X.notes(spark, sf_dir), "stay_id", "event_time", "chart_time", S.WINDOWS)
    return got.select("window_hours", "n_events", "n_covered", r6(F.col("percent_covered"), "percent_covered"), "n_two", r6(F.col("median_closest_hours"), "median_closest_hours"))


@R.add("""
w AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY chart_time DESC) AS rn FROM nt)
SELECT stay_id, round(date_diff('microsecond', max(CASE WHEN rn = 2 THEN chart_time END), max(CASE WHEN rn = 1 THEN chart_time END)) / 3.6e9, 6) AS gap_hours FROM w WHERE rn <= 2 GROUP BY 1
""")
def latest_note_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5."""
    return E.latest_gap(X.notes(spark, sf_dir), ["stay_id"], "chart_time").select("stay_id", r6(F.col("gap_hours"), "gap_hours"))


@R.add("SELECT stay_id, epoch_us(lead(intime) OVER (PARTITION BY subject_id ORDER BY intime, stay_id)) AS next_us FROM st")
def next_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4."""
    return E.following(X.stays(spark, sf_dir), ["subject_id"], "intime", "stay_id", "next_time").select("stay_id", S.micros(F.col("next_time")).alias("next_us"))


@R.add("SELECT subject_id, CASE WHEN count(DISTINCT dbsource) = 1 THEN min(dbsource) ELSE 'mixed' END AS dbsource FROM st GROUP BY 1")
def mixed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15."""
    return X.stays(spark, sf_dir).groupBy("subject_id").agg(A.one_or_mixed("dbsource").alias("dbsource"))


@R.add("""
b AS (SELECT stay_id, max(chart_time) AS a FROM nt GROUP BY 1), c AS (SELECT stay_id, max(chart_time) AS b FROM nt WHERE NOT regexp_matches(text, '(?i)token|secret') GROUP BY 1)
SELECT count(*) AS n_before, count(*) FILTER (c.b IS NULL) AS n_lost, count(*) FILTER (c.b < b.a) AS n_older FROM b LEFT JOIN c USING (stay_id)
""")
def language_filter_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17, F2."""
    from clinflow.operators.text import mentions

    n = X.notes(spark, sf_dir)
    return C.filter_effect(n, n.where(~mentions(F.col("text"), ["token", "secret"])), "stay_id", "chart_time")


@R.add("""
SELECT itemid, n_rows, n_numeric, n_entities FROM (SELECT unnest(generate_series(0, 120)) AS itemid)
LEFT JOIN (SELECT itemid, count(*) AS n_rows, count(value) AS n_numeric, count(DISTINCT stay_id) AS n_entities FROM me GROUP BY 1) USING (itemid) WHERE n_rows IS NOT NULL
UNION ALL SELECT i, 0, 0, 0 FROM (SELECT unnest(generate_series(0, 120)) AS i) WHERE i NOT IN (SELECT itemid FROM me)
""")
def dictionary_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D35."""
    d = spark.range(121).select(F.col("id").alias("itemid"))
    return A.dictionary_usage(X.measures(spark, sf_dir), d, "itemid", "value", "stay_id")


@R.add("SELECT feature, count(value) AS n, round(min(value), 6) AS min, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM me GROUP BY 1")
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11, D29."""
    got = A.quantile_summary(X.measures(spark, sf_dir), ["feature"], "value")
    return got.select("feature", "n", *[r6(F.col(c), c) for c in got.columns[2:]])


@R.add("""
f AS (SELECT stay_id, feature, avg(value) AS v FROM me GROUP BY 1, 2),
w AS (SELECT stay_id, max(CASE WHEN feature = 'hr' THEN v END) AS a, max(CASE WHEN feature = 'sbp' THEN v END) AS b, max(CASE WHEN feature = 'rr' THEN v END) AS c FROM f GROUP BY 1)
SELECT count(*) AS n, round(avg(a), 6) AS mean_0, round(avg(b), 6) AS mean_1, round(avg(c), 6) AS mean_2, round(100 * avg(CASE WHEN c > a THEN 1.0 ELSE 0.0 END), 6) AS percent_increased, round(100 * avg(CASE WHEN b >= a AND c >= b THEN 1.0 ELSE 0.0 END), 6) AS percent_monotone
FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
""")
def trajectory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D22, D32."""
    got = A.trajectory(X.measures(spark, sf_dir), "stay_id", "feature", "value", ["hr", "sbp", "rr"])
    return got.select("n", *[r6(F.col(c), c) for c in got.columns[1:]])


@R.add()
def risk_set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy 1:3 matching per source and unit, in rounds. Tested against a brute-force version."""
    rs = C.risk_set(X.stays(spark, sf_dir), X.evidence(spark, sf_dir), ENDPOINT)
    rows = rs.select(F.col("stay_id").alias("id"), "subject_id", F.concat_ws(":", "dbsource", "unit").alias("block"), S.hours(F.col("outtime"), F.col("intime")).alias("clock"), "label")
    return C.match(rows.where("label = 1").drop("label"), rows.where("label = 0").drop("label"), "block", "clock", k=3)


@R.add()
def component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets that share a subject stay in one part; tested for both."""
    from clinflow.operators.cohort import allocate, set_components

    sets = X.infusions(spark, sf_dir).join(X.stays(spark, sf_dir).select("stay_id", "subject_id"), "stay_id").select(F.concat_ws(":", "agent", F.col("stay_id") % 97).alias("match_set"), "subject_id")
    labels = set_components(sets)
    return labels.join(allocate(labels.groupBy("component").agg(F.count("*").alias("n")), "component", "n"), "component").select("match_set", "component", "part")


QUERIES, ORACLE_SQL = R.queries, R.sql
