"""Clinical-shaped views of the driver's tables, and the same views as SQL.

A stay is a user's week of events; evidence, measurements, notes and infusions are its events by type.
Scores are two deterministic numbers of each order, with many ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.functions.scalars import after, micros

WEEK = 604_800_000_000
LANDMARK, HORIZON = 24, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, subject_id, stay_id, event_time, event_type, value, k."""
    e = table(spark, sf_dir, "events")
    week = F.floor(micros(F.col("ts")) / WEEK).cast("long")
    return e.select("event_id", F.col("user_id").alias("subject_id"), (F.col("user_id") * 10000 + week).alias("stay_id"), F.col("ts").alias("event_time"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy("stay_id", "subject_id").agg(F.min("event_time").alias("intime"), F.max("event_time").alias("outtime"))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("MICU", "SICU", "CCU", "NICU", "TSICU")]), (F.pmod("stay_id", F.lit(5)) + 1).cast("int"))
    s = s.select("*", F.when(F.col("stay_id") % 2 == 0, "metavision").otherwise("carevue").alias("dbsource"), unit.alias("unit"), (15 + F.pmod(F.col("subject_id") * 7, F.lit(80))).cast("double").alias("age"))
    return s.withColumn("landmark_time", after(F.col("intime"), LANDMARK)).withColumn("horizon_end", after(F.col("intime"), LANDMARK + HORIZON))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id, event_id, event_time, evidence."""
    return events(spark, sf_dir).where("event_type in ('error', 'purchase')").select("stay_id", "subject_id", "event_id", "event_time", F.col("event_type").alias("evidence"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id, charttime, feature, value: views and clicks."""
    names = F.element_at(F.array(*[F.lit(n) for n in ("hr", "sbp", "rr", "lactate")]), (F.pmod("k", F.lit(4)) + 1).cast("int"))
    return events(spark, sf_dir).where("event_type in ('view', 'click')").select("stay_id", F.col("event_time").alias("charttime"), names.alias("feature"), "value", F.col("k").alias("itemid"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id, note_id, chart_time, store_time (null for one in three), category, text: sign-ups, each with the document whose number is its own modulo the number of documents."""
    cats = F.element_at(F.array(*[F.lit(n) for n in ("Nursing", "Physician ", "Respiratory", "General", "nursing/other")]), (F.pmod("k", F.lit(5)) + 1).cast("int"))
    n = events(spark, sf_dir).where("event_type = 'signup'").select("stay_id", F.col("event_id").alias("note_id"), F.col("event_time").alias("chart_time"), F.when(F.col("k") % 3 != 0, F.timestamp_add("HOUR", F.col("k") % 7, F.col("event_time"))).alias("store_time"), cats.alias("category"), F.pmod("event_id", F.lit(table(spark, sf_dir, "documents").count())).alias("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return n.join(d, "doc_id").drop("doc_id")


def infusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id, agent, starttime, endtime (the stay's next click of the agent), rate (0 for one in five, null for one in seven)."""
    from pyspark.sql import Window

    c = events(spark, sf_dir).where("event_type = 'click'").withColumn("agent", F.concat(F.lit("agent"), F.col("k") % 3))
    end = F.lead("event_time").over(Window.partitionBy("stay_id", "agent").orderBy("event_time", "event_id"))
    return c.select("stay_id", "agent", F.col("event_time").alias("starttime"), end.alias("endtime"), F.when(F.col("k") % 7 != 0, F.when(F.col("k") % 5 == 0, 0.0).otherwise(F.col("value"))).alias("rate"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, subject_id, y, p_base, p_aug, fold, source."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("subject_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
        ((F.pmod(cents, F.lit(97)) + 1) / 100.0).alias("p_base"), ((F.pmod(cents * 7 + F.col("o_orderkey"), F.lit(89)) + F.when(F.col("o_orderstatus") == "F", 6).otherwise(1)) / 100.0).alias("p_aug"),
        (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int").alias("fold"), F.col("o_orderpriority").alias("source"),
    )


SQL = f"""
ev AS (
  SELECT event_id, user_id AS subject_id, user_id * 10000 + CAST(epoch_us(ts) // {WEEK} AS BIGINT) AS stay_id, ts AS event_time, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
st0 AS (SELECT stay_id, subject_id, min(event_time) AS intime, max(event_time) AS outtime FROM ev GROUP BY 1, 2),
st AS (
  SELECT *, CASE WHEN stay_id % 2 = 0 THEN 'metavision' ELSE 'carevue' END AS dbsource,
         (['MICU', 'SICU', 'CCU', 'NICU', 'TSICU'])[CAST(stay_id % 5 + 1 AS INT)] AS unit, CAST(15 + (subject_id * 7) % 80 AS DOUBLE) AS age,
         intime + INTERVAL {LANDMARK} HOUR AS landmark_time, intime + INTERVAL {LANDMARK + HORIZON} HOUR AS horizon_end
  FROM st0
),
evi AS (SELECT stay_id, subject_id, event_id, event_time, event_type AS evidence FROM ev WHERE event_type IN ('error', 'purchase')),
me AS (
  SELECT stay_id, event_time AS charttime, (['hr', 'sbp', 'rr', 'lactate'])[CAST(k % 4 + 1 AS INT)] AS feature, value, k AS itemid
  FROM ev WHERE event_type IN ('view', 'click')
),
nt AS (
  SELECT stay_id, event_id AS note_id, event_time AS chart_time, CASE WHEN k % 3 <> 0 THEN event_time + to_hours(k % 7) END AS store_time,
         (['Nursing', 'Physician ', 'Respiratory', 'General', 'nursing/other'])[CAST(k % 5 + 1 AS INT)] AS category, d.text
  FROM ev JOIN documents d ON d.doc_id = event_id % (SELECT count(*) FROM documents) WHERE event_type = 'signup'
),
inf AS (
  SELECT stay_id, 'agent' || (k % 3) AS agent, event_time AS starttime,
         lead(event_time) OVER (PARTITION BY stay_id, k % 3 ORDER BY event_time, event_id) AS endtime,
         CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 5 = 0 THEN 0.0 ELSE value END END AS rate
  FROM ev WHERE event_type = 'click'
),
sc AS (
  SELECT o_orderkey AS case_id, o_custkey AS subject_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
         (CAST(round(o_totalprice * 100) AS BIGINT) % 97 + 1) / 100.0::DOUBLE AS p_base,
         ((CAST(round(o_totalprice * 100) AS BIGINT) * 7 + o_orderkey) % 89 + CASE WHEN o_orderstatus = 'F' THEN 6 ELSE 1 END) / 100.0::DOUBLE AS p_aug,
         CAST(o_orderkey % 5 + 1 AS INT) AS fold, o_orderpriority AS source
  FROM orders
)
"""
