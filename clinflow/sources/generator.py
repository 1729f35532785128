"""Related synthetic tables: admissions with charts, laboratory values, notes, infusions and procedures around one event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinflow.functions.scalars import unit_interval

COURSES = ("vasopressor", "intubation", "death", "stable")
STAY_HOURS, CHART_EVERY, LAB_EVERY = 72, 2, 6
#: Hours before the event at which values begin to change; shorter where notes and values disagree.
ONSET, LATE_ONSET = 10.0, 3.0
#: Name, item, middle, spread, and the change at the event for the first three courses.
CHARTS = [("hr", 11, 82.0, 9.0, 24.0, 14.0, 10.0), ("map", 12, 79.0, 8.0, -22.0, 0.0, -16.0), ("rr", 13, 17.0, 4.0, 0.0, 13.0, 7.0), ("spo2", 14, 96.5, 2.0, 0.0, -9.0, -5.0), ("temp", 15, 37.0, 0.6, 0.4, 0.2, 0.0)]
LABS = [("lactate", 51, 1.5, 0.5, 2.4, 0.3, 1.8), ("creatinine", 52, 1.0, 0.3, 0.5, 0.0, 0.6), ("wbc", 53, 9.0, 2.5, 1.5, 0.5, 0.0)]
INFUSION_ITEM, VENTILATION_ITEM = 31, 41
NOTE_HOURS = (10, 22, 34, 46, 58)
CALM, WORSE = "Resting, no new complaints. Plan unchanged.", "Looks worse than before, team informed. Will watch closely."


def _course(first: int) -> list[Column]:
    """Name, item, middle, spread and the course's change of a struct row."""
    change = F.lit(0.0)
    for k, name in enumerate(COURSES[:3]):
        change = F.when(F.col("course") == name, F.col(f"row.c{first + k}")).otherwise(change)
    return [F.col("row.c0").alias("feature"), F.col("row.c1").alias("itemid"), F.col("row.c2").alias("middle"), F.col("row.c3").alias("spread"), change.alias("change")]


def _series(subjects: DataFrame, rows: list[tuple], every: int, seed: int) -> DataFrame:
    """A value of each row at every so many hours of the stay; it moves by the course's change as the event comes near."""
    table = F.array(*[F.struct(*[F.lit(x).alias(f"c{i}") for i, x in enumerate(r)]) for r in rows])
    timed = subjects.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(STAY_HOURS - 1), F.lit(every)))).withColumn("row", F.explode(table))
    timed = timed.select("subject_id", "hadm_id", "icustay_id", "intime", "course", "hour", "event_hour", "onset", *_course(4))
    ahead = F.col("event_hour") - F.col("hour")
    severity = F.when(ahead >= 0, F.greatest(F.lit(0.0), (F.col("onset") - ahead) / F.col("onset"))).otherwise(0.0)
    value = F.col("middle") + F.col("spread") * (2 * unit_interval(F.lit(seed), F.col("subject_id"), F.col("hour"), F.col("feature")) - 1) + F.col("change") * severity
    return timed.select("subject_id", "hadm_id", "icustay_id", F.timestamp_add("HOUR", F.col("hour"), F.col("intime")).alias("charttime"), "feature", "itemid", (F.floor(value * 1000 + 0.5) / 1000).alias("value"))


def related_tables(subjects: DataFrame, seed: int = 1) -> dict[str, DataFrame]:
    """The related tables of one admission for each subject_id, and `truth` (course, event_hour, discordant).

    Subjects take the four courses in turn by a hash. Every draw is a hash of seed, subject and place, so tables are made by executors, each alone, in any partitioning,
    and the same key always has the same rows. Null subjects are left out, repeated ones are one; an empty table gives empty tables.
    """
    u = lambda what: unit_interval(F.lit(seed), F.col("subject_id"), F.lit(what))
    # subjects are few bytes and many rows: a fixed number of tasks, else Spark would put them together in one or two
    n = int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = subjects.where("subject_id is not null").select("subject_id").repartition(n, "subject_id").distinct()
    course = F.element_at(F.array(*[F.lit(c) for c in COURSES]), F.floor(u("course") * 4).cast("int") + 1)
    s = s.select("subject_id", (F.col("subject_id") * 10 + 1).alias("hadm_id"), (F.col("subject_id") * 10 + 2).alias("icustay_id"), course.alias("course"), (u("discordant") < 0.25).alias("discordant"), F.when(u("system") < 0.5, "metavision").otherwise("carevue").alias("dbsource"), F.timestamp_add("DAY", F.floor(u("day") * 3650).cast("int"), F.lit("2100-01-01 00:00:00").cast("timestamp")).alias("intime"), F.floor(u("event") * 36).cast("int").alias("_at"))
    s = s.withColumn("event_hour", F.when(F.col("course") != "stable", F.col("_at") + 24)).drop("_at").withColumn("onset", F.when(F.col("discordant"), LATE_ONSET).otherwise(ONSET))
    s = s.withColumn("event_time", F.timestamp_add("HOUR", F.col("event_hour"), F.col("intime"))).withColumn("outtime", F.timestamp_add("HOUR", F.lit(STAY_HOURS), F.col("intime")))
    keys = ["subject_id", "hadm_id", "icustay_id"]
    notes = s.withColumn("hour", F.explode(F.array(*[F.lit(h) for h in NOTE_HOURS])))
    near = F.coalesce((F.col("event_hour") - F.col("hour")).between(0, int(ONSET)), F.lit(False))
    drugs = s.where("course = 'vasopressor'").select(*keys, "dbsource", F.lit(INFUSION_ITEM).alias("itemid"), F.col("event_time").alias("starttime"), (F.floor(u("rate") * 1000 + 50) / 1000).alias("rate"))
    spark = subjects.sparkSession
    return {
        "admissions": s.select("subject_id", "hadm_id", F.timestamp_add("HOUR", F.lit(-6), F.col("intime")).alias("admittime"), F.timestamp_add("HOUR", F.lit(24), F.col("outtime")).alias("dischtime"), F.when(F.col("course") == "death", F.col("event_time")).alias("deathtime")),
        "icustays": s.select(*keys, "dbsource", "intime", "outtime"),
        "chartevents": _series(s, CHARTS, CHART_EVERY, seed),
        "labevents": _series(s, LABS, LAB_EVERY, seed).drop("icustay_id"),
        "noteevents": notes.select("subject_id", "hadm_id", F.timestamp_add("HOUR", F.col("hour"), F.col("intime")).alias("charttime"), F.lit("Nursing").alias("category"), F.when(near, WORSE).otherwise(CALM).alias("text")),
        "inputevents_mv": drugs.where("dbsource = 'metavision'").drop("dbsource").withColumn("endtime", F.timestamp_add("HOUR", F.lit(4), F.col("starttime"))),
        "inputevents_cv": drugs.where("dbsource = 'carevue'").drop("dbsource").withColumnRenamed("starttime", "charttime"),
        "procedureevents_mv": s.where("course = 'intubation' and dbsource = 'metavision'").select(*keys, F.lit(VENTILATION_ITEM).alias("itemid"), F.col("event_time").alias("starttime")),
        "d_items": spark.createDataFrame([*[(r[1], r[0]) for r in CHARTS], (INFUSION_ITEM, "norepinephrine"), (VENTILATION_ITEM, "invasive ventilation")], "itemid int, label string"),
        "d_labitems": spark.createDataFrame([(r[1], r[0]) for r in LABS], "itemid int, label string"),
        "truth": s.select(*keys, "course", "event_hour", "discordant"),
    }
