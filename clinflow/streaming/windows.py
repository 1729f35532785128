"""Structured Streaming forms of a few operators. These are additions: the batch operators are the complete set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is declared, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def feature_windows(events: DataFrame, time: str, key: str, value: str, length: str = "6 hours", slide: str = "1 hour", late: str = "12 hours") -> DataFrame:
    """key, window, n, mean, last: measurements of sliding windows. Rows later than `late` behind the newest are dropped, and state with them."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, length, slide).alias("window"), key)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max_by(value, time).alias("last"))
    )


def first_endpoint(events: DataFrame, stays: DataFrame, time: str, stay: str, tags: list[str], late: str = "12 hours") -> DataFrame:
    """Evidence after the landmark and up to the horizon of a static table of stays, once for each stay and tag within the watermark."""
    hits = events.withWatermark(time, late).where(F.col("evidence").isin(tags)).join(stays, stay)
    hits = hits.where((F.col(time) > F.col("landmark_time")) & (F.col(time) <= F.col("horizon_end")))
    return hits.dropDuplicatesWithinWatermark([stay, "evidence"]).select(stay, "evidence", time)


def write_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """An exactly-once file sink that stops when what is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
