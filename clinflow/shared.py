"""Storage that driver and executors share, and joins that survive hot keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds at least this share of the weight is hot. There are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001
#: Hot rows of more bytes than this in all are not broadcast but repeated under SALTS salts.
BROADCAST_BYTES, SALTS = 32_000_000, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one is made in local mode only: on a cluster executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="clinflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _table(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder for a table that goes with the application, or before by `release`."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    fs, at = _table(spark, path)
    fs.deleteOnExit(at)
    _made.append(path)
    return path


_made: list[str] = []


def made() -> int:
    """Number of tables made so far, for `release`."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables made since a call of `made`, but for those to keep. To be called when nothing that reads them is still to run."""
    for path in _made[since:]:
        if path not in keep:
            fs, at = _table(spark, path)
            fs.delete(at, True)
    _made[since:] = [path for path in _made[since:] if path in keep]


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Queries that run inside send their Python workers at most so many rows at once, or fewer where the session says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if not 0 < int(was) <= most:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, share: float = HOT_SHARE, width: Column | None = None) -> DataFrame:
    """Left join of rows with table, which has one row per key and a column `weight` (its rows in `rows`).

    Keys with at least `share` of the total weight, at most 1 / share of them, are joined by
    broadcast, so that no task gets a hot key's rows; all other keys by an ordinary shuffled join.
    width: bytes of a row of table where it has columns of any length; if the hot rows have more than
    BROADCAST_BYTES together, they are joined by a salted shuffle instead.
    Rows without a partner keep nulls. `rows` and `table` are each read more than once: materialise them.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) >= F.lit(max(1.0, share * total)))
    cold = table.where(F.col(weight) < F.lit(max(1.0, share * total)))
    values = [c for c in table.columns if c not in keys]
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    left = [F.col(f"l.{c}") for c in rows.columns]
    if width is not None and (hot.agg(F.sum(width)).first()[0] or 0) > BROADCAST_BYTES:
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
        salted = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = rows.withColumn("__salt", salt).alias("l").join(salted.alias("r"), on & (F.col("l.__salt") == F.col("r.__salt")), "inner").select(*left, *[F.col(f"r.{c}") for c in values])
        near = near.unionByName(rows.alias("l").join(F.broadcast(hot.select(*keys).alias("r")), on, "left_anti").alias("l").join(cold.alias("r"), on, "left").select(*left, *[F.col(f"r.{c}") for c in values]))
        return near
    near = rows.alias("l").join(F.broadcast(hot.alias("r")), on, "inner").select(*left, *[F.col(f"r.{c}") for c in values])
    rest = rows.alias("l").join(F.broadcast(hot.select(*keys).alias("r")), on, "left_anti")
    far = rest.alias("l").join(cold.alias("r"), on, "left").select(*left, *[F.col(f"r.{c}") for c in values])
    return near.unionByName(far)
