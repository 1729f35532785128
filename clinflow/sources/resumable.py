"""A sink that goes on where it stopped: parts that become part of the table by one rename each.

A part is written as Parquet in a folder of its own and then named in a manifest, which is put in place by a
rename in Hadoop's file system. Readers see the manifests' parts alone, so a run that is killed at any moment leaves whole
parts and nothing else; the next run writes only rows whose id has no row with status ok yet.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_atomic(spark: SparkSession, path: str, text: str) -> None:
    """The text in a file that is whole at any moment: written beside it and renamed over it."""
    jvm = spark._jvm
    fs, at = _store(spark, path)
    _, beside = _store(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    option = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    over = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.java.lang.Enum.valueOf(option, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(at), over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, or none."""
    fs, at = _store(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


class Sink:
    """Rows of `id_` and `status` at a path."""

    def __init__(self, spark: SparkSession, path: str, id_: str, status: str = "status"):
        self.spark, self.path, self.id_, self.status = spark, path.rstrip("/"), id_, status

    def parts(self) -> list[str]:
        """Folders that the manifest names."""
        return json.loads(read_text(self.spark, f"{self.path}/manifest.json") or "[]")

    def read(self) -> DataFrame | None:
        """All rows of whole parts; none before the first."""
        parts = self.parts()
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts]) if parts else None

    def remaining(self, df: DataFrame) -> DataFrame:
        """Rows whose id has no row with status ok."""
        done = self.read()
        return df if done is None else df.join(done.where(F.col(self.status) == "ok").select(self.id_).distinct(), self.id_, "left_anti")

    def append(self, df: DataFrame, work, parts: int = 8) -> int:
        """Gives the remaining rows to `work` (a function of DataFrame that returns rows with id and status), part by part; the number of parts written.

        Parts are cut by a hash of the id, so an id is in one part and a part's rows do not depend on what is done already.
        """
        cut: Column = F.pmod(F.xxhash64(F.col(self.id_).cast("string")), F.lit(parts))
        written = 0
        for k in range(parts):
            left = self.remaining(df.where(cut == k))
            if not left.limit(1).count():
                continue
            name = f"part-{k:05d}-{uuid.uuid4().hex}"
            work(left).write.parquet(f"{self.path}/{name}")
            write_atomic(self.spark, f"{self.path}/manifest.json", json.dumps([*self.parts(), name]))
            written += 1
        return written
