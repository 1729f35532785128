"""Preconditions of a job, atomic results, exports and template text."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require_registration(path: str, wanted: dict[str, object]) -> dict:
    """The JSON record, after a check that it is approved and that every wanted entry has its value."""
    record = json.loads(Path(path).read_text())
    if record.get("approved") is not True:
        raise PermissionError(f"{path} is not approved")
    if bad := [k for k, v in wanted.items() if record.get(k) != v]:
        raise PermissionError(f"{path} differs in {bad}")
    return record


def require_hash(path: str, sha256: str) -> None:
    """An error unless the file has the frozen hash."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    if digest.hexdigest() != sha256:
        raise ValueError(f"{path} has another hash than the frozen one")


def write_checkpoint(state: dict, path: str) -> None:
    """Whole or not at all: written beside the target and renamed."""
    beside = f"{path}.tmp"
    with open(beside, "w") as f:
        json.dump(state, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def export(folder: str, archive: str, allowed: tuple[str, ...] = (".csv", ".json", ".md", ".txt")) -> list[str]:
    """Zip of the folder's files with an allowed ending; the names that went in."""
    top = Path(folder)
    names = sorted(str(p.relative_to(top)) for p in top.rglob("*") if p.is_file() and p.suffix in allowed)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(top / n, n)
    return names


def template_corpus(spark: SparkSession, n: int, clauses: dict[str, list[str]], fillers: list[str], seed: int = 1) -> DataFrame:
    """case_id, label, text: n texts of a filler, a clause of a label chosen by hash (or none, label null), and a filler. Made in the executors."""

    def pick(options: list[str], *salt: str | int) -> Column:
        arr = F.array(*[F.lit(o) for o in options])
        return F.element_at(arr, (F.pmod(F.xxhash64(F.lit(seed), "id", *[F.lit(s) for s in salt]), F.lit(len(options))) + 1).cast("int"))

    names = [*clauses, "none"]
    label = pick(names, "label")
    clause = F.lit("")
    for name, own in clauses.items():
        clause = F.when(F.col("label") == name, pick(own, name)).otherwise(clause)
    rows = spark.range(n).withColumn("label", label).withColumn("text", F.trim(F.regexp_replace(F.concat_ws(" ", pick(fillers, 1), clause, pick(fillers, 2)), r"\s+", " ")))
    return rows.select(F.concat(F.lit("case_"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("case_id"), F.when(F.col("label") != "none", F.col("label")).alias("label"), "text")
