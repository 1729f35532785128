"""Finding, reading and writing files."""

from __future__ import annotations

import codecs
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings tried in this order, and columns that no aggregate may show.
ENCODINGS = ["utf-8-sig", "utf-8", "gb18030"]
SENSITIVE = ["subject_id", "hadm_id", "stay_id", "icustay_id", "text", "note_text", "charttime", "storetime", "deathtime", "admittime", "dischtime", "note_id"]


def root(path: str) -> Path:
    """The folder, or an error where there is none."""
    if not (p := Path(path).expanduser()).is_dir():
        raise NotADirectoryError(path)
    return p


def tables(top: str) -> list[Path]:
    """Every .csv and .csv.gz below a folder, sorted."""
    return sorted(p for p in root(top).rglob("*") if p.name.lower().endswith((".csv", ".csv.gz")))


def find(top: str, names: list[str]) -> Path | None:
    """The file with one of the names, whatever its case; the shortest path of several; else one whose name contains one."""
    found, low = tables(top), [n.lower() for n in names]
    exact = [p for p in found if p.name.lower() in low]
    part = [p for p in found if any(n.split(".")[0] in p.name.lower() for n in low)]
    return min(exact or part, key=lambda p: (len(str(p)), str(p)), default=None)


def find_one(top: str, name: str) -> Path:
    """The only file of that name."""
    hits = [p for p in tables(top) if p.name.lower() == name.lower()]
    if len(hits) != 1:
        raise FileNotFoundError(f"{len(hits)} files named {name} in {top}")
    return hits[0]


def encoding(path: str, at_once: int = 1 << 20) -> str:
    """The first of ENCODINGS that reads the whole file, `at_once` bytes at a time."""
    for name in ENCODINGS:
        decoder = codecs.getincrementaldecoder(name)()
        try:
            with open(path, "rb") as f:
                while part := f.read(at_once):
                    decoder.decode(part)
            decoder.decode(b"", final=True)
            return name
        except UnicodeDecodeError:
            continue
    raise UnicodeError(f"{path}: none of {ENCODINGS} reads it")


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names; none where the file is missing, empty or no table. Other failures, as of a store, are raised."""
    try:
        return spark.read.option("header", True).csv(path).columns
    except AnalysisException:
        return []


def read_csv(spark: SparkSession, path: str, wanted: list[str], schema: dict[str, str] | None = None, charset: str = "UTF-8", required: list[str] | None = None) -> DataFrame:
    """The wanted columns, in lower case and cast by `schema`; those that the file lacks are null. An error where it has none of them or lacks a required one."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8" if charset.startswith("utf-8") else charset).csv(path)
    have = {c.lower().strip().lstrip("﻿"): c for c in raw.columns}
    low = [w.lower() for w in wanted]
    if not any(w in have for w in low):
        raise ValueError(f"{path} has none of {wanted}")
    if lacking := [c for c in required or [] if c.lower() not in have]:
        raise ValueError(f"{path} lacks {lacking}")
    kinds = schema or {}
    return raw.select(*[(F.col(f"`{have[w]}`") if w in have else F.lit(None)).try_cast(kinds.get(w, "string")).alias(w) for w in low])


def smallest_with(spark: SparkSession, top: str, column: str) -> Path | None:
    """The smallest table that has the column."""
    for p in sorted(tables(top), key=lambda p: (p.stat().st_size, str(p))):
        if column.lower() in [c.lower() for c in header(spark, str(p))]:
            return p
    return None


def inventory(spark: SparkSession, top: str) -> DataFrame:
    """path, bytes, n_columns, columns of every table below a folder."""
    rows = [(str(p.relative_to(top)), p.stat().st_size, len(h := header(spark, str(p))), ",".join(h)) for p in tables(top)]
    return spark.createDataFrame(rows, "path string, bytes long, n_columns int, columns string")


def unzip(archive: str, target: str) -> list[Path]:
    """Extract the tables of an archive; a name that leads out of the target is an error."""
    out, base = [], Path(target).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not name.lower().endswith((".csv", ".csv.gz")):
                continue
            at = (base / PurePosixPath(name)).resolve()
            if base not in at.parents:
                raise ValueError(f"{name} leads out of {target}")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(z.read(name))
            out.append(at)
    return sorted(out)


ANSWER = T.StructType([T.StructField("noul", T.DoubleType()), T.StructField("chunk_values", T.ArrayType(T.DoubleType()))])
ANSWERS = T.StructType(
    [T.StructField("case_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("response", T.StructType([T.StructField("answers", T.MapType(T.StringType(), ANSWER))]))]
)


def read_answers(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Model answers from JSON lines. Strict: a missing or repeated case_id or a status other than ok is an error; else such rows are left out."""
    rows = spark.read.schema(ANSWERS).json(path)
    if not strict:
        return rows.where("case_id is not null and status = 'ok'")
    n, ids, ok = rows.agg(F.count("*"), F.countDistinct("case_id"), F.count_if(F.col("status") == "ok")).first()
    if n != ids or n != ok:
        raise ValueError(f"{n} rows, {ids} case ids, {ok} with status ok")
    return rows


def synthetic_only(df: DataFrame, flag: str = "synthetic") -> DataFrame:
    """df, after a check that every row is marked synthetic."""
    if df.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).limit(1).count():
        raise ValueError("a row is not marked synthetic")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet, or CSV with a header for export. Spark's committer makes the folder whole or leaves it without _SUCCESS."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_aggregate(df: DataFrame, path: str, sensitive: list[str] | None = None) -> None:
    """Refuses a table that has a sensitive column."""
    if bad := [c for c in df.columns if c.lower() in (sensitive or SENSITIVE)]:
        raise ValueError(f"sensitive columns: {bad}")
    write_table(df, path, "csv")


def remaining(df: DataFrame, done: DataFrame, id_: str, status: str = "status") -> DataFrame:
    """Rows whose id is not yet written with status ok."""
    return df.join(done.where(F.col(status) == "ok").select(id_).distinct(), id_, "left_anti")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"lacking columns: {lacking}")
    return df


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
