"""Files of any store that Spark reads: listing by Hadoop's file system, one task for each file or archive member.

`tree` lists on the driver by way of Hadoop, so every store Spark knows can be listed. Executors open files through
pyarrow's file systems (local, HDFS, S3, GCS, Azure), as Python workers have no JVM; a path of another kind is an
error that names it. Files, compressed files and members of archives are streamed: a task holds one block and one batch of rows.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clinflow.sources.files import ENCODINGS

TABLES = (".csv", ".csv.gz")
#: Bytes of a read, and rows of a batch.
BLOCK, ROWS = 1 << 20, 5_000


def tree(spark: SparkSession, top: str, endings: tuple[str, ...] = TABLES) -> list[tuple[str, int]]:
    """(path, bytes) of every file below a folder with one of the endings, sorted; an error where there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(top)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        raise NotADirectoryError(top)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if name.lower().endswith(endings) and not name.startswith((".", "_")):
            found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


def find(spark: SparkSession, top: str, names: list[str]) -> str | None:
    """The file with one of the names, whatever its case; the shortest path of several; else one whose name contains one."""
    found, low = [p for p, _ in tree(spark, top)], [n.lower() for n in names]
    name = lambda p: p.rsplit("/", 1)[-1].lower()
    exact = [p for p in found if name(p) in low]
    part = [p for p in found if any(n.split(".")[0] in name(p) for n in low)]
    return min(exact or part, key=lambda p: (len(p), p), default=None)


def find_one(spark: SparkSession, top: str, name: str) -> str:
    """The only file of that name."""
    hits = [p for p, _ in tree(spark, top) if p.rsplit("/", 1)[-1].lower() == name.lower()]
    if len(hits) != 1:
        raise FileNotFoundError(f"{len(hits)} files named {name} in {top}")
    return hits[0]


def smallest_with(spark: SparkSession, top: str, column: str) -> str | None:
    """The smallest table that has the column."""
    from clinflow.sources.files import header

    return next((p for p, _ in sorted(tree(spark, top), key=lambda x: (x[1], x[0])) if column.lower() in [c.lower() for c in header(spark, p)]), None)


def inventory(spark: SparkSession, top: str) -> DataFrame:
    """path (below top), bytes, n_columns, columns of every table below a folder; a task for each group of files reads their first lines."""
    found = tree(spark, top)
    base = spark._jvm.org.apache.hadoop.fs.Path(top)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(base).getPath().toString().rstrip("/") + "/"
    rows = spark.createDataFrame([(p, p.removeprefix(base), n) for p, n in found], "at string, path string, bytes long").repartition(max(1, min(len(found), 64)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [next(lines(p, ENCODINGS), []) for p in b.column("at").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("bytes"), pa.array([len(h) for h in heads], pa.int32()), pa.array([",".join(h) for h in heads], pa.string())], ["path", "bytes", "n_columns", "columns"])

    return rows.mapInArrow(look, "path string, bytes long, n_columns int, columns string")


def _open(path: str):
    """(file system, path in it) for pyarrow."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):  # as it stands: a # or % in a name is no part of a URI
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, ValueError) as e:
        raise OSError(f"executors cannot open {path}: {e}") from e


def _raw(path: str, member: str | None) -> Iterator[io.BufferedIOBase]:
    """The bytes of a file (unzipped if its name ends in .gz) or of an archive's member, as a stream to be closed by the caller's loop."""
    store, at = _open(path)
    if member is None:
        with store.open_input_stream(at, compression="gzip" if at.lower().endswith(".gz") else None, buffer_size=BLOCK) as f:
            yield f
        return
    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z, z.open(member) as inner:
        if member.lower().endswith(".gz"):
            import gzip

            with gzip.open(inner) as g:
                yield g
        else:
            yield inner


def _text(path: str, member: str | None, encoding: str) -> Iterator[str]:
    for f in _raw(path, member):
        decoder = codecs.getincrementaldecoder(encoding)()
        while part := f.read(BLOCK):
            yield decoder.decode(part)
        yield decoder.decode(b"", final=True)


def _split(parts: Iterator[str]) -> Iterator[str]:
    """Lines with their ends, of which csv makes records."""
    held = ""
    for part in parts:
        held += part
        whole = held.splitlines(keepends=True)
        held = whole.pop() if whole and not held.endswith("\n") else ""
        yield from whole
    if held:
        yield held


def lines(path: str, encodings: list[str], member: str | None = None) -> Iterator[list[str]]:
    """Records of a CSV, decoded by the first encoding that reads it as far as rows are out.

    A byte that an encoding cannot read makes the next one start anew, but only while no more than the first batch of rows is read; later it is an error,
    as rows of the wrong encoding would be out already.
    """
    for i, name in enumerate(encodings):
        records, out = csv.reader(_split(_text(path, member, name))), []
        try:
            for r in records:
                out.append(r)
                if len(out) > ROWS:
                    break
        except UnicodeDecodeError:
            if i + 1 < len(encodings):
                continue
            raise UnicodeError(f"{path}: none of {encodings} reads it") from None
        yield from out
        try:
            yield from records
        except UnicodeDecodeError as e:
            raise UnicodeError(f"{path}: {name} fails after rows are out: {e}") from None
        return


def members(path: str, endings: tuple[str, ...] = TABLES) -> list[str]:
    """Tables of an archive. A name that leads out of the folder it is unpacked in is an error."""
    store, at = _open(path)
    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        names = [n for n in z.namelist() if n.lower().endswith(endings)]
    for n in names:
        if PurePosixPath(n).is_absolute() or "\\" in n or ".." in PurePosixPath(n).parts:
            raise ValueError(f"{n} leads out of the folder")
    return sorted(names)


class _Part(InputPartition):
    def __init__(self, path: str, member: str | None):
        self.path, self.member = path, member


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.paths, self.encodings, self.columns = json.loads(options["paths"]), json.loads(options["encodings"]), columns

    def partitions(self) -> list[_Part]:
        return [_Part(p, m) for p in self.paths for m in (members(p) if p.lower().endswith(".zip") else [None])]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        records = lines(part.path, self.encodings, part.member)
        head = [c.strip().lstrip("﻿").lower() for c in next(records, [])]
        at = [head.index(c) if c in head else -1 for c in self.columns]
        where = part.path.rsplit("/", 1)[-1] + (f"!{part.member}" if part.member else "")
        held: list[list[str]] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[i] if 0 <= i < len(r) and r[i] != "" else None for r in held], pa.string()) for i in at]
            return pa.RecordBatch.from_arrays([*columns, pa.array([where] * len(held), pa.string())], [*self.columns, "_file"])

        for r in records:
            held.append(r)
            if len(held) == ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class CsvTree(DataSource):
    """CSV files, compressed files and archives of them, all columns text; see `scan`."""

    @classmethod
    def name(cls) -> str:
        return "csv_tree"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in [*json.loads(self.options["columns"]), "_file"])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, json.loads(self.options["columns"]))


def scan(spark: SparkSession, paths: list[str], columns: list[str], encodings: list[str] | None = None) -> DataFrame:
    """The columns (lower case; null where a file lacks one or a field is empty) of all rows, and `_file`, where a row is from. A task for each file and for each table in a .zip."""
    spark.dataSource.register(CsvTree)
    low = [c.lower() for c in columns]
    return spark.read.format("csv_tree").options(paths=json.dumps(paths), columns=json.dumps(low), encodings=json.dumps(encodings or ENCODINGS)).load()


def unzip(spark: SparkSession, archives: list[str], target: str) -> DataFrame:
    """path (below target), bytes of all tables of the archives: each is streamed into target/<archive's name> by a task of its own."""
    named = [(a, a.rsplit("/", 1)[-1].removesuffix(".zip"), m) for a in archives for m in members(a)]
    if len({n for _, n, _ in named}) < len({a for a, _, _ in named}):
        raise ValueError("archives of one name")
    rows = spark.createDataFrame(named, "archive string, folder string, member string").repartition(max(1, len(named)))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(target)
        for b in batches:
            for archive, folder, m in zip(*[c.to_pylist() for c in b.columns], strict=True):
                at, size = f"{base.rstrip('/')}/{folder}/{m}", 0
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                source, inside = _open(archive)
                with source.open_input_file(inside) as f, zipfile.ZipFile(f) as z, z.open(m) as inner, store.open_output_stream(at) as out:
                    while part := inner.read(BLOCK):
                        out.write(part)
                        size += len(part)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{m}"]), pa.array([size])], ["path", "bytes"])

    return rows.mapInArrow(unpack, "path string, bytes long")
