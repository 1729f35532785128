"""Sources of any store and the resumable sink."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from clinflow.sources import store
from clinflow.sources.resumable import Sink, read_text, write_atomic


@pytest.fixture
def top(tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "One.csv").write_bytes("﻿ID,Name\n1,größer\n2,\"two\nlines, here\"\n3,\n".encode("utf-8"))
    with gzip.open(tmp_path / "a" / "deep" / "two.csv.gz", "wb") as f:
        f.write("id,name,more\n4,床位\n5,x,y\n".encode("gb18030"))
    with zipfile.ZipFile(tmp_path / "three.zip", "w") as z:
        z.writestr("in/three.csv", "name,id\n" + "".join(f"n{i},{i}\n" for i in range(6, 12_000)))
        z.writestr("four.csv.gz", gzip.compress(b"id,name\n12000,z\n"))
        z.writestr("other.txt", "no")
    (tmp_path / "a" / "empty.csv").write_bytes(b"")
    return f"file://{tmp_path}"


def test_listing(spark, top):
    found = [p.rsplit("/", 1)[-1] for p, _ in store.tree(spark, top)]
    assert sorted(found) == ["One.csv", "empty.csv", "two.csv.gz"]
    assert store.find(spark, top, ["ONE.csv"]).endswith("/One.csv") and store.find(spark, top, ["nothing.csv"]) is None
    assert store.find_one(spark, top, "two.csv.gz").endswith("deep/two.csv.gz") and store.smallest_with(spark, top, "name").endswith(("One.csv", "two.csv.gz"))
    with pytest.raises(FileNotFoundError):
        store.find_one(spark, top, "none.csv")
    with pytest.raises(NotADirectoryError):
        store.tree(spark, top + "/nowhere")
    got = {r["path"]: (r["n_columns"], r["columns"]) for r in store.inventory(spark, top).collect()}
    assert got["a/deep/two.csv.gz"] == (3, "id,name,more") and got["a/empty.csv"] == (0, "") and got["a/One.csv"][0] == 2


def test_scan(spark, top):
    paths = [p for p, _ in store.tree(spark, top)] + [f"{top}/three.zip"]
    got = store.scan(spark, paths, ["ID", "name", "lacking"])
    rows = {int(r["id"]): (r["name"], r["_file"]) for r in got.collect()}
    assert sorted(rows) == list(range(1, 12_001)) and rows[1] == ("größer", "One.csv") and rows[2][0] == "two\nlines, here" and rows[3][0] is None
    assert rows[4] == ("床位", "two.csv.gz") and rows[7] == ("n7", "three.zip!in/three.csv") and rows[12_000] == ("z", "three.zip!four.csv.gz")
    assert got.where("lacking is not null").count() == 0 and got.rdd.getNumPartitions() == 5


def test_bad_bytes(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes(b"id\n" + b"1\n" * 700_000 + b"\xff\xff\n")
    with pytest.raises(Exception, match="after rows are out"):
        store.scan(spark, [f"file://{tmp_path}/late.csv"], ["id"]).count()
    (tmp_path / "never.csv").write_bytes(b"id\n\xff\xff\n")
    with pytest.raises(Exception, match="none of"):
        store.scan(spark, [f"file://{tmp_path}/never.csv"], ["id"]).count()
    with pytest.raises(OSError, match="cannot open"):
        store._open("viewfs://x/y.csv")


def test_unzip(spark, top, tmp_path):
    got = {r["path"]: r["bytes"] for r in store.unzip(spark, [f"{top}/three.zip"], f"file://{tmp_path}/out").collect()}
    assert sorted(got) == ["three/four.csv.gz", "three/in/three.csv"] and (tmp_path / "out/three/in/three.csv").stat().st_size == got["three/in/three.csv"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.csv", "id\n1\n")
    with pytest.raises(ValueError, match="leads out"):
        store.unzip(spark, [f"file://{tmp_path}/bad.zip"], f"file://{tmp_path}/out")
    assert not (tmp_path / "out.csv").exists()


def test_atomic_text(spark, tmp_path):
    path = f"file://{tmp_path}/state.json"
    assert read_text(spark, path) is None
    write_atomic(spark, path, "one")
    write_atomic(spark, path, "zwei ü")
    assert read_text(spark, path) == "zwei ü" and not list(tmp_path.glob("*.tmp"))


def test_a_killed_run_goes_on(spark, tmp_path):
    """Killed between two parts, and once after a part's rows are written and before they are named; failed rows are done again."""
    sink = Sink(spark, f"file://{tmp_path}/sink", "id")
    rows = spark.range(200).withColumn("value", F.col("id") * 2)
    seen = []

    def work(left, fail=False, stop=99):
        if len(seen) == stop:
            raise KeyboardInterrupt
        seen.append(left.count())
        return left.withColumn("status", F.when((F.col("id") % 10 == 0) & F.lit(fail), "failed").otherwise("ok"))

    with pytest.raises(KeyboardInterrupt):
        sink.append(rows, lambda d: work(d, True, 3))
    assert len(sink.parts()) == 3 and 0 < sink.read().count() < 200
    spark.range(5).withColumn("status", F.lit("ok")).write.parquet(f"file://{tmp_path}/sink/part-orphan")
    assert sink.append(rows, work) >= 5
    ok = sink.read().where("status = 'ok'")
    assert ok.count() == ok.select("id").distinct().count() == 200
    assert sink.append(rows, work) == 0
