import zipfile

import pytest

from clinflow.sources import files as S


def test_csv(spark, tmp_path):
    p = tmp_path / "A" / "Notes.CSV"
    p.parent.mkdir()
    p.write_text('ID,Text\n1,"two\nlines"\n2,x\n')
    assert S.find(str(tmp_path), ["notes.csv"]) == p and S.find_one(str(tmp_path), "NOTES.csv") == p
    got = S.read_csv(spark, str(p), ["id", "text", "absent"], {"id": "long", "absent": "double"})
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "two\nlines", None), (2, "x", None)]
    with pytest.raises(ValueError, match="none of"):
        S.read_csv(spark, str(p), ["z"])
    assert S.inventory(spark, str(tmp_path)).first()["n_columns"] == 2
    with pytest.raises(FileNotFoundError):
        S.find_one(str(tmp_path), "other.csv")


def test_encoding(tmp_path):
    for name, text in (("utf-8-sig", "a,中"), ("gb18030", "名称,数值")):
        (tmp_path / "x").write_bytes(text.encode(name))
        assert S.encoding(str(tmp_path / "x")) in (name, "utf-8-sig")
    assert S.encoding(str(tmp_path / "x")) == "gb18030"


def test_a_late_byte_counts(tmp_path):
    (tmp_path / "x").write_bytes(b"a" * 3_000_000 + "名".encode("gb18030"))
    assert S.encoding(str(tmp_path / "x")) == "gb18030"


@pytest.mark.parametrize("name", S.SENSITIVE)
def test_guarded_names(spark, tmp_path, name):
    with pytest.raises(ValueError, match="sensitive"):
        S.write_aggregate(spark.range(1).withColumnRenamed("id", name.upper()), str(tmp_path / "k"))


def test_unzip_stays_inside(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("../evil.csv", "a")
    with pytest.raises(ValueError, match="leads out"):
        S.unzip(str(tmp_path / "z.zip"), str(tmp_path / "out"))


def test_answers(spark, tmp_path):
    good = '{"case_id": "a", "status": "ok", "response": {"answers": {"x": {"noul": 0.5, "chunk_values": [0.1, 0.5]}}}}\n'
    (tmp_path / "a.json").write_text(good + good.replace('"a"', '"b"').replace("ok", "failed"))
    with pytest.raises(ValueError):
        S.read_answers(spark, str(tmp_path / "a.json"))
    got = S.read_answers(spark, str(tmp_path / "a.json"), strict=False)
    assert got.selectExpr("case_id", "response.answers['x'].noul").collect()[0] == ("a", 0.5)
    assert S.remaining(spark.createDataFrame([("a",), ("b",)], "case_id string"), got, "case_id").collect()[0][0] == "b"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", None)], "name string, n int")
    S.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"name":"x","n":null}'
    with pytest.raises(ValueError, match="sensitive"):
        S.write_aggregate(df.withColumnRenamed("name", "Subject_ID"), str(tmp_path / "k"))
    with pytest.raises(ValueError, match="not marked"):
        S.synthetic_only(spark.createDataFrame([(True,), (None,)], "synthetic boolean"))


def test_contracts(spark, tmp_path):
    from clinflow.sources import contracts as K

    K.write_checkpoint({"approved": True, "v": 1}, str(tmp_path / "r.json"))
    assert K.require_registration(str(tmp_path / "r.json"), {"v": 1})["v"] == 1
    with pytest.raises(PermissionError):
        K.require_registration(str(tmp_path / "r.json"), {"v": 2})
    with pytest.raises(ValueError):
        K.require_hash(str(tmp_path / "r.json"), "0")
    assert K.export(str(tmp_path), str(tmp_path / "x.zip")) == ["r.json"]
    got = K.template_corpus(spark, 200, {"worse": ["is worse"], "better": ["is better"]}, ["Patient", "Pt"])
    assert got.count() == 200 and got.where("label = 'worse' and not contains(text, 'is worse')").count() == 0 and got.where("label is null").count() > 20
