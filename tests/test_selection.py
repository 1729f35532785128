import pytest
from pyspark.sql import functions as F

from clinflow.operators import models as M
from clinflow.operators import selection as Q


def test_ids():
    assert Q.flat_ids({"a": {"b": [1, 2, "x"], "c": {"d": [7]}}, "e": [2, True], "f": "no list"}) == {1, 2, 7}


def test_a_repeated_id_is_an_error(spark):
    with pytest.raises(ValueError, match="more than once"):
        Q.id_map(spark, {"a": [1, 2], "b": [2]})


def test_bound_needs_equal_keys(spark):
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(4).withColumn("y", F.lit(2))
    with pytest.raises(ValueError, match="1 beyond"):
        Q.bound(a, b, "id")
    assert Q.bound(a, b.where("id < 3"), "id").columns == ["id", "x", "y"]


def test_roles_keep_the_order():
    got = M.roles(["hr", "sex_male", "note_category_a", "age", "has_note", "note_category_b"])
    assert got == {"continuous": ["hr", "age"], "binary": ["sex_male", "note_category_a", "has_note", "note_category_b"], "category": ["note_category_a", "note_category_b"]}


def test_source_proxy_sees_what_is_there(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 2) + (i % 7) / 7, (i * 37 % 101) / 101, i // 2 % 5 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, source string, tells double, silent double, fold int")
    area = lambda f: M.source_proxy(df, [f], "source", "a", "fold", "id").first()["auroc"]
    assert area("tells") > 0.9 and 0.35 < area("silent") < 0.65


def test_terms_of_training_rows_only(spark):
    texts = ["Café au lait"] * 6 + ["thé vert"] * 6 + ["nur einmal", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["tfidf"] for r in M.tfidf(df.where("id < 12"), df, "text").collect()}
    assert got[0].numNonzeros() == 5 and got[12].numNonzeros() == 0 and got[13].numNonzeros() == 0
    assert got[0].norm(2) == pytest.approx(1)
