import math
import re
from collections import defaultdict

import pytest

from clinflow.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_tokens(odd):
    for r in odd.select("text", mixing.tokens(odd["text"]).alias("n")).collect():
        assert r["n"] == len(WORD.findall(r["text"] or ""))


def test_exponent(spark):
    sizes = {"a": 1000, "b": 100, "c": 10}
    t = spark.createDataFrame([(k, 1, v) for k, v in sizes.items()], "_source string, rows long, tokens long")
    a = mixing.find_exponent(t, repetition=4.0)
    assert 100 ** (1 - a) == pytest.approx(4.0)
    e = mixing.find_exponent(t, entropy=0.9)
    z = sum(v**e for v in sizes.values())
    h = -sum(v**e / z * math.log(v**e / z) for v in sizes.values())
    assert h / math.log(3) == pytest.approx(0.9, abs=1e-4)
    assert mixing.find_exponent(t.where("_source = 'a'"), entropy=0.5) == 1.0


def brute_copies(plan):
    """Copies by walking each source's blocks and their rows in order up to the budget."""
    by = defaultdict(list)
    for r in plan:
        by[r["_source"]].append(r)
    for rows in by.values():
        tokens = sum(r["tokens"] for r in rows)
        budget = rows[0]["passes"] * tokens
        used = sum(r["tokens"] * r["copies"] for r in rows)
        most = max(r["tokens"] for r in rows)
        assert budget - 1e-6 <= used <= budget + most or not tokens
        assert {r["copies"] for r in rows} <= {math.floor(rows[0]["passes"]), math.floor(rows[0]["passes"]) + 1}


def test_plan(docs):
    skew = docs.withColumn("source", (docs["doc_id"] % 10 < 6).cast("string"))
    plan = mixing.plan(skew, repetition=1.3).collect()
    assert len(plan) == docs.count() and min(r["copies"] for r in plan) == 1
    brute_copies(plan)
    less = mixing.plan(skew, entropy=0.99, budget=5000).collect()
    brute_copies(less)
    assert abs(sum(r["tokens"] * r["copies"] for r in less) - 5000) < 2 * max(r["tokens"] for r in less)


def test_mix(docs, odd, none):
    got = mixing.mix(docs, repetition=2.0)
    assert got.columns == [*docs.columns, "mix_pass", "mix_block", "mix_rank"]
    copies = {r["_id"]: r["copies"] for r in mixing.plan(docs, repetition=2.0).collect()}
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == copies
    assert mixing.mix(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert mixing.mix(odd).columns[: len(odd.columns)] == odd.columns and mixing.mix(odd).count() >= odd.count()
    assert mixing.mix(none).count() == 0 and mixing.plan(none).count() == 0
