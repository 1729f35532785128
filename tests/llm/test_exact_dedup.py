from collections import defaultdict
from hashlib import sha256

from clinflow.llm import exact_dedup, queries
from tests.oracle import connect, same


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_oracle(spark, tiny):
    same(spark, connect(tiny), queries.op9_exact_dedup, queries.ORACLE_SQL["op9_exact_dedup"], tiny)


def test_edges(spark, odd, none):
    rows = [(r["doc_id"], lower(r["text"])) for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for keep, best in (("min", min), ("max", max)):
        got = sorted(((r["text_sha256"], -1 if r["doc_id"] is None else r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.classes(odd, keep=keep).collect()))
        wanted = []
        for i, t in rows:
            ids = [x for x in groups[t] if x is not None]
            k = best(ids) if ids else None
            wanted.append((sha256(t.encode()).hexdigest(), -1 if i is None else i, k, len(groups[t]), i == k))
        assert got == sorted(wanted)
    left = exact_dedup.dedup(odd)
    assert left.columns == odd.columns and left.count() == len(groups)
    assert exact_dedup.classes(none).count() == 0 and exact_dedup.dedup(none).count() == 0


def test_hot_group_is_split(spark, docs):
    hot = docs.crossJoin(spark.range(60).withColumnRenamed("id", "k")).selectExpr("doc_id * 60 + k as doc_id", "if(k < 20, 'the same text', concat(text, k)) as text")
    got = exact_dedup.classes(hot)
    assert got.where("group_size > 1000").count() == 20 * docs.count() and got.where("kept").count() == 1 + hot.where("text <> 'the same text'").select("text").distinct().count()


def test_the_comparison_decides(spark, monkeypatch):
    """With a comparison that finds no two texts equal nothing is a copy; with one that finds all equal all are. 5 texts in many buckets."""
    monkeypatch.setattr(exact_dedup, "PER_BUCKET", 20)
    df = spark.range(400).selectExpr("id as doc_id", "if(id < 200, 'Hot text', concat('text ', id % 4)) as text")
    groups = lambda: sorted(r[0] for r in exact_dedup.classes(df).select("keep_id", "group_size").distinct().select("group_size").collect())
    assert groups() == [50, 50, 50, 50, 200]
    monkeypatch.setattr(exact_dedup, "_differs", lambda before, text: exact_dedup.F.lit(True))
    assert groups() == [1] * 400
    monkeypatch.setattr(exact_dedup, "_differs", lambda before, text: exact_dedup.F.lit(False))
    assert groups() == [400]
