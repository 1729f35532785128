import re
from collections import defaultdict

from clinflow.llm import quality_rules, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for k in range(len(w) - 2):
        seen[tuple(w[k : k + 3])].append(k)
    covered = {k + j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, tiny, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op10_quality_rules(spark, tiny).collect():
        b = brute(texts[r["doc_id"]])
        assert tuple(r)[1:6] == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r["kept"] and r["base_failed"])


def test_edges(odd, none):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])
        assert r["kept"] == (not r["failed"])
    assert quality_rules.judge(none).count() == 0


def test_no_python_in_the_plan(odd):
    assert not re.search("Python|Arrow|Pandas", quality_rules.judge(odd)._jdf.queryExecution().executedPlan().toString())


def test_verdict_follows_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op10_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert got.where("quality = 1 and not base_failed and not kept").count() == 0
    assert got.where("quality = 0 and kept").count() <= 0.05 * got.where("quality = 0").count()


def test_query_equals_sql(spark, tiny):
    from clinflow.llm import queries
    from tests.oracle import connect, same

    same(spark, connect(tiny), queries.op10_quality_rules, queries.ORACLE_SQL["op10_quality_rules"], tiny)
