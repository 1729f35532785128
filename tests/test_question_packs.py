import json

from clinflow.plans import table_queries
from tests.test_operators import greedy


def test_whole_passages_are_packed(spark, tmp_path):
    texts = {1: " ".join("ab" * (k % 5 + 1) for k in range(60)), 2: "one two", 3: " ".join(["word"] * 13)}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: json.loads(r["packs"]) for r in table_queries.question_packs(spark, str(tmp_path)).collect()}
    assert got == {i: greedy([len(w) for w in t.split(" ")], 10, 30, 4) for i, t in texts.items()}
