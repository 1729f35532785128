import corpus_pipeline
from clinflow.llm import exact_dedup, near_dedup, queries, toxicity


def test_stages_take_effect(spark, tiny, docs, tmp_path):
    columns = docs.columns
    lexicon = queries.toxic_lexicon(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    automaton = lexicon.automaton()
    at, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, tiny).write.parquet(str(tmp_path / str(k)))
        before, at = at, spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, at)
        if name != "packing":
            assert at.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    wanted = {r["doc_id"] for r in before.collect() if lexicon.score(lexicon.features(toxicity.fold(r["text"]), automaton)) < 0.5}
    assert ids(after) == wanted
    before, after = seen["exact_dedup"]
    least = {}
    for r in before.collect():
        t = r["text"].encode().lower()
        least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    assert ids(after) == set(least.values()) and after.count() == len(least)
    before, after = seen["near_dedup"]
    assert ids(after) == {r["class_id"] for r in near_dedup.classes(before).collect()}
    before, after = seen["mixing"]
    assert ids(after) == ids(before) and after.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    before, after = seen["packing"]
    assert ids(after) == ids(before)
    assert exact_dedup.dedup(before).count() == before.select("doc_id").distinct().count()


def test_run(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_on_odd_and_empty_tables(spark, tiny, odd, none, tmp_path):
    """Nulls, long texts, repeated rows and clashing columns go through every stage; an empty table stays empty."""
    for n, table in enumerate((odd, none)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, at, tiny)
            got.write.parquet(str(tmp_path / f"{n}{name}"))
            after = spark.read.parquet(str(tmp_path / f"{n}{name}"))
            assert name == "packing" or after.columns == table.columns
            assert (after.count() > 0) == (n == 0)
            at = after


def test_run_leaves_only_its_result(spark, none, tiny, tmp_path):
    from clinflow import shared

    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tiny}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    begun = shared.made()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0 and shared.made() == begun + 1
