import tracemalloc

import numpy as np
import pyarrow as pa

from clinflow.llm import near_dedup
from clinflow.shared import arrow_rows


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Classes by plain union-find over all pairs, by this module's exact weighted similarity of the same hashes."""
    idf_held, n = np.zeros(near_dedup.CELLS, np.int64), len(rows)
    sets = []
    from clinflow.llm.pieces import as_bytes
    import pyarrow as pa

    for _, t in rows:
        s, tf, _ = near_dedup.distinct(*near_dedup.shingles(*as_bytes(pa.array([t], pa.string()))))
        assert len(s) == len(shingles(t))
        sets.append((s, tf))
        idf_held += np.bincount(near_dedup._cells(s), minlength=near_dedup.CELLS)
    idf = near_dedup.idf_levels(idf_held, n)
    held = [((s >> np.uint64(32)).astype(np.uint32), near_dedup.levels(s, tf, idf).astype(np.uint8)) for s, tf in sets]
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if len(np.intersect1d(held[i][0], held[j][0])) and near_dedup.weighted_jaccard(*held[i], *held[j]) >= near_dedup.SIMILAR:
                up[max(top(i), top(j))] = min(top(i), top(j))
    names = {}
    for i in range(n):
        names.setdefault(top(i), []).append(rows[i][0])
    return {rows[i][0]: min(names[top(i)]) for i in range(n)}


def test_classes(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == brute(rows)


def test_chain_of_noisy_copies(spark, docs):
    base = [r["text"].split() for r in docs.collect() if len(r["text"].split()) > 150][:3]
    rows = []
    for b, words in enumerate(base):
        for v in range(40):
            w = list(words[:150])
            w[(v * 3) % 150] = f"edit{v}"
            rows.append((b * 100 + v, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) <= 3


def test_edges(odd, none):
    got = near_dedup.classes(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[0]["class_id"] == 0 and by_id[1]["class_id"] == 1 and by_id[5]["class_size"] == 1
    assert {by_id[i]["class_id"] for i in (2, 3, 4)} == {2} and by_id[6]["class_id"] == by_id[7]["class_id"] == 6 and by_id[9]["class_id"] == 8
    left = near_dedup.representatives(odd)
    assert left.columns == odd.columns
    assert near_dedup.classes(none).count() == 0 and near_dedup.representatives(none).count() == 0


def test_sampler_estimates_similarity():
    draw = np.random.default_rng(1)
    a = np.sort(draw.integers(1 << 63, size=3000, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:2400], draw.integers(1 << 63, size=600, dtype=np.uint64)]))
    level = np.full(3000, 8)
    old, near_rows = near_dedup.ROWS, []
    one = near_dedup.Sampler()
    x = one.bands(np.concatenate([a, b]), np.concatenate([level, level]), np.array([0, 3000, 6000]))
    near_rows.append((x[0] == x[1]).mean())
    assert old == 3 and 0.05 < near_rows[0] < 0.6  # (2/3) ** 3 of the bands agree, about


def test_star_of_copies(spark):
    """Copies that are similar to their original and not to each other; the original is seldom among a bucket's heads."""
    draw = np.random.default_rng(4)
    rows = []
    for star in range(2):
        words = [f"w{x}" for x in draw.integers(5000, size=300)]
        for v in range(60):
            w = list(words)
            for k in draw.choice(60, 5, replace=False) * 5 if v else ():
                w[k] = f"edit{star}x{v}x{k}"
            rows.append((star * 100 + v, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and set(got.values()) == {0, 100}


def test_sampler_is_made_in_little_more_memory_than_it_takes():
    tracemalloc.start()
    sampler = near_dedup.Sampler()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * sampler.table.nbytes


def test_workers_get_few_rows_at_once(spark, docs, monkeypatch):
    name, seen, one = "spark.sql.execution.arrow.maxRecordsPerBatch", [], near_dedup._nodes
    was = spark.conf.get(name)
    monkeypatch.setattr(near_dedup, "_nodes", lambda *a: seen.append(int(spark.conf.get(name))) or one(*a))
    near_dedup.classes(docs.limit(20)).count()
    assert seen == [near_dedup.BATCH_ROWS] and spark.conf.get(name) == was

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"id": pa.array([batch.num_rows], pa.int64())})

    with arrow_rows(spark, 300):
        assert max(r["id"] for r in spark.range(0, 1_000, 1, 1).mapInArrow(sizes, "id long").collect()) == 300
