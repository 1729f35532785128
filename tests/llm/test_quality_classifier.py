import numpy as np
import pyarrow as pa

from clinflow.llm import quality_classifier as Q
from clinflow.llm import queries
from clinflow.llm.pieces import as_bytes


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95
    assert (got.p_above_0 >= got.p_above_1).all() and np.allclose(got.expected_grade, got.p_above_0 + got.p_above_1)


def test_scores_equal_dense_features():
    texts = ["", "a", "Of Of Of Of", "one two, three!\nfour ### | é", "x " * 500]
    model = Q.Ordinal(np.random.default_rng(1).standard_normal(Q.WIDTH), np.array([-1.0, 1.0]))
    got = model.scores(*as_bytes(pa.array(texts)))
    assert np.allclose(got, Q.features(texts) @ model.weights, atol=1e-3)


def test_thresholds_are_ordered():
    texts = [f"{'bad ' * k}good day {i}" for i in range(60) for k in (0, 4, 40)]
    model = Q.fit(texts, [2, 1, 0] * 60, 3)
    assert model.thresholds[0] < model.thresholds[1]
    s = model.scores(*as_bytes(pa.array(texts)))
    assert s[0::3].mean() > s[1::3].mean() > s[2::3].mean()


def test_edges(spark, odd, none):
    blank = Q.learn(spark.createDataFrame([], "doc_id long, text string, grade int"), 3)
    got = Q.grade(odd, blank)
    assert got.count() == odd.count() and got.where("expected_grade is null").count() == 0 and Q.grade(none, blank).count() == 0


def plain(text, model):
    """The score of one text, cell by cell."""
    raw, words = text.encode(), text.encode().lower().split()
    hashes = [int(Q.hashing.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in words]
    mask = (1 << 64) - 1
    total = 0.0
    cells = []
    for i in range(len(raw) - 2):
        h = (raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA6B + raw[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF
        cells.append((h ^ (h >> 15)) % Q.CELLS)
    total += Q.SCALE * sum(model.weights[c] for c in cells) / max(1, len(cells))
    cells = []
    for i, h in enumerate(hashes):
        x = (h * 3 + (hashes[i - 1] if i else int(Q.START))) & mask
        cells.append(Q.CELLS + int(Q.hashing.mixed(np.array([x], np.uint64))[0]) % Q.CELLS)
    total += Q.SCALE * sum(model.weights[c] for c in cells) / max(1, len(cells))
    n, m = max(1, len(words)), max(1, len(raw))
    measures = [
        4 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        8 * sum(c in b"#*$%&|<>!@^~=+_{}[]\\" for c in raw) / m,
        2 * sum(65 <= c <= 90 for c in raw) / m,
        4 * sum(48 <= c <= 57 for c in raw) / m,
        np.log1p(len(words)) / 12,
        4 * sum(a == b for a, b in zip(words, words[2:], strict=False)) / n,
    ]
    return total + sum(model.weights[2 * Q.CELLS + k * Q.STEPS + min(Q.STEPS - 1, int(x * Q.STEPS))] for k, x in enumerate(measures))


def test_every_text_is_scored_for_itself(docs):
    texts = [r["text"] or "" for r in docs.limit(60).collect()] + ["", "a", "a b a", "b", "b a b", "", "a a"]
    model = Q.Ordinal(np.random.default_rng(2).standard_normal(Q.WIDTH), np.array([-1.0, 1.0]))
    together = model.scores(*as_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        alone = model.scores(*as_bytes(pa.array([t])))[0]
        assert abs(together[k] - alone) < 1e-9 and abs(alone - plain(t, model)) < 1e-6


def test_partitioning_changes_nothing(spark, docs):
    model = Q.Ordinal(np.random.default_rng(3).standard_normal(Q.WIDTH), np.array([-1.0, 1.0]))
    one, many = (dict(map(tuple, Q.grade(d, model).select("doc_id", "expected_grade").collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)
