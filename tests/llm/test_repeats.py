import random
from hashlib import sha256

import numpy as np
import pytest

from clinflow.llm import queries, repeats


def brute(rows, width):
    """[(id, text)] in their order: what stays of each, and the runs that go."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        goes = bytearray(len(data))
        for i in range(len(data) - width + 1):
            s = data[i : i + width]
            if s in seen:
                goes[i : i + width] = b"\1" * width
            seen.add(s)
        spans = [(m, e) for m, e in runs(goes)]
        out.append((_, len(data), spans, bytes(b for b, g in zip(data, goes, strict=True) if not g)))
    return out


def runs(goes):
    i = 0
    while i < len(goes):
        if goes[i]:
            j = i
            while j < len(goes) and goes[j]:
                j += 1
            yield i, j
            i = j
        else:
            i += 1


def check(got, rows, width):
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], sorted((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in got.collect()))
    want = sorted((i is not None, i or 0, n, spans, kept) for i, n, spans, kept in brute(rows, width))
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    """Few letters, so that strings repeat in every way; small shards, so that many transforms are merged."""
    monkeypatch.setattr(repeats, "SHARD", 700)
    draw = random.Random(seed)
    passages = ["".join(draw.choice("abé ") for _ in range(draw.randrange(5, 400))) for _ in range(8)]
    texts = []
    for _ in range(120):
        t = "".join(draw.choice(passages)[draw.randrange(40) :] if draw.random() < 0.6 else "".join(draw.choice("abcdefgh\0") for _ in range(draw.randrange(80))) for _ in range(draw.randrange(6)))
        texts.append(t)
    texts += ["ab" * 400, "a" * 500, "", None, "a" * 99, "a" * 100, "a" * 101]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(repeats.without_repeats(df.repartition(5)), rows, 100)
    check(repeats.without_repeats(df.repartition(2), width=33), rows, 33)


@pytest.mark.parametrize("pieces", [[(1, 8)], [(1, 1 << 20)], [(0, 3), (3, 1 << 20)]])
def test_frequent_anchors_are_cut(spark, pieces, monkeypatch):
    """One line in all texts, other words around it: the same result whatever the pieces."""
    monkeypatch.setattr(repeats, "PIECES", pieces)
    draw = random.Random(5)
    line = "".join(draw.choice("abcdefghij ") for _ in range(95))
    word = lambda: "".join(draw.choice("xyz") for _ in range(3))
    rows = [(i, f"{word()} {line}{word()} {word()}" * 2) for i in range(60)]
    check(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), rows, 100)


def test_transform_and_interleave():
    """Transforms of parts, merged, give the order and common prefixes of all suffixes."""
    draw = random.Random(1)
    shards = [[bytes(draw.choice(b"ab\0") for _ in range(draw.randrange(12, 60))) for _ in range(9)] for _ in range(4)]
    made = [repeats.transform(s) for s in shards]
    for entries, (entry, place, before) in zip(shards, made, strict=True):
        order = sorted(((e[k:] , i, k) for i, e in enumerate(entries) for k in range(len(e) + 1)), key=lambda x: ([c + 1 for c in x[0]] + [0], x[1]))
        assert [(i, k) for _, i, k in order] == list(zip(entry.tolist(), place.tolist(), strict=True))
        assert all(before[r] == (entries[i][k - 1] if k else 0) for r, (_, i, k) in enumerate(order))
    whole = []
    for entry, place, _ in made:
        own = np.flatnonzero(place == 0)
        whole.append(own[np.argsort(entry[own])])
    merged = repeats.Transforms([m[2] for m in made], whole)
    texts, suffixes = [], []
    for base, entries, (entry, place, _) in zip(merged.base, shards, made, strict=False):
        for r, (i, k) in enumerate(zip(entry.tolist(), place.tolist(), strict=True)):
            if len(entries[i]) - k >= 10:
                suffixes.append(base + r)
                texts.append(entries[i][k : k + 10])
    order, common = repeats.interleave(merged, np.array(suffixes), 10)
    got = [texts[i] for i in order]
    assert got == sorted(texts)
    assert common.tolist() == [0] + [next((k for k in range(10) if a[k] != b[k]), 10) for a, b in zip(got, got[1:], strict=False)]


def test_edges(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert len({r[0] for r in rows}) < len(rows)  # repeated rows: equal ones, so any order gives the same
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(r["kept"])) for r in repeats.without_repeats(odd).collect())
    assert got == sorted((i is not None, i or 0, len(kept)) for i, _, _, kept in brute(rows, 100))
    assert repeats.without_repeats(none).count() == 0


def test_query(spark, tiny, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((i, n, sum(b - a for a, b in s), len(s), sha256(kept).hexdigest()) for i, n, s, kept in brute(rows, 100))
    assert sorted(tuple(r) for r in queries.op13_repeats(spark, tiny).collect()) == want
