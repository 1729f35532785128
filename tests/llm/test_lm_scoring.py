import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinflow.llm import lm_scoring, pieces, queries
from clinflow.shared import materialise


@pytest.fixture(scope="module", autouse=True)
def short():
    old = lm_scoring.TRAIN_STEPS
    lm_scoring.train.__defaults__ = (60, *lm_scoring.train.__defaults__[1:])
    yield
    lm_scoring.train.__defaults__ = (old, *lm_scoring.train.__defaults__[1:])


def brute(rows):
    held = {k: zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, _) in enumerate(rows)}
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    c = Counter()
    for k, own in enumerate(tokens):
        if not held[k]:
            c.update(own)
    n, v = sum(c.values()), len(c)
    return [(rows[k][0], held[k], len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) for k, own in enumerate(tokens)]


def test_base_and_held_out(spark, tiny, docs):
    got = {r["doc_id"]: r for r in queries.op1_lm_scoring(spark, tiny).collect()}
    for i, held, n, known, total, base in brute([(r["doc_id"], r["text"]) for r in docs.collect()]):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def coded(docs, tokenizer):
    return materialise(lm_scoring.encoded(docs, F.lit(False), tokenizer))


def test_windows_score_each_token_once(docs, tokenizer):
    rows = coded(docs, tokenizer)
    model = lm_scoring.learn(rows, lm_scoring.follower_counts(rows))
    texts = ["", "the", "the and of ", "one two three " * 60]
    import pyarrow as pa

    ids, at = lm_scoring.encode_words(pieces.encoder(tokenizer, special=False), *pieces.as_bytes(pa.array(texts)))[:2]
    got = model.score(ids, at)
    for k in range(len(texts)):
        own = [model.end, *model.symbol[ids[at[k] : at[k + 1]]], model.end]
        total = model.rare[ids[at[k] : at[k + 1]]].sum()
        for i in range(len(own) - 1):  # one token at a time, with the window's own context
            start = i // lm_scoring.STRIDE * lm_scoring.STRIDE
            lo = max(0, start - lm_scoring.CONTEXT)
            x = np.array(own[lo : i + 1])
            q, key, v = model.query[own[i]], model.key[x], model.value[x]
            a = key @ q / math.sqrt(lm_scoring.WIDTH) + model.place[np.arange(len(x))[::-1]]
            a = np.exp(a - a.max())
            h = np.tanh((a / a.sum()) @ v + model.own[own[i]])
            top = model.head[own[i]] + model.to_class @ h
            c, y = own[i + 1] // lm_scoring.CLASSES, own[i + 1]
            members = slice(c * lm_scoring.CLASSES, (c + 1) * lm_scoring.CLASSES)
            low = model.pair[own[i], members] + model.to_symbol[members] @ h
            total += top[c] - np.log(np.exp(top).sum()) + low[y % lm_scoring.CLASSES] - np.log(np.exp(low).sum())
        assert got[k] == pytest.approx(total / math.log(10), rel=1e-4)
    # probabilities of all symbols after a context are one
    x = np.full((1, lm_scoring.SPAN), model.end)
    p = [model.log_probabilities(x, np.full((1, lm_scoring.STRIDE), s), np.ones((1, lm_scoring.SPAN), bool))[0] for s in range(lm_scoring.SYMBOLS)]
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-3)


def test_training_lowers_loss(docs, tokenizer):
    import pyarrow as pa

    texts = [r["text"] for r in docs.collect()]
    ids, at = lm_scoring.encode_words(pieces.encoder(tokenizer, special=False), *pieces.as_bytes(pa.array(texts)))[:2]
    model = lm_scoring.prior(lm_scoring.follower_counts(coded(docs, tokenizer)))
    before = model.score(ids, at).sum()
    assert lm_scoring.train(model, ids, at, 150).score(ids, at).sum() > before


def test_edges(odd, none, tokenizer):
    got = lm_scoring.score(odd, F.col("doc_id") % 3 == 1, tokenizer)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 5)} == {1}
    assert lm_scoring.score(none, F.lit(True), tokenizer).count() == 0


def test_attention_is_trained_on_all_documents(spark, docs, tokenizer, monkeypatch):
    texts = [r["text"] or "" for r in docs.collect()]
    ids, at = lm_scoring.encode_words(pieces.encoder(tokenizer, special=False), *pieces.as_bytes(lm_scoring.pa.array(texts)))[:2]
    windows = int((-(-(np.diff(at) + 1) // lm_scoring.STRIDE)).sum())
    seen, one = [], lm_scoring.train_round
    monkeypatch.setattr(lm_scoring, "train_round", lambda *a, **b: seen.append(one(*a, **b)) or seen[-1])
    monkeypatch.setattr(lm_scoring, "LEAST_STEPS", 1)
    rows = coded(docs, tokenizer)
    before = lm_scoring.prior(lm_scoring.follower_counts(rows)).score(ids, at).sum()
    model = lm_scoring.learn(rows.repartition(3), lm_scoring.follower_counts(rows))
    assert len(seen) == lm_scoring.ROUNDS and sum(seen) == windows
    assert model.score(ids, at).sum() > before


def test_pairs_across_words_are_counted_and_scored(docs, tokenizer, monkeypatch):
    texts = [(r["doc_id"], r["text"] or "") for r in docs.limit(40).collect()]
    few, encoder, c, held = docs.sparkSession.createDataFrame(texts, "doc_id long, text string"), pieces.encoder(tokenizer, special=False), Counter(), {}
    for i, t in texts:
        ids, at = lm_scoring.encode_words(encoder, *pieces.as_bytes(lm_scoring.pa.array([t])))[:2]
        own, held[i] = [lm_scoring.END_ID, *ids.tolist(), lm_scoring.END_ID], (ids, at)
        c.update(zip(own, own[1:], strict=False))
    got = {divmod(r["pair"], lm_scoring.IDS): r["n"] for r in lm_scoring.follower_counts(coded(few, tokenizer)).collect()}
    assert got == dict(c)
    one = lm_scoring.learn
    kept = []
    monkeypatch.setattr(lm_scoring, "LEAST_STEPS", 1)
    monkeypatch.setattr(lm_scoring, "KNOWN_PAIRS", 200)
    monkeypatch.setattr(lm_scoring, "learn", lambda *a, **b: kept.append(one(*a, **b)) or kept[-1])
    scores = {r["doc_id"]: r["score"] for r in lm_scoring.score(few, F.lit(False), tokenizer).collect()}
    model, first = kept[0], Counter()
    for (a, b), n in c.items():
        first[a] += n * bool(model.is_rare()[b])
    rest = 0
    for i, (ids, at) in held.items():
        own, want = [lm_scoring.END_ID, *ids.tolist(), lm_scoring.END_ID], 0.0
        for a, b, p in zip(own[:-1], own[1:], np.exp(model.each(ids, at)), strict=True):
            if model.is_rare()[b]:  # each gives it its share of the rare symbol
                share = math.exp(model.rare[b])
                p, rest = p / share * (c[a, b] + lm_scoring.TRUST * share) / (first[a] + lm_scoring.TRUST), rest + 1
            want += math.log10(p)
        assert scores[i] == pytest.approx(want, rel=1e-5)
    assert rest > 0
    # what may follow a subword inside the rare symbol has probability one
    rare = np.flatnonzero(model.is_rare())
    for a in list(first)[:5]:
        assert sum((c[a, b] + lm_scoring.TRUST * math.exp(model.rare[b])) / (first[a] + lm_scoring.TRUST) for b in rare.tolist()) == pytest.approx(1, abs=1e-6)
    symbols = Counter()
    for (a, b), n in c.items():
        symbols[model.symbol[a], model.symbol[b]] += n
    for (a, b), n in symbols.most_common(20):  # also across words
        ones = np.array([sum(n for (_, y), n in symbols.items() if y == z) for z in range(lm_scoring.SYMBOLS)]) + 0.5
        whole = sum(n for (x, _), n in symbols.items() if x == a) + lm_scoring.SMOOTH
        assert math.exp(model.pair[a, b]) == pytest.approx((n + lm_scoring.SMOOTH * ones[b] / ones.sum()) / whole, rel=1e-4)


def test_words_come_back_from_ids(odd, tokenizer):
    import pyarrow as pa

    texts = pa.array([r["text"] for r in odd.collect()] + [" \u00a0x it's 12ab \U0001f600\u3000 <|endoftext|> a\x0bb"], pa.string())
    ids, at, words, word_at = lm_scoring.encode_words(pieces.encoder(tokenizer, special=False), *pieces.as_bytes(texts))
    got, got_at = lm_scoring.words_of(ids, at, tokenizer)
    assert got.to_pylist() == words.to_pylist() and got_at.tolist() == word_at.tolist()


def test_scores_do_not_depend_on_partitions(spark, docs, tokenizer):
    some = docs.where("doc_id < 60")
    held = queries._held(1)
    one, seven = ({r["doc_id"]: r["score"] for r in lm_scoring.score(some.repartition(n), held, tokenizer).collect()} for n in (1, 7))
    assert max(abs(one[i] / seven[i] - 1) for i in one) < 1e-6


def test_model_is_not_copied_at_look_ups(docs, tokenizer):
    """Rows of all tables lie one after another; else a training step copies the table of pairs, 4 MB, whole."""
    model = lm_scoring.prior(lm_scoring.follower_counts(coded(docs, tokenizer)))
    for table in (model.pair, model.head, *(getattr(model, k) for k in lm_scoring.Model.LEARNT)):
        assert table.flags["C_CONTIGUOUS"]


def test_training_step_is_that_of_the_loss(docs, tokenizer):
    """Gradients by finite differences of the mean negative log-probability, in double precision."""
    import pyarrow as pa

    ids, at = lm_scoring.encode_words(pieces.encoder(tokenizer, special=False), *pieces.as_bytes(pa.array([r["text"] for r in docs.limit(2).collect()])))[:2]
    ids, at = ids[: at[1]][:90], np.array([0, min(90, at[1])])
    model = lm_scoring.prior(lm_scoring.follower_counts(coded(docs, tokenizer)))
    draw = np.random.default_rng(3)
    for k in lm_scoring.Model.LEARNT:
        setattr(model, k, (0.3 * draw.standard_normal(getattr(model, k).shape)).astype(np.float32))
    start, held, one = {k: getattr(model, k).copy() for k in lm_scoring.Model.LEARNT}, [], lm_scoring.Adam.step
    try:
        lm_scoring.Adam.step = lambda self, *a: held.append({k: g.copy() for k, g in self.grads.items()}) or one(self, *a)
        lm_scoring.train(model, ids, at, 1)
    finally:
        lm_scoring.Adam.step = one
    for k, w in start.items():
        g = held[0][k]
        for cell in np.argsort(-np.abs(g).ravel())[:3]:
            losses = []
            for sign in (1, -1):
                for name, x in start.items():
                    setattr(model, name, x.astype(np.float64))
                getattr(model, k).ravel()[cell] += sign * 1e-2
                losses.append(-model.each(ids, at).sum() + model.rare[ids].sum())
            assert g.ravel()[cell] == pytest.approx((losses[0] - losses[1]) / 2e-2 / (len(ids) + 1), rel=2e-2, abs=1e-4)


def test_words_are_encoded_together_as_one_by_one(odd, tokenizer):
    """One call for all distinct words gives each word the ids of a call of its own, whatever it ends in."""
    import pyarrow as pa

    ends = [" ", "\x85", " ", "　", " ", "\x7f", "\x01", "é", "你", "\U0001f600", "'s", "9", "<|endoftext|>", "́"]
    words = [w.encode() for w in ["the", "1st", " x", "a　b", *[a + e for a in ("", "x", "ü") for e in ends]]]
    words += sorted({w for r in odd.collect() for w in (r["text"] or "").encode().lower().split()} - set(words))
    encoder = pieces.encoder(tokenizer, special=False)
    for some in (words, [*words, b"\xff\xfe", b"a\xc2"], words[:1], ["　".encode()], []):
        flat, first, size = lm_scoring.subwords(encoder, pa.array(some, pa.large_binary()))
        want = [encoder.tokenizer.encode((b" " + w).decode("utf-8", "replace"), add_special_tokens=False).ids for w in some]
        assert [flat[i : i + n].tolist() for i, n in zip(first, size, strict=True)] == want


def test_groups_of_a_batch_share_their_words(spark, tokenizer):
    """Texts of several groups of pieces.GROUP bytes: ids of each and word counts over all but those held out."""
    import pyarrow as pa

    texts = [" ".join(f"{w} x{k % 3}{i}" for i in range(300_000)) for k, w in enumerate(("the", "And", "你　 the"))] + [None, ""]
    assert sum(len(t or "") for t in texts) > 2 * pieces.GROUP
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = lm_scoring.encoded(docs, F.col("doc_id") == 1, tokenizer).collect()
    got = {r["_id"]: r for r in rows if r["word"] is None}
    want = Counter(w for k, t in enumerate(texts) if k != 1 for w in [*(t or "").encode().lower().split(), b""])
    sums = Counter()
    for r in rows:
        if r["word"] is not None:
            sums[bytes(r["word"])] += r["n"]
    assert sums == want
    for k, t in enumerate(texts):
        ids, at = lm_scoring.encode_words(pieces.encoder(tokenizer, special=False), *pieces.as_bytes(pa.array([t], pa.string())))[:2]
        assert np.array_equal(np.frombuffer(got[k]["ids"], "<u2"), ids) and got[k]["n_words"] == len((t or "").encode().split()) and got[k]["held_out"] == (k == 1)
