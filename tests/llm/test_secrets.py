import hashlib
import re
import time

from clinflow.llm import queries, secrets


def brute(text):
    kind = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password") + "|" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(f"({kind})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def test_base(spark, tiny, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op7_secret_scans(spark, tiny).collect():
        assert r["base_sha256"] == hashlib.sha256(brute(texts[r["doc_id"]]).encode()).hexdigest()


def test_tricky():
    for text in ("token:secret:abcdefghij", 'API_KEY = "abcdefgh"', "paſſword=abcdefgh", "toKen=abcdefgh", "AKIAAKIA", "AKIAABCDEFGHIJKL", "secret=token=abc", "passwd: short", "f" * 31, "0" * 32 + "g", "password  :=abcdefgh"):
        assert ",".join(f"{k}:{s}:{e}" for s, k, e in secrets.base_spans(text)) == brute(text), text


def test_models_tell_apart():
    models = secrets.MarkovPair(secrets.samples(seed=1))
    fresh = secrets.samples(600, seed=2)
    right = sum((models.score(run) > 0.5) == bool(y) for run, y in fresh)
    assert right / len(fresh) > 0.9
    text = "key is Zx8Qw1Lm9Pk2Vb7Nc4Tr6Yh3 and getUserNameFromTable_item_list"
    assert [k for _, k, _ in secrets.random_spans(text, [], models, 0.5)] == ["random"]


def test_edges(odd, none):
    got = secrets.scan(odd)
    assert got.count() == odd.count() and secrets.scan(none).count() == 0
    assert [s["secret"] for r in got.where("doc_id = 12").collect() for s in r["found"]] == ["password = abcdefgh1234"]
    assert got.where("doc_id is null").count() == 2


def test_redact():
    assert secrets.redact("a token=abcdefgh b", [(2, "assign", 16)]) == "a <assign> b"


def test_model_spans_equal_a_plain_search(docs):
    models = secrets.MarkovPair(secrets.samples(600))
    texts = [r["text"] or "" for r in docs.collect()] + ["x = Zk3Qp9Lm2Xv8Rt5Wy7Bn4 token=Zk3Qp9Lm2Xv8Rt5Wy7Bn4 get_user_name_value_index_12"]
    for text in texts:
        base = secrets.base_spans(text)
        wanted = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            padded = "\0\0" + m[0]
            ratio = sum(models.ratio.get(padded[i : i + 3], 0.0) for i in range(len(m[0]))) / len(m[0])
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and ratio > 0.5 and all(e <= m.start() or m.end() <= s for s, _, e in base):
                wanted.append((m.start(), "random", m.end()))
        assert secrets.random_spans(text, base, models, 0.5) == wanted


def test_long_texts_take_linear_time(long_texts):
    models = secrets.MarkovPair(secrets.samples(200))
    for text in long_texts:
        began = time.perf_counter()
        secrets.random_spans(text, secrets.base_spans(text), models, 0.5)
        assert time.perf_counter() - began < 4
