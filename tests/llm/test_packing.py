import zlib

import numpy as np
from tokenizers import Tokenizer

from clinflow.llm import packing


def check(pieces, texts, tokenizer, window=1024):
    tk = Tokenizer.from_file(tokenizer)
    ids = [np.append(np.array(tk.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4") for t in texts]
    rows = [r.asDict() for r in pieces.collect()]
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return rows, ids, by_seq


def test_round_trip(docs, tokenizer):
    texts = docs.collect()
    rows, ids, by_seq = check(packing.pack(docs, tokenizer), [r["text"] for r in texts], tokenizer)
    of = {r["doc_id"]: x for r, x in zip(texts, ids, strict=True)}
    at = dict.fromkeys(of, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]] and bytes(r["ids"]) == of[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()
        at[r["doc_id"]] += r["length"]
    assert at == {k: len(v) for k, v in of.items()}
    room = 1 - sum(map(len, of.values())) / (1024 * len(by_seq))
    assert room < 0.01


def test_edges(odd, none, tokenizer):
    texts = [r["text"] for r in odd.collect()]
    rows, ids, _ = check(packing.pack(odd, tokenizer), texts, tokenizer)
    assert sum(r["doc_tokens"] == 1 for r in rows) == sum(not t for t in texts)
    assert sorted(zlib.crc32(b"".join(x.tobytes() for x in [i])) for i in ids if len(i) < 50) == sorted(zlib.crc32(bytes(r["ids"])) for r in rows if r["doc_tokens"] < 50 and r["length"] == r["doc_tokens"])
    assert packing.pack(none, tokenizer).count() == 0


def test_windows_are_bounded():
    out = []
    w = packing.Windows(lambda p: out.append(sum(n for _, _, n in p)), 100, 3)
    for i, n in enumerate([60, 70, 80, 90, 30, 10, 250, 99, 1]):
        w.add(i, n)
        assert len(w.open) <= 3
    w.close()
    assert sum(out) == 690 and all(x == 100 for x in out[:-1])


def test_ids_are_those_of_a_plain_call(tokenizer):
    """Marks of special tokens, odd white space and unbroken runs included."""
    import random

    import pyarrow as pa
    import pytest

    from clinflow.llm import pieces

    encoder, tk, draw = pieces.encoder(tokenizer), Tokenizer.from_file(tokenizer), random.Random(5)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\u00a0", "\u3000", "it's", "don't", " 12", "é", "ß ", "word", " Word", "<|", "|>", "😀", "\t", "!!", "A"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(3000)] + ["ab" * 40_000]
    arr = pa.array(texts)
    ids, at = encoder.encode(*pieces.as_bytes(arr), arr)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tk.encode(t, add_special_tokens=False).ids, t
    with pytest.raises(ValueError, match="another way"):
        old, pieces.PATTERN = pieces.PATTERN, r"\S+|\s+"
        try:
            pieces.PieceEncoder(tokenizer)
        finally:
            pieces.PATTERN = old
