import random
import re
import time
from hashlib import sha256

from tokenizers import Tokenizer

from clinflow.llm import pieces, queries, token_counts


def test_edits_follow_whole_counts(docs, tokenizer):
    tk = Tokenizer.from_file(tokenizer)
    count = token_counts.counter(pieces.encoder(tokenizer))
    draw = random.Random(3)
    for r in docs.limit(25).collect():
        text = r["text"]
        tree = token_counts.TokenTree.of(text, count)
        for _ in range(12):
            a = draw.randint(0, len(text))
            b = min(len(text), a + draw.choice([0, 1, 2, 5, 300]))
            new = draw.choice(["", " ", "  ", "\n", "x", " word", "é ", " a  b ", "it's" * 50])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.length == len(text)
            assert tree.total == len(tk.encode(text, add_special_tokens=False).ids)


def test_little_is_encoded_again(docs, tokenizer):
    count = token_counts.counter(pieces.encoder(tokenizer))
    text = max((r["text"] for r in docs.collect()), key=len)
    tree = token_counts.TokenTree.of(text, count)
    tree.edit(len(text) // 2, len(text) // 2 + 3, "xyz")
    assert 0 < tree.encoded < 2000 < len(text)


def test_edges(spark, odd, none, tokenizer):
    tk = Tokenizer.from_file(tokenizer)
    edits = spark.createDataFrame([(8, [(0, 3, "ONE"), (5, 900, None)]), (2, [(None, 1, "z"), (2, 1, "q")]), (99, [(0, 1, "")])], "doc_id long, edits array<struct<start_at:long,end_at:long,replacement:string>>")
    got = token_counts.count(odd, edits, tokenizer).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r["n_tokens_after"] == len(tk.encode(r["text_after"], add_special_tokens=False).ids)
    assert {r["text_after"] for r in got if r["doc_id"] == 8} == {"ONE t"} and [r["text_after"] for r in got if r["doc_id"] == 2] == ["A qb c"]
    assert token_counts.count(none, edits, tokenizer).count() == 0


def test_query_redacts_every_match(spark, tokenizer, tmp_path):
    tk = Tokenizer.from_file(tokenizer)
    texts = ["123456789@x.org wrote é 123456789", "a@b.org, c@d.org and a@b.org: 1234567890 or 1234567890", ("call 123456789012 or mail me@here.net ü " * 300), "no match", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op6_token_counts(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        mails, n = re.subn(queries.MAIL, "<mail>", text or "")
        after, m = re.subn(queries.DIGITS, "<number>", mails)
        assert got[i]["n_edits"] == n + m and got[i]["after_sha256"] == sha256(after.encode()).hexdigest()
        assert got[i]["n_tokens_after"] == len(tk.encode(after, add_special_tokens=False).ids)


def test_many_edits_of_long_texts(long_texts, tokenizer):
    tk = Tokenizer.from_file(tokenizer)
    count = token_counts.counter(pieces.encoder(tokenizer))
    for text in long_texts[:2]:
        began = time.perf_counter()
        found = list(re.finditer(queries.MAIL + "|" + queries.DIGITS, text))
        tree = token_counts.TokenTree.of(text, count)
        leaves = len(tree.leaves)
        for m in reversed(found):
            tree.edit(m.start(), m.end(), "<x>")
        assert time.perf_counter() - began < 30 and len(tree.leaves) <= leaves
        assert tree.total == len(tk.encode(tree.text, add_special_tokens=False).ids)


def test_insertions_grow_the_tree(tokenizer):
    tk = Tokenizer.from_file(tokenizer)
    count = token_counts.counter(pieces.encoder(tokenizer))
    tree, text = token_counts.TokenTree.of("a few words here " * 60, count), "a few words here " * 60
    for k in range(60):
        at = (k * 37) % len(text)
        tree.edit(at, at, " inserted words" * 30)
        text = text[:at] + " inserted words" * 30 + text[at:]
        if k % 7 == 0:
            tree.edit(0, len(text) // 2, "")
            text = text[len(text) // 2 :]
        assert tree.text == text and tree.total == len(tk.encode(text, add_special_tokens=False).ids)
