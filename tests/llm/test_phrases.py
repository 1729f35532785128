import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinflow.llm import phrases, queries
from tests.llm.test_divergence import low
from tests.oracle import connect, same


def brute(rows, longest=3, least=10, covered=50, top=2000):
    """rows: (text, lang)."""
    f, n, out = {}, Counter(), []
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(t)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        hidden = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    q = p[i : i + k]
                    if 100 * a >= covered * found[q]:
                        hidden.add(q)
        rows_ = []
        for p, a in found.items():
            if p in hidden:
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for r, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_oracle(spark, tiny):
    same(spark, connect(tiny), queries.op12_phrases, queries.ORACLE_SQL["op12_phrases"], tiny)


@pytest.mark.parametrize(("parts", "split", "group", "longest"), [(1, 0.002, 10**7, 3), (6, 0.0, 600, 3), (4, 0.05, 300, 4), (2, 1.0, 10**7, 2)])
def test_equals_brute_force(spark, monkeypatch, parts, split, group, longest):
    """A hot word, hot prefixes that are split and not, many small groups, other lengths."""
    monkeypatch.setattr(phrases, "SPLIT", split)
    monkeypatch.setattr(phrases, "GROUP", group)
    draw = random.Random(4)
    words = ["the"] * 12 + [f"w{i}" for i in range(9)] + ["É", "日本", "A\0b"]
    rows = [("".join(draw.choice(words) + draw.choice([" ", "  ", "\t", " ", ". ", "\n", ",", " The "]) for _ in range(draw.randrange(60))), draw.choice(["en", "de", None, ""])) for _ in range(160)]
    rows += [(None, "en"), ("", None), ("same line here\n" * 30, "en"), ("same line here\n" * 30, "en")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(parts)
    assert rows_of(phrases.collocations(df, longest=longest, top=40)) == brute(rows, longest, top=40)


def test_edges(spark, odd, none, long_texts):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert rows_of(phrases.collocations(odd, least=2)) == brute(rows, least=2)
    assert phrases.collocations(none).count() == 0
    df = spark.createDataFrame([(t, "en") for t in long_texts], "text string, lang string")
    assert rows_of(phrases.collocations(df)) == brute([(t, "en") for t in long_texts])


def test_bitmap_tells_what_is_frequent(spark):
    """The bits of Spark's hashes are those that the tasks look at, at both ends as well."""
    rows = [(lang, f"w{i}é") for lang in ("en", "und", "") for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, word string")
    bits = phrases._bitmap(df)
    for lang in ("en", "und", ""):
        words = [w.encode() for g, w in rows if g == lang]
        h, cell = phrases._cells(lang, words)
        assert bits[cell].all()
        spark_h = [r[0] for r in df.where(F.col("lang") == lang).select(F.xxhash64("lang", "word")).collect()]
        assert sorted(h.tolist()) == sorted(spark_h)
    assert 1100 <= bits.sum() <= 1200 and len(bits) == phrases.BITS and bits.dtype == np.bool_


def test_products_past_64_bits(spark):
    """Counts as they come from very large tables."""
    rows = spark.createDataFrame([(3_000_000_000, 4_000_000_000, 5_000_000_001)], "a long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(14,0)")
    got = rows.select((F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")).alias("u"), (wide("l") * wide("r")).alias("d")).select(F.expr("u div d")).first()[0]
    assert got == 1_000_000 * 3_000_000_000**2 // (4_000_000_000 * 5_000_000_001)
