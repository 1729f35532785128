import re
from collections import Counter, defaultdict

import pytest

from clinflow.llm import divergence, queries
from tests.oracle import connect, same

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UNIT = 1_000_000_000


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, least=3, ranks=200):
    """rows: (text, lang, source)."""
    out, count, docs, groups = [], Counter(), defaultdict(set), defaultdict(set)
    for i, (t, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for w in TERM.findall(low(t)):
            count[lang, source, w] += 1
            docs[lang, w].add(i)
    for lang, sources in groups.items():
        kept = sorted(w for (g, w), d in docs.items() if g == lang and len(d) >= least)
        v = len(kept)
        n = {s: sum(count[lang, s, w] for w in kept) for s in sources}
        p = {s: {w: 1 + UNIT * (count[lang, s, w] + 1) // (n[s] + v) for w in kept} for s in sources}
        q = {w: 1 + UNIT * (sum(count[lang, s, w] for s in sources) + 1) // (sum(n.values()) + v) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if count[lang, s, w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                for r, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, r))
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_oracle(spark, tiny):
    same(spark, connect(tiny), queries.op11_source_divergence, queries.ORACLE_SQL["op11_source_divergence"], tiny)


@pytest.mark.parametrize("parts", [1, 7])
def test_edges(spark, odd, none, parts, monkeypatch):
    """Nulls, long texts, repeats, clashing names; groups of texts and cells small enough for several of each."""
    monkeypatch.setattr(divergence, "GROUP", 2_000)
    monkeypatch.setattr(divergence, "CELLS", 4)
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert rows_of(divergence.audit(odd.repartition(parts), least=2, ranks=5)) == brute(rows, 2, 5)
    assert divergence.audit(none).count() == 0


def test_languages_without_kept_terms(spark):
    rows = [("one", "x", "a"), ("two", "x", "b"), (None, "x", None), ("z z z", None, "c")]
    got = divergence.audit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string"))
    assert rows_of(got) == brute(rows) and {r["value"] for r in got.collect()} == {0}


def test_many_sources_and_ties(spark):
    rows = [(f"alpha beta{i % 7} Ünï{i % 3} gamma " * (1 + i % 4), "en" if i % 5 else "de", f"s{i % 9}") for i in range(200)] + [("alpha", "en", "s1")] * 40
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(5)
    assert rows_of(divergence.audit(df, ranks=3)) == brute(rows, 3, 3)


def test_long_texts(spark, long_texts):
    rows = [(t, "en", f"s{i}") for i, t in enumerate(long_texts * 3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    assert rows_of(divergence.audit(df)) == brute(rows)
