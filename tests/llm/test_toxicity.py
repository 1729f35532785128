import math
import time

import pytest

from clinflow.llm import queries, toxicity


def test_fold():
    assert toxicity.fold("You 1D10T, sсum \u0456di\u043et!") == " you idiot scum idiot "
    assert toxicity.fold("m0r0n $cum tr@sh") == " moron scum trash "


def test_exceptions_and_weights():
    lex = toxicity.Lexicon({"trash": 3.0, "clown": 3.0})
    a = lex.automaton()
    assert [w for *_, w in lex.matches(toxicity.fold("Trash! the trash can, a clown."), a)] == [3.0, 3.0]
    assert lex.matches(toxicity.fold("retrash"), a) == []


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.85 and (clean.predicted == 0).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_edges(spark, odd, none):
    lex = toxicity.mine(["bad " + w for w in ("scummy you", "scummy he", "scummy x") * 10] + ["good day you"] * 30, [1] * 30 + [0] * 30)
    assert any(w.startswith("scum") for w in lex.weights)
    got = toxicity.score(odd, lex)
    assert got.count() == odd.count() and got.where("score is null").count() == 0 and toxicity.score(none, lex).count() == 0
    assert toxicity.without_toxic(odd, lex).columns == odd.columns
    empty = toxicity.learn(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert empty.weights == {} and 0 < toxicity.score(odd, empty).first()["score"] < 1


def test_scores_equal_a_plain_search(docs):
    """The automaton's matches, exceptions and score against a search of every entry at every place."""
    lexicon = toxicity.Lexicon({"trash": 2.0, "pathe": 1.5, "pathetic": 3.0, "ere": 0.5}, ["trash can", "ere the"], (-1.0, 0.7, 0.2, 0.4))
    automaton = lexicon.automaton()
    for text in [r["text"] or "" for r in docs.collect()] + ["", "Trash can tr4sh, PATHETIC trash cans", "trash trash can"]:
        folded = toxicity.fold(text)
        excused = [(i, i + len(p) + 1) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
        hits = {}
        for i in range(len(folded)):
            for w, x in lexicon.weights.items():
                if folded.startswith(" " + w, i) and not any(a <= i + 1 < b for a, b in excused) and (i not in hits or hits[i][1] < x):
                    hits[i] = (i + 1 + len(w), x)
        wanted = sorted((i + 1, e, x) for i, (e, x) in hits.items())
        assert sorted(lexicon.matches(folded, automaton)) == wanted, text
        total = sum(x for _, _, x in wanted)
        z = -1.0 + 0.7 * math.log1p(total) + 0.2 * min(6, len(wanted)) + 0.4 * math.log1p(1000 * total / (len(folded) + 200))
        assert lexicon.score(lexicon.features(folded, automaton)) == pytest.approx(1 / (1 + math.exp(-z)))


def test_long_texts_take_linear_time(long_texts):
    lexicon = toxicity.Lexicon({"trash": 2.0, "pathetic": 3.0}, ["trash can"])
    automaton = lexicon.automaton()
    for text in long_texts:
        began = time.perf_counter()
        lexicon.features(toxicity.fold(text), automaton)
        assert time.perf_counter() - began < 4
