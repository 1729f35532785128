"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and digit or sign substitutions inside words to letters, and
turns every other character into a space. Lexicon entries are word beginnings; each match adds its
weight unless it lies in an exception phrase. The sum is normalised by the text's length and a
logistic curve over the sum, the number of matches and the normalised sum gives the score.

The lexicon is mined from labelled texts: word beginnings whose document rate among toxic texts is
many times that among others. Null and empty texts have no match and get the score of no match.
Repeated rows repeat their score. Texts whose label is null teach nothing; without labelled texts the
lexicon is empty. Very long texts are folded and matched whole, in time that grows as n log n. An empty
table gives an empty result. `score` ignores other columns, whatever their names; `without_toxic` keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that look like a letter, and what they fold to.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвпгαεορτυνικ", "aeopcyxijsdhkmtbnraeoptuvik", strict=True))
#: Digits and signs that stand for a letter inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a lexicon entry is harmless.
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "trash bins", "clown fish", "clownfish", "pond scum", "sore loser s"]
#: At most this many labelled texts of each class are learned from: those whose hashed id is smallest.
LEARN_ROWS = 3000
#: A beginning enters the lexicon from this many toxic texts on, and at this many times the rate among others.
LEAST_DOCS, LEAST_LIFT = 12, 25.0
LONGEST = 24
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_INNER = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|(?<![\w@$!])[@$0134578](?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")
_SUBSTITUTED = {ord(k): v for k, v in SUBSTITUTES.items()}


def fold(text: str) -> str:
    """Lower case, look-alikes as letters, all else as single spaces, with a space at both ends."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _INNER.sub(lambda m: m[0].translate(_SUBSTITUTED), text)
    return f" {_OTHER.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Weights of word beginnings, phrases that excuse a match, and the curve's coefficients."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    curve: tuple[float, float, float, float] = (-4.0, 1.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(" " + word, (weight, len(word)))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (0.0, -len(phrase)))
        found.make_automaton()
        return found

    def matches(self, folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
        """(start, end, weight) of matches that no exception phrase covers; of those at one start the heaviest."""
        if not len(automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        excused = []
        for end, (weight, n) in automaton.iter(folded):
            if n < 0:
                excused.append((end - (-n), end))
            elif (start := end - n + 1) not in best or best[start][1] < weight:
                best[start] = (end + 1, weight)
        if not excused:
            return [(s, e, w) for s, (e, w) in best.items()]
        # one sweep: the furthest end of the phrases that begin at or before a match
        out, far, waiting = [], -1, sorted(excused, reverse=True)
        for s in sorted(best):
            while waiting and waiting[-1][0] <= s:
                far = max(far, waiting.pop()[1])
            if s >= far:
                out.append((s, *best[s]))
        return out

    def features(self, folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float, float]:
        hits = self.matches(folded, automaton)
        total = sum(w for _, _, w in hits)
        return (math.log1p(total), min(6.0, len(hits)), math.log1p(1000 * total / (len(folded) + 200)))

    def score(self, features: tuple[float, float, float]) -> float:
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def mine(texts: list[str], labels: list[int], exceptions: list[str] | None = None) -> Lexicon:
    """A lexicon and its curve from labelled texts. Without texts of both classes the lexicon is empty."""
    exceptions = list(EXCEPTIONS) if exceptions is None else exceptions
    folded = [fold(t or "") for t in texts]
    n1, n0 = sum(labels), len(labels) - sum(labels)
    if not n1 or not n0:
        return Lexicon({}, exceptions)
    words = [set(f.split()) for f in folded]
    # by rising length: a beginning is looked at only where its own beginning is not yet settled
    least, lexicon = max(3, min(LEAST_DOCS, n1 // 20)), {}
    open_: set[str] | None = None
    for size in range(4, LONGEST + 1):
        toxic: Counter[str] = Counter()
        for ws, y in zip(words, labels, strict=True):
            if y:
                toxic.update({w[:size] for w in ws if len(w) >= size and (open_ is None or w[: size - 1] in open_)})
        open_ = {p for p, n in toxic.items() if n >= least}
        if not open_:
            break
        clean: Counter[str] = Counter()
        for ws, y in zip(words, labels, strict=True):
            if not y:
                clean.update({w[:size] for w in ws if w[:size] in open_ and len(w) >= size})
        for p in list(open_):
            lift = ((toxic[p] + 0.25) / n1) / ((clean[p] + 0.25) / n0)
            if lift >= LEAST_LIFT:
                lexicon[p] = math.log(lift)
                open_.discard(p)
    found = Lexicon(_longest(lexicon, words, labels), exceptions)
    automaton = found.automaton()
    x = np.array([[1.0, *found.features(f, automaton)] for f in folded])
    y = np.array(labels, float)
    w = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    beta = np.zeros(4)
    for _ in range(60):  # Newton steps for the penalised, class-balanced logistic curve
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 0.5 * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4), grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    found.curve = tuple(float(b) for b in beta)
    return found


def _longest(lexicon: dict[str, float], words: list[set[str]], labels: list[int]) -> dict[str, float]:
    """Each beginning lengthened as long as nearly all toxic words that have it share the next letter, so that no more than the entry is matched."""
    seen: dict[str, Counter[str]] = {p: Counter() for p in lexicon}
    for ws, y in zip(words, labels, strict=True):
        if y:
            for w in ws:
                for size in range(4, len(w) + 1):
                    if w[:size] in seen:
                        seen[w[:size]][w] += 1
    out = {}
    for p, at in seen.items():
        total, entry = sum(at.values()), p
        while len(entry) < LONGEST:
            following = Counter()
            for w, n in at.items():
                if w.startswith(entry):
                    following[w[len(entry) : len(entry) + 1]] += n
            letter, n = following.most_common(1)[0] if following else ("", 0)
            if not letter or n < 0.9 * total:
                break
            entry += letter
        out[entry] = max(lexicon[p], out.get(entry, 0.0))
    return out


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = LEARN_ROWS) -> Lexicon:
    """Lexicon from at most `rows` labelled texts of each class (the documented bound), chosen by hashed id."""
    got = []
    for label in (1, 0):
        part = labelled.where(F.col(label_col) == label).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
        first = part.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
        if first is not None:
            got += [(r["h"], label, r["t"]) for r in part.where(F.col("h") <= first).select("h", "t").toLocalIterator()]
    got.sort(key=lambda r: (r[0], r[1], r[2] or ""))
    return mine([t or "" for _, _, t in got], [y for _, y, _ in got])


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, score in 0..1, hits array<struct<entry, weight>> in the text's order."""

    hit = pa.struct([("entry", pa.string()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(1).to_pylist():
                folded = fold(text or "")
                found = sorted(lexicon.matches(folded, automaton))
                scores.append(lexicon.score(lexicon.features(folded, automaton)))
                hits.append([{"entry": folded[s:e], "weight": w} for s, e, w in found])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.list_(hit))], names=[id_col, "score", "hits"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double, hits array<struct<entry:string,weight:double>>")


def without_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, in all their columns and every repeated row, without those whose score reaches the threshold."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        automaton = lexicon.automaton()
        return pd.Series([lexicon.score(lexicon.features(fold(t or ""), automaton)) for t in texts], dtype="float64")

    return docs.where(scored(F.col(text_col)) < threshold)
