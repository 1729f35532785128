"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade > k) = sigmoid(score - threshold_k), with one score for all k and ordered thresholds. The score
is linear in the shares of hashed byte trigrams and word bigrams of the whole text and in its indicator
cells (repeated words, signs, capitals, digits, line lengths in steps). Trained by Adam on at most a
stated number of graded rows; the thresholds are a first one plus positive gaps.

A text's features come from that text alone, whatever stands beside it in a batch. Null texts are empty;
an empty text has its own cell. Very long texts are read whole, one group of their own. Rows whose grade is null teach nothing; without
graded rows every text gets equal chances. Repeated rows repeat their result. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clinflow.llm import hashing
from clinflow.llm.pieces import as_bytes, groups

#: Hashed cells of trigrams and of word pairs, and indicator cells after them.
CELLS, STEPS = 4096, 16
#: Fit on at most so many graded rows (of each grade), those with the smallest hashed id.
LEARN_ROWS = 1500
MEASURES = 6
WIDTH = 2 * CELLS + MEASURES * STEPS


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte trigrams and the n + 1 offsets of the texts' trigrams."""
    n = np.maximum(np.diff(offsets) - 2, 0)
    at = np.concatenate([[0], np.cumsum(n)])
    if not at[-1]:
        return np.zeros(0, np.int64), at
    x = data.astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    inside = np.ones(len(h), bool)
    for back in (2, 1):  # trigrams that cross into the next text
        cross = offsets[1:-1] - back
        inside[cross[(cross >= 0) & (cross < len(h))]] = False
    return (h[inside] & np.uint32(CELLS - 1)).astype(np.int64), at


def _shares(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(hit)])
    n = np.diff(offsets)
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1)


def _indicators(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indicator cell of each measure, one row a text."""
    twin = np.zeros(len(words), bool)
    twin[1:] = words[1:] == words[:-1]
    twin[at[:-1][at[:-1] < len(words)]] = False
    third = np.zeros(len(words), bool)
    third[2:] = words[2:] == words[:-2]
    for k in (0, 1):
        own = at[:-1][np.diff(at) > k] + k
        third[own] = False
    sign = _SIGN[data]
    measures = [
        _shares(twin, at) * 4,
        _shares(sign, offsets) * 8,
        _shares(_UPPER[data], offsets) * 2,
        _shares(_DIGIT[data], offsets) * 4,
        np.log1p(np.diff(at)) / 12,
        _shares(third, at) * 4,
    ]
    step = np.stack([np.minimum((m * STEPS).astype(np.int64), STEPS - 1) for m in measures], 1)
    return 2 * CELLS + np.arange(MEASURES) * STEPS + step


_SIGN, _UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[ord(c) for c in "#*$%&|<>!@^~=+_{}[]\\"]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True


#: Stands before a text's first word.
START = np.uint64(0x5851F42D4C957F2D)


def _parts(data: np.ndarray, offsets: np.ndarray):
    words, at = hashing.words(data, offsets)
    pair = np.zeros(0, np.int64)
    if len(words):
        with np.errstate(over="ignore"):
            before = np.roll(words, 1)
            before[at[:-1][np.diff(at) > 0]] = START  # a text's first word follows nothing of another text
            pair = (hashing.mixed(words * np.uint64(3) + before) & np.uint64(CELLS - 1)).astype(np.int64) + CELLS
    return _trigrams(data, offsets), (pair, at), _indicators(data, offsets, words, at)


def features(texts: list[str]) -> np.ndarray:
    """Dense rows of WIDTH features, for fitting; made group by group, so that little more than the rows is held."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    data, offsets = as_bytes(pa.array(texts, pa.large_string()))
    for lo, hi in groups(offsets, 1 << 19):
        (tri, a), (pair, b), cells = _parts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for i in range(hi - lo):
            for hit, at in ((tri, a), (pair, b)):
                own = hit[at[i] : at[i + 1]]
                if len(own):
                    out[lo + i] += np.bincount(own, minlength=WIDTH).astype(np.float32) * (SCALE / len(own))
            out[lo + i, cells[i]] = 1
    return out


#: Shares are multiplied by this, so that they are of the size of the indicators.
SCALE = 8.0


@dataclass
class Ordinal:
    """weights of the features and ordered thresholds; grades are 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        (tri, a), (pair, b), cells = _parts(data, offsets)
        out = self.weights[cells].sum(1)
        for hit, at in ((tri, a), (pair, b)):
            n = np.diff(at)
            out += SCALE * np.bincount(np.repeat(np.arange(len(n)), n), self.weights[hit], len(n)) / np.maximum(n, 1)
        return out

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -30, 30)))


def fit(texts: list[str], grades: list[int], levels: int, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> Ordinal:
    """Maximum likelihood of the cumulative-link model with balanced grades, by Adam over all rows."""
    if not texts or len(set(grades)) < 2:
        return Ordinal(np.zeros(WIDTH), np.arange(levels - 1, dtype=float))
    x, y = features(texts), np.asarray(grades)
    share = 1 / np.maximum(np.bincount(y, minlength=levels), 1)
    w = share[y] / share[y].sum()
    theta = np.zeros(WIDTH + levels - 1)
    theta[WIDTH] = -0.5
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([theta[WIDTH : WIDTH + 1], np.log1p(np.exp(theta[WIDTH + 1 :]))]))
        z = x @ theta[:WIDTH].astype(np.float32)
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30)))
        above = np.concatenate([np.ones((len(y), 1)), s, np.zeros((len(y), 1))], 1)
        i = np.arange(len(y))
        p = np.maximum(above[i, y] - above[i, y + 1], 1e-9)
        slope = above * (1 - above)
        gz = -w * (slope[i, y] - slope[i, y + 1]) / p
        gc = np.zeros((len(y), levels + 1))
        gc[i, y] += w * slope[i, y] / p
        gc[i, y + 1] -= w * slope[i, y + 1] / p
        gc = gc[:, 1:-1].sum(0)
        later = np.cumsum(gc[::-1])[::-1]
        gaps = later[1:] / (1 + np.exp(-theta[WIDTH + 1 :]))
        g = np.concatenate([x.T @ gz.astype(np.float32) + ridge * theta[:WIDTH], later[:1], gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cuts = np.cumsum(np.concatenate([theta[WIDTH : WIDTH + 1], np.log1p(np.exp(theta[WIDTH + 1 :]))]))
    return Ordinal(theta[:WIDTH], cuts)


def learn(graded: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", rows: int = LEARN_ROWS) -> Ordinal:
    """Fit on at most `rows` rows of each grade 0 .. levels - 1, those with the smallest hashed id."""
    got = []
    for g in range(levels):
        part = graded.where(F.col(grade_col) == g).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("t"))
        last = part.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
        if last is not None:
            got += [(r["h"], g, r["t"] or "") for r in part.where(F.col("h") <= last).toLocalIterator()]
    got.sort()
    return fit([t for _, _, t in got], [g for _, g, _ in got], levels)


def grade(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, expected_grade, tails array<double> with P(grade > k) for each k."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in groups(offsets):
                tails = model.tails(model.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).cast(to_arrow_type(kind)), pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64()))], names=["_id", "expected_grade", "tails"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind.simpleString()}, expected_grade double, tails array<double>").withColumnRenamed("_id", id_col)
