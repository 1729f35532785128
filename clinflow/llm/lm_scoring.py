"""Language-model scoring: a causal self-attention model in numpy over subword ids, and a unigram base.

Texts are lower-cased (A-Z) words (runs without ASCII white space) and an end. Subwords are the
byte-level BPE ids of each word with a space before it. Counts cover every training document: words, and
pairs of successive subwords, across words and with the text's beginning and end, are distributed tables that
grow with the corpus.

The model has SYMBOLS symbols: the most frequent subwords, the end, and one for all rarer subwords. A next symbol's probability is a two-level
softmax (class, then symbol in the class) over logits that are the corpus's smoothed pair
log-probabilities plus the output of one causal attention layer with relative positions. Attention sees
the CONTEXT symbols before a window and the window itself; windows advance by STRIDE, so each token is
scored once, with at least CONTEXT symbols before it where the document has them. The attention weights are
trained by Adam in numpy over all training documents: in each of ROUNDS rounds groups of documents, which are
set by hashes of their ids and not by partitions, train beside each other, every window once, and the weights are averaged by windows. Small corpora are
passed several times, until about LEAST_STEPS steps.

The score is that of the whole vocabulary: inside the rare symbol, after subword a, a subword b has
p(b | a, rare) = (count(a, b) + TRUST * share(b)) / (rare count(a) + TRUST), where share is its smoothed share of
all rare subwords. Every task knows up to KNOWN_PAIRS frequent pairs; all others are looked up by a join.

Null texts are empty: an empty document is its end token. Repeated rows are scored each for itself.
Without training documents all counts are 0 and every subword is equally rare. Other columns are ignored.
"""

from __future__ import annotations

import copy
import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from clinflow.llm import hashing, pieces
from clinflow.llm.pieces import PieceEncoder, as_bytes, groups, ragged, rest
from clinflow.shared import materialise

CLASSES = 32
SYMBOLS = CLASSES * CLASSES
WIDTH, CONTEXT, STRIDE = 16, 16, 32
SPAN = CONTEXT + STRIDE
#: Subword ids of the tokenizer file; the last is the end's.
IDS = 50_257
END_ID = IDS - 1
#: Words whose counts every task knows; all other words are looked up by a join.
KNOWN_WORDS = 400_000
KNOWN_PAIRS, TRUST = 500_000, 30.0
#: Ids handled at once.
TOKENS_AT_ONCE = 1 << 20
#: Words of groups of texts that are held before they are encoded and summed together, words sent on at once.
WORDS_HELD, WORDS_AT_ONCE = 800_000, 100_000
#: White space outside ASCII, in UTF-8: after it a space does not begin a new piece.
_ODD_ENDS = np.array([int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"])
#: Tokens whose pairs are held before they are summed.
PAIRS_AT_ONCE = 1 << 21
TRAIN_STEPS, BATCH_WINDOWS = 900, 128
#: Averagings in a pass over the training documents; steps that small corpora are trained for, in more passes.
ROUNDS, LEAST_STEPS = 4, 450
#: Documents that one copy of the model is trained on in a round.
GROUP_DOCS = 1_500
#: Weights in a row when they are averaged.
CHUNK = 1 << 12
SMOOTH = 30.0
#: Windows scored at once.
AT_ONCE = 256


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All lower-cased words as a dictionary array, and the n + 1 offsets of the texts' words."""
    n = len(data)
    if not n:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), 0, [None, pa.py_buffer(np.zeros(1, np.int64)), pa.py_buffer(b"")]).dictionary_encode(), np.zeros(len(offsets), np.int64)
    inside = ~hashing._SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    b = np.flatnonzero(begins)
    kept = np.ascontiguousarray(hashing._LOWER[data[inside]])
    bounds = np.append(np.cumsum(inside, dtype=np.int32 if n < 1 << 31 else np.int64)[b] - 1, len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return words.dictionary_encode(), np.searchsorted(b, offsets)


def encoded(docs: DataFrame, held_out: Column, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _id, held_out, n_words and ids (little-endian 16-bit, as binary); and rows of word (binary; empty for the end), n, sums over documents outside held_out.

    Every later pass reads the ids, so that a text is split and encoded once.
    """
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_words", pa.int64()), ("ids", pa.binary()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.encoder(tokenizer, special=False)

        def rows(batch: pa.RecordBatch, split: list[tuple[int, int, pa.DictionaryArray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            every = pa.concat_arrays([words.dictionary for *_, words, _ in split]).dictionary_encode()
            table, own, begin = subwords(encoder, every.dictionary), every.indices.to_numpy(), 0
            sums, ends = np.zeros(len(every.dictionary), np.int64), 0
            for lo, hi, words, word_at in split:
                n, held = hi - lo, batch.column(1).slice(lo, hi - lo)
                places = np.take(own[begin : begin + len(words.dictionary)], words.indices.to_numpy())
                begin += len(words.dictionary)
                taught = ~held.to_numpy(zero_copy_only=False).astype(bool)
                sums += np.bincount(places[np.repeat(taught, np.diff(word_at))], minlength=len(sums))
                ends += int(taught.sum())
                ids, at = _gathered(*table, places, word_at)
                flat = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
                cols = [batch.column(0).slice(lo, n), held, pa.array(np.diff(word_at)), flat, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            seen = np.flatnonzero(sums)
            word, n = pa.concat_arrays([every.dictionary.take(pa.array(seen)), pa.array([b""], pa.large_binary())]), np.append(sums[seen], ends)
            for lo in range(0, len(seen) + (ends > 0), WORDS_AT_ONCE):
                part = slice(lo, min(lo + WORDS_AT_ONCE, len(seen) + (ends > 0)))
                nulls = [pa.nulls(part.stop - lo, f.type) for f in list(schema)[:4]]
                yield pa.record_batch([*nulls, word[part].cast(pa.binary()), pa.array(n[part])], schema=schema)

        for batch in batches:
            data, offsets = as_bytes(batch.column(2))
            split = []
            for lo, hi in groups(offsets):
                split.append((lo, hi, *split_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])))
                if hi == len(batch) or sum(len(words.dictionary) for *_, words, _ in split) > WORDS_HELD:
                    yield from rows(batch, split)
                    split = []
        rest()

    wanted = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text_col).alias("_text"))
    return wanted.mapInArrow(run, f"_id {kind.simpleString()}, held_out boolean, n_words long, ids binary, word binary, n long")


def word_counts(rows: DataFrame) -> DataFrame:
    """word (binary; empty for the end), n: over all documents of `encoded` outside held_out."""
    return rows.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))


def as_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents of a batch of `encoded`, and the n + 1 offsets of theirs."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    raw = column.buffers()[2]
    ids = np.frombuffer(raw, "<u2", raw.size // 2) if raw is not None else np.zeros(0, "<u2")
    return ids[at[0] : at[-1]], at - at[0]


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all subwords one after another, where each begins, its length."""
    of = {i: b for b, i in pieces._byte_ranks(Tokenizer.from_file(path)).items()}
    size = np.array([len(of.get(i, b"")) for i in range(IDS)])
    return np.frombuffer(b"".join(of.get(i, b"") for i in range(IDS)), np.uint8), np.cumsum(size) - size, size


def words_of(ids: np.ndarray, at: np.ndarray, tokenizer: str) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words that `encode_words` has encoded as ids, as `split_words` gives them: each begins at a subword with a space before it."""
    flat, first, size = _vocabulary(tokenizer)
    ids = ids.astype(np.int64)
    data = flat[ragged(first[ids], size[ids])]
    ends = np.concatenate([[0], np.cumsum(size[ids])])
    begins = data == 32
    b = np.flatnonzero(begins)
    kept = np.ascontiguousarray(data[~begins])
    bounds = np.append(b - np.arange(len(b)), len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return words.dictionary_encode(), np.searchsorted(b, ends[at])


def followers(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pair (a * IDS + b) of each id b, and of each text's end, with the id a before it; a text begins after END_ID."""
    n = len(at) - 1
    ends = at[1:] + np.arange(n)
    b = np.full(len(ids) + n, END_ID, np.int64)
    inside = np.ones(len(b), bool)
    inside[ends] = False
    b[inside] = ids
    a = np.empty_like(b)
    a[1:] = b[:-1]
    a[at[:-1] + np.arange(n)] = END_ID
    return a * IDS + b


def follower_counts(rows: DataFrame) -> DataFrame:
    """pair (see `followers`), n: over all documents of `encoded` outside held_out, across words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pa.record_batch({"pair": pa.array(pair, pa.int64()), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            ids, at = as_ids(batch.column(0))
            for lo, hi in groups(at, TOKENS_AT_ONCE):
                held.append(followers(ids[at[lo] : at[hi]].astype(np.int64), at[lo : hi + 1] - at[lo]))
                if sum(map(len, held)) > PAIRS_AT_ONCE:
                    yield summed()
        yield summed()
        rest()

    return taught(rows).select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def taught(rows: DataFrame) -> DataFrame:
    """The documents of `encoded` that may be learnt from."""
    return rows.where("not held_out")


def rare_pairs(pairs: DataFrame, model: Model) -> DataFrame:
    """Those of `follower_counts` whose second id is in the rare symbol."""
    return pairs.where(~(F.col("pair") % IDS).isin(np.flatnonzero(~model.is_rare()).tolist()))  # SYMBOLS - 1 ids are not


def known_pairs(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs with their counts, those above a count that leaves at most KNOWN_PAIRS, and the counts of all ids as the first of a pair."""
    got = table.where(F.col("n") >= _least(table, KNOWN_PAIRS)).toArrow()
    pair, n = (got.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    ones = table.groupBy(F.floor(F.col("pair") / IDS).cast("int").alias("a")).agg(F.sum("n").alias("n")).toArrow()  # at most IDS rows
    before = np.zeros(IDS)
    before[ones.column("a").to_numpy()] = ones.column("n").to_numpy()
    return pair[order], n[order].astype(np.float64), before


@dataclass
class Model:
    """symbol: of each subword id; rare: log share of an id inside the rare symbol; pair, head: log-probabilities of symbols in their class and of classes, by the symbol before."""

    symbol: np.ndarray
    rare: np.ndarray
    end: int
    pair: np.ndarray
    head: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    own: np.ndarray
    place: np.ndarray
    to_class: np.ndarray
    to_symbol: np.ndarray

    LEARNT = ("query", "key", "value", "own", "place", "to_class", "to_symbol")

    def is_rare(self) -> np.ndarray:
        """Of each subword id: whether it is in the rare symbol."""
        return self.rare < 0

    @functools.cached_property
    def lowest(self) -> float:
        """The least log-probability of the counts."""
        return float(min(self.pair.min(), self.head.min()))

    def steep(self) -> bool:
        """Whether attention's scores or the logits may be beyond 60 either way, so that exponentials need a shift; states are between -1 and 1."""
        q, k = (math.sqrt(np.einsum("ij,ij->i", w, w).max()) for w in (self.query, self.key))
        return bool(q * k / math.sqrt(WIDTH) + np.abs(self.place).max() > 60 or max(np.abs(w).sum(1).max() for w in (self.to_class, self.to_symbol)) - self.lowest > 60)

    def attend(self, x: np.ndarray, real: np.ndarray, steep: bool) -> tuple:
        """States of the last STRIDE places of each window, and what they come from: attention weights, one over their sums, mean values, scaled queries, keys, values.

        real: False where a window reaches back over the document's start. Weights are left undivided, as the sums divide the narrower values.
        """
        last = x[:, CONTEXT:]
        q, k, v = np.take(self.query * np.float32(1 / math.sqrt(WIDTH)), last, 0), np.take(self.key, x, 0), np.take(self.value, x, 0)
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += _relative(self.place)
        short = np.flatnonzero(~real[:, 0])
        if len(short):
            a[short] += np.where(real[short], np.float32(0), np.float32(-1e9))[:, None, :]
        a, over = _weights(a, steep)
        mean = np.matmul(a, v)
        mean *= over
        h = np.take(self.own, last, 0)
        h += mean
        return np.tanh(h, out=h), a, over, mean, q, k, v

    def logits(self, h: np.ndarray, before: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Class logits, logits of the symbols of the row's class cls, and the bounds of the classes' rows; the rows are sorted by class."""
        top = h @ self.to_class.T
        top += np.take(self.head, before, 0)
        bounds = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        members, low = self.to_symbol.reshape(CLASSES, CLASSES, WIDTH), np.empty((len(cls), CLASSES), np.float32)
        for c, (i, j) in enumerate(itertools.pairwise(bounds)):
            if i < j:
                np.matmul(h[i:j], members[c].T, out=low[i:j])
        low += np.take(self.pair.reshape(SYMBOLS * CLASSES, CLASSES), before * CLASSES + cls, 0)
        return top, low, bounds

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, steep: bool | None = None) -> np.ndarray:
        """Natural log-probability of each symbol y after the windows x."""
        steep = self.steep() if steep is None else steep
        h = self.attend(x, real, steep)[0].reshape(-1, WIDTH)
        y = y.ravel()
        order = np.argsort((y // CLASSES).astype(np.uint8), kind="stable")
        y = y[order]
        top, low, _ = self.logits(np.take(h, order, 0), x[:, CONTEXT:].ravel()[order], y // CLASSES)
        cls, i, out = y // CLASSES, np.arange(0, CLASSES * len(y), CLASSES), np.empty(len(y))
        hit = np.take(top.ravel(), i + cls) + np.take(low.ravel(), i + (y - CLASSES * cls))
        out[order] = hit - _logsum(top, low, steep)
        return out

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text: its ids, then the end."""
        sizes = np.diff(at) + 1
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.each(ids, at), len(sizes)) / math.log(10)

    def each(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log-probability of each id and of each text's end, text after text."""
        n = len(at) - 1
        sizes = np.diff(at) + 1
        starts = at[:-1] + np.arange(n)  # in the stream of texts with their ends
        y = np.full(len(ids) + n, self.end, np.int64)
        rare = np.zeros(len(y))
        inside = np.ones(len(y), bool)
        inside[starts + sizes - 1] = False
        y[inside] = self.symbol[ids]
        rare[inside] = self.rare[ids]
        x = np.full(CONTEXT + len(y) + STRIDE, self.end, np.int64)  # windows reach over both ends of the texts
        x[CONTEXT + 1 : CONTEXT + len(y)] = y[:-1]
        x[CONTEXT + starts] = self.end
        y = np.concatenate([y, np.full(STRIDE, self.end)])
        windows = -(-sizes // STRIDE)
        whose = np.repeat(np.arange(n), windows)
        offset = STRIDE * ragged(np.zeros(n, np.int64), windows)
        out, steep = rare, self.steep()
        for lo in range(0, len(whose), AT_ONCE):
            w, o = whose[lo : lo + AT_ONCE], offset[lo : lo + AT_ONCE]
            place = o[:, None] + np.arange(-CONTEXT, STRIDE)
            p = (starts[w] + o)[:, None] + np.arange(SPAN)  # in x, and of what follows CONTEXT places earlier in y
            got = self.log_probabilities(np.take(x, p), np.take(y, p[:, :STRIDE]), place >= 0, steep).reshape(-1, STRIDE)
            own = place[:, CONTEXT:] < sizes[w][:, None]
            out[p[:, :STRIDE][own]] += got[own]
        return out


def _relative(place: np.ndarray) -> np.ndarray:
    """Biases by distance, and no sight of later places."""
    distance = np.arange(CONTEXT, SPAN)[:, None] - np.arange(SPAN)[None, :]
    return np.where(distance >= 0, place[np.clip(distance, 0, SPAN - 1)], np.float32(-1e9)).astype(np.float32)


def _weights(a: np.ndarray, steep: bool) -> tuple[np.ndarray, np.ndarray]:
    """Undivided attention weights of the scores a (windows x STRIDE x SPAN), in place, and one over each row's sum. Masked scores are far below zero; every row sees its own place, so rows are shifted only where a score may be extreme."""
    if steep and a.size:
        a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    return a, 1 / np.matmul(a, np.ones((SPAN, 1), np.float32))


def _logsum(x: np.ndarray, y: np.ndarray, steep: bool) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row of x, times that of y, in double precision; both are overwritten."""
    shift, sums = 0.0, np.ones(len(x))
    for z in (x, y):
        if steep and z.size:
            most = z.max(1)
            z -= most[:, None]
            shift = shift + most.astype(np.float64)
        np.exp(z, out=z)
        sums *= z @ np.ones(z.shape[1], np.float32)
    return np.log(sums) + shift


def _softmax(x: np.ndarray, scale: np.float32, steep: bool) -> np.ndarray:
    """The softmax of each row times scale, in place."""
    if steep and x.size:
        x -= x.max(1)[:, None]
    np.exp(x, out=x)
    x *= scale / (x @ np.ones((x.shape[1], 1), np.float32))
    return x


def _classes(p: np.ndarray) -> np.ndarray:
    """Order of symbols in which classes are runs: halved again and again along the main direction of how they follow others."""
    x = np.sqrt(p.T / p.sum(0)[:, None])
    parts = [np.arange(SYMBOLS)]
    while len(parts) < CLASSES:
        halves = []
        for part in parts:
            own = x[part] - x[part].mean(0)
            v = np.ones(own.shape[1]) / math.sqrt(own.shape[1]) + 1e-3 * np.cos(np.arange(own.shape[1]))
            for _ in range(12):
                v = own.T @ (own @ v)
                v /= np.linalg.norm(v) + 1e-12
            order = part[np.argsort(own @ v, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    return np.concatenate(parts)


def prior(pairs: DataFrame) -> Model:
    """The model before training of its attention: the counts of `follower_counts` only."""
    split = pairs.select(F.floor(F.col("pair") / IDS).cast("int").alias("a"), (F.col("pair") % IDS).cast("int").alias("b"), "n")
    ones = split.groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # at most IDS rows
    counts = np.zeros(IDS)
    counts[ones.column("b").to_numpy()] = ones.column("n").to_numpy()
    order = np.argsort(-counts, kind="stable")
    top = order[order != END_ID][: SYMBOLS - 2]
    end, rare_symbol = SYMBOLS - 2, SYMBOLS - 1
    symbol = np.full(IDS, rare_symbol, np.int64)
    symbol[top] = np.arange(SYMBOLS - 2)
    symbol[END_ID] = end
    rare, outside = np.zeros(IDS), symbol == rare_symbol
    rare[outside] = np.log((counts[outside] + 0.5) / (counts[outside].sum() + 0.5 * outside.sum()))
    # a bounded table: SYMBOLS squared
    names = F.broadcast(pairs.sparkSession.createDataFrame([(int(i), int(symbol[i])) for i in [*top, END_ID]], "id int, s int"))
    mapped = split
    for side in ("a", "b"):
        mapped = mapped.join(names.select(F.col("id").alias(side), F.col("s").alias(f"s{side}")), side, "left")
    got = mapped.groupBy(*[F.coalesce(f"s{side}", F.lit(rare_symbol)).alias(f"s{side}") for side in "ab"]).agg(F.sum("n").alias("n")).toArrow()
    inner = np.zeros((SYMBOLS, SYMBOLS))
    inner[got.column("sa").to_numpy(), got.column("sb").to_numpy()] = got.column("n").to_numpy()
    del got, mapped
    ones = inner.sum(0) + 0.5
    p = inner + SMOOTH * (ones / ones.sum())
    p /= p.sum(1, keepdims=True)
    order = _classes(p * ones[:, None])
    renamed = np.empty(SYMBOLS, np.int64)
    renamed[order] = np.arange(SYMBOLS)
    p = p[order][:, order]
    head = p.reshape(SYMBOLS, CLASSES, CLASSES).sum(2)
    draw = np.random.default_rng(5)
    table = lambda scale: (scale * draw.standard_normal((SYMBOLS, WIDTH))).astype(np.float32)
    return Model(
        # rows one after another: a model whose rows are not is copied whole at every look-up
        renamed[symbol], rare, int(renamed[end]), *[np.ascontiguousarray(np.log(x), np.float32) for x in (p, head)], table(0.3), table(0.3), table(0.3), table(0.3),
        np.zeros(SPAN, np.float32), np.zeros((CLASSES, WIDTH), np.float32), np.zeros((SYMBOLS, WIDTH), np.float32),
    )


#: Places of a symbol's row in a table of complex numbers, each of which is two neighbouring columns: adding them takes half the time.
_PAIRS = WIDTH // 2 * np.arange(SYMBOLS)[:, None] + np.arange(WIDTH // 2)


def _sum_rows(rows: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
    """Sums of rows by symbol; places: of `_PAIRS` of each row."""
    out[...] = 0
    np.add.at(out.reshape(-1).view(np.complex64), places.reshape(-1), rows.view(np.complex64).reshape(-1))


class Adam:
    """The learnt weights as one array, of which the model's are views, and their moments."""

    def __init__(self, model: Model, state: dict):
        self.at = np.cumsum([0, *[getattr(model, k).size for k in Model.LEARNT]])
        self.w = np.concatenate([getattr(model, k).ravel() for k in Model.LEARNT])
        for k, w in self._views(model, self.w).items():
            setattr(model, k, w)
        self.m, self.s = state.setdefault("moments", (np.zeros_like(self.w), np.zeros_like(self.w)))
        self.g = np.zeros_like(self.w)
        self.grads = self._views(model, self.g)
        self.held = np.empty_like(self.w), np.empty_like(self.w)

    def _views(self, model: Model, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: flat[a:b].reshape(getattr(model, k).shape) for k, a, b in zip(Model.LEARNT, self.at[:-1], self.at[1:], strict=True)}

    def step(self, size: float, t: int) -> None:
        """w -= size * (m / (1 - 0.9^t)) / (sqrt(s / (1 - 0.99^t)) + 1e-6)."""
        x, y = self.held
        np.subtract(self.g, self.m, out=x)
        x *= np.float32(0.1)
        self.m += x
        np.multiply(self.g, self.g, out=x)
        x -= self.s
        x *= np.float32(0.01)
        self.s += x
        np.divide(self.s, np.float32(1 - 0.99**t), out=x)
        np.sqrt(x, out=x)
        x += np.float32(1e-6)
        np.divide(self.m, np.float32(1 - 0.9**t), out=y)
        y *= np.float32(size)
        y /= x
        self.w -= y


def train(model: Model, ids: np.ndarray, at: np.ndarray, steps: int | None = TRAIN_STEPS, rate: float = 0.004, seed: int = 9, state: dict | None = None) -> Model:
    """Adam over windows of the texts with these ids, each window once before any comes again. No steps: one pass.

    state: kept from call to call (moments, t, windows); the rate then does not fall.
    """
    n = len(at) - 1
    if n < 1:
        return model
    first = at + 2 * np.arange(n + 1)  # each text between two ends
    flat = np.full(CONTEXT + len(ids) + 2 * n + SPAN, model.end, np.int64)  # windows reach over both ends of the texts
    inside = np.ones(len(ids) + 2 * n, bool)
    inside[first[:-1]] = inside[first[1:] - 1] = False
    flat[CONTEXT : CONTEXT + len(inside)][inside] = np.take(model.symbol, ids)
    counts = -(-(np.diff(first) - 1) // STRIDE)
    docs, offsets = np.repeat(np.arange(n), counts), STRIDE * ragged(np.zeros(n, np.int64), counts)
    draw = np.random.default_rng(seed)
    falls, state = state is None, {} if state is None else state
    adam = Adam(model, state)
    grads = adam.grads
    state["windows"] = state.get("windows", 0) + len(docs)
    begun = state.get("t", 0)
    steps = -(-len(docs) // BATCH_WINDOWS) if steps is None else steps
    state["t"] = begun + steps
    passes = np.concatenate([draw.permutation(len(docs)) for _ in range(-(-steps * BATCH_WINDOWS // len(docs)))]) if steps else ()
    distance = np.clip(np.arange(CONTEXT, SPAN)[:, None] - np.arange(SPAN)[None, :], 0, SPAN - 1).ravel()
    members = model.to_symbol.reshape(CLASSES, CLASSES, WIDTH)
    sizes, ahead, within = np.diff(first) - 1, np.arange(SPAN + 1), np.arange(-CONTEXT, STRIDE)
    for t in range(begun + 1, begun + steps + 1):
        chosen = passes[(t - begun - 1) * BATCH_WINDOWS : (t - begun) * BATCH_WINDOWS]
        d, o = docs[chosen], offsets[chosen]
        place = o[:, None] + within
        z = np.take(flat, (first[d] + o)[:, None] + ahead)
        x, y = z[:, :-1], z[:, CONTEXT + 1 :].ravel()
        if (t - begun) % 16 == 1:  # a step moves a weight by at most the rate
            steep = model.steep()
        h, a, over, mean, q, k, v = model.attend(x, place >= 0, steep)
        # rows sorted by the class of what follows, places after the text's end left out
        order = np.argsort((y // CLASSES).astype(np.uint8), kind="stable")
        order = order[(place[:, CONTEXT:] < sizes[d][:, None]).ravel()[order]]
        hs, y = np.take(h.reshape(-1, WIDTH), order, 0), y[order]
        cls = y // CLASSES
        top, low, bounds = model.logits(hs, x[:, CONTEXT:].ravel()[order], cls)
        i, scale = np.arange(0, CLASSES * len(y), CLASSES), np.float32(1 / len(y))
        for g, hit in ((top, cls), (low, y - CLASSES * cls)):
            _softmax(g, scale, steep).ravel()[i + hit] -= scale
        own, by_low = top @ model.to_class, np.empty_like(hs)
        np.matmul(top.T, hs, out=grads["to_class"])
        by_class = grads["to_symbol"].reshape(CLASSES, CLASSES, WIDTH)
        for c, (i, j) in enumerate(itertools.pairwise(bounds)):
            if i < j:
                np.matmul(low[i:j].T, hs[i:j], out=by_class[c])
                np.matmul(low[i:j], members[c], out=by_low[i:j])
            else:
                by_class[c] = 0
        own += by_low
        hs *= hs
        np.subtract(1, hs, out=hs)
        own *= hs
        dz = np.zeros(h.shape, np.float32)
        dz.reshape(-1, WIDTH)[order] = own
        through = dz * over  # the weights in a are not divided by their sums
        da = np.matmul(through, v.transpose(0, 2, 1))
        mean *= through
        da -= np.matmul(mean, np.ones((WIDTH, 1), np.float32))
        da *= a
        grads["place"][...] = np.bincount(distance, da.sum(0).ravel(), SPAN)
        all_pairs = np.take(_PAIRS, x, 0)
        last_pairs = np.ascontiguousarray(all_pairs[:, CONTEXT:])
        _sum_rows(dz, last_pairs, grads["own"])
        _sum_rows(np.matmul(da, k), last_pairs, grads["query"])
        grads["query"] *= np.float32(1 / math.sqrt(WIDTH))  # q is scaled already
        _sum_rows(np.matmul(da.transpose(0, 2, 1), q), all_pairs, grads["key"])
        _sum_rows(np.matmul(a.transpose(0, 2, 1), through), all_pairs, grads["value"])
        adam.step(rate * min(1.0, t / 50) * (1 - 0.9 * t / steps if falls else 1), t)
    return model


def train_round(rows: DataFrame, model: Model, rate: float) -> int:
    """Each group of about GROUP_DOCS documents (by hash, so the groups are those of the table, however it is dealt) trains a copy of the model on all its windows; the model gets the mean of their weights by windows. Returns the windows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    whole = -(-rows.count() // GROUP_DOCS)
    rows = rows.withColumn("group", F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(max(1, whole))))
    rows = rows.repartition("group").sortWithinPartitions("group", "_id", F.xxhash64("ids"))

    def weights(held: list[pa.RecordBatch]) -> tuple[int, np.ndarray | None]:
        own, state = copy.deepcopy(shared.value), {}
        ids, at = as_ids(pa.chunked_array([b.column(0) for b in held]).combine_chunks())
        for lo, hi in groups(at, TOKENS_AT_ONCE):
            train(own, ids[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], None, rate, 9 + state.get("t", 0), state)
        n = state.get("windows", 0)
        return n, np.concatenate([getattr(own, k).ravel() for k in Model.LEARNT]).astype(np.float64) * n if n else None

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, number = [], None
        for batch in batches:
            group = batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and group[i] != number:
                    yield held
                    held = []
                held.append(batch.slice(i, j - i))
                number = group[i]
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, flat = 0, None
        for held in by_group(batches):
            n, own = weights(held)
            if n:
                windows, flat = windows + n, own if flat is None else flat + own
        if windows:
            for i in range(0, len(flat), CHUNK):
                yield pa.record_batch({"chunk": pa.array([i // CHUNK], pa.int32()), "n": pa.array([windows], pa.int64()), "held": pa.array([flat[i : i + CHUNK].tobytes()], pa.binary())})
        rest()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        windows: Counter[int] = Counter()
        for batch in batches:
            for c, n, held in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                part = np.frombuffer(held, np.float64)
                sums[c] = sums[c] + part if c in sums else part
                windows[c] += n
        yield pa.record_batch({"chunk": pa.array(list(sums), pa.int32()), "n": pa.array([windows[c] for c in sums], pa.int64()), "held": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    kind = "chunk int, n long, held binary"
    got = sorted(rows.select("ids", "group").mapInArrow(run, kind).repartition("chunk").mapInArrow(total, kind).collect())
    shared.unpersist()
    if not got:
        return 0
    flat, at = np.concatenate([np.frombuffer(r["held"], np.float64) / r["n"] for r in got]), 0
    for k in Model.LEARNT:
        w = getattr(model, k)
        w[...] = flat[at : at + w.size].reshape(w.shape)
        at += w.size
    return got[0]["n"]


def learn(rows: DataFrame, pairs: DataFrame) -> Model:
    """Counts and attention from all training documents. rows: of `encoded`; pairs: their `follower_counts`."""
    rows = taught(rows)
    model = prior(pairs)
    done, windows = 0, 1
    while windows and done < LEAST_STEPS * BATCH_WINDOWS:
        windows = 0
        for r in range(ROUNDS):
            slice_ = rows.where(F.pmod(F.xxhash64(F.col("_id"), F.lit(17)), F.lit(ROUNDS)) == r)
            windows += train_round(slice_, model, 0.004 * (1 - 0.9 * min(1.0, (done + windows) / (LEAST_STEPS * BATCH_WINDOWS)) * r / ROUNDS))
        done += windows
    return model


def encode_words(encoder: PieceEncoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
    """ids, offsets of the texts' ids, words, offsets of the texts' words."""
    words, at = split_words(data, offsets)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), words, at
    return *_gathered(*subwords(encoder, words.dictionary), words.indices.to_numpy(), at), words, at


def _gathered(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words at these places of `subwords`, and the offsets of the texts' ids; at: of the texts' words."""
    size = np.take(sizes, places)
    return np.take(flat, ragged(np.take(first, places), size)), np.concatenate([[0], np.cumsum(size)])[at]


def subwords(encoder: PieceEncoder, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words with a space before each, where each word's begin, how many they are.

    Words are encoded in one call, as a space after any character but white space begins a new piece; words that end
    in white space outside ASCII, or in a control character, go through the tokenizer one by one.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    end = bounds[1:]
    three = sum(data[np.maximum(end - 1 - i, 0)].astype(np.int64) << 8 * i for i in range(3))
    last = three & 0xFF
    apart = (last < 0x21) | (last == 0x7F) | ((last >= 0x80) & (np.isin(three, _ODD_ENDS) | np.isin(three & 0xFFFF, _ODD_ENDS)))
    together = np.flatnonzero(~apart)
    size = np.zeros(n, np.int64)
    ids = np.zeros(0, np.int64)
    if len(together):
        length = np.diff(bounds)[together]
        ends = np.cumsum(length + 1)
        joined = np.full(int(ends[-1]), 32, np.uint8)
        inside = np.ones(len(joined), bool)
        inside[ends - length - 1] = False
        joined[inside] = data[bounds[0] : bounds[-1]] if len(together) == n else data[ragged(bounds[:-1][together], length)]
        try:
            ids = encoder.joined.encode_to_numpy(joined.tobytes().decode()).astype(np.int64)
            size[together] = np.diff(np.searchsorted(np.cumsum(encoder.bytes_of[ids]), ends) + 1, prepend=0)
        except UnicodeDecodeError:  # bytes that are no UTF-8 are replaced, which changes the lengths
            apart, together = np.ones(n, bool), together[:0]
    one = [encoder.tokenizer.encode((b" " + words[i].as_py()).decode("utf-8", "replace"), add_special_tokens=False).ids for i in np.flatnonzero(apart).tolist()]
    size[apart] = [len(x) for x in one]
    first = np.empty(n, np.int64)
    order = np.concatenate([together, np.flatnonzero(apart)])
    first[order] = np.cumsum(size[order]) - size[order]
    return np.concatenate([ids, np.array([i for x in one for i in x], np.int64)]), first, size


def known_words(words: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The most frequent words and their counts: those above a count that leaves at most KNOWN_WORDS, and the end."""
    got = words.where((F.col("n") >= _least(words, KNOWN_WORDS)) | (F.col("word") == F.lit(b""))).toArrow()
    return got.column("word").combine_chunks().cast(pa.large_binary()), got.column("n").to_numpy()


def _least(table: DataFrame, most: int) -> int:
    """A count n that at most `most` rows of the table reach; found over powers of the fourth root of two."""
    level = F.floor(F.log2("n") * 4).cast("int")
    least, so_far = 1 << 62, 0
    for r in sorted(table.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), reverse=True):
        so_far += r["k"]
        if so_far > most:
            break
        least = r["n"]
    return least


def score(docs: DataFrame, held_out: Column, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: true for documents that nothing is learnt from.
    """
    coded = materialise(encoded(docs, held_out, tokenizer, id_col, text_col))
    words = materialise(word_counts(coded))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pairs = materialise(follower_counts(coded))
    model = learn(coded, pairs)
    pairs = rare_pairs(pairs, model)
    whole = total + 0.5 * (distinct + 1)
    shared = docs.sparkSession.sparkContext.broadcast((model, *known_words(words), known_pairs(pairs)))
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("row", pa.int64()), ("_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("n", pa.int64()), ("pair", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, known_n, (often, often_n, before) = shared.value
        count_of = dict(zip(known.to_pylist(), known_n.tolist(), strict=True))
        row = TaskContext.get().partitionId() << 36
        ends = count_of.get(b"", 0)
        end_value = math.log10((ends + 0.5) / whole)
        nulls = lambda n, f: pa.nulls(n, schema.field(f).type)
        for batch in batches:
            all_ids, all_at = as_ids(batch.column(3))
            for lo, hi in groups(all_at, TOKENS_AT_ONCE):
                n = hi - lo
                ids, at = all_ids[all_at[lo] : all_at[hi]].astype(np.int64), all_at[lo : hi + 1] - all_at[lo]
                words, word_at = words_of(ids, at, tokenizer)
                counts = np.fromiter(map(count_of.get, words.dictionary.to_pylist(), itertools.repeat(-1)), np.int64, len(words.dictionary))[words.indices.to_numpy()]
                whose = np.repeat(np.arange(n), np.diff(word_at))
                found = counts >= 0
                base = np.bincount(whose[found], np.log10((counts[found] + 0.5) / whole), n) + end_value
                n_known = np.bincount(whose[found], minlength=n) + (ends > 0)
                own = row + np.arange(n)
                log_p, text = model.score(ids, at), np.repeat(np.arange(n), np.diff(at) + 1)
                pair = followers(ids, at)
                of_rare = np.flatnonzero(model.is_rare()[pair % IDS])
                pair, text = pair[of_rare], text[of_rare]
                share = model.rare[pair % IDS]
                p = TRUST * np.exp(share)
                place = np.minimum(np.searchsorted(often, pair), max(0, len(often) - 1))
                told = often[place] == pair if len(often) else np.zeros(len(pair), bool)
                part = -np.log10(before[pair // IDS] + TRUST) - share / math.log(10)
                part[told] += np.log10(often_n[place[told]] + p[told])
                log_p += np.bincount(text, part, n)
                cols = [pa.array(own), batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(np.diff(word_at) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(log_p), *[nulls(n, f) for f in ("word", "n", "pair", "p")]]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                if not found.all():
                    both, times = np.unique(whose[~found] * len(words.dictionary) + words.indices.to_numpy()[~found], return_counts=True)
                    named = words.dictionary.take(pa.array(both % len(words.dictionary))).cast(pa.binary())
                    m = len(both)
                    cols = [pa.array(own[both // len(words.dictionary)]), *[nulls(m, f) for f in ("_id", "held_out", "n_tokens", "n_known", "base", "score")], named, pa.array(times.astype(np.int64)), nulls(m, "pair"), nulls(m, "p")]
                    yield pa.record_batch([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                if not told.all():
                    m = int((~told).sum())
                    cols = [pa.array(own[text[~told]]), *[nulls(m, f) for f in ("_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "n")], pa.array(pair[~told]), pa.array(p[~told])]
                    yield pa.record_batch(cols, schema=schema)
                row += n
        rest()

    rows = coded.where("held_out is not null").select("_id", "held_out", "n_words", "ids").mapInArrow(run, f"row long, _id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, n long, pair long, p double")
    rows = materialise(rows)
    looked_up = rows.where("word is not null").select("row", "word", F.col("n").alias("times")).join(words, "word", "left")
    c = F.coalesce("n", F.lit(0))
    further = looked_up.groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(whole))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    rare = rows.where("pair is not null").select("row", "pair", "p").join(pairs, "pair", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.col("p"))).alias("more_score"))
    out = rows.where("word is null and pair is null").select("row", "_id", "held_out", "n_tokens", "n_known", "base", "score").join(further, "row", "left").join(rare, "row", "left")
    return out.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
