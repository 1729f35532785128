"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (A-Z lower-cased); a text of one to four words has one shingle, an
empty or null text none and so no duplicates. A shingle weighs (1 + ln tf) * idf. Document frequencies
are counted over all documents in 2^19 hashed cells; idf falls from 1 + SPAN for shingles in at most
one of RARE documents to 1 for those in all, so no shingle counts for nothing.

Improved consistent weighted sampling draws SAMPLES samples of each document; its gamma and uniform
draws come from a table of 65,536 triples that a hash of (shingle, sample) indexes, and weights are
levels of five per cent. Bands of the samples propose pairs: every member of a bucket with the bucket's
heads, of which there are a fixed number, so the pairs grow with the members and not with their square. The
first head is the member that meets most others over all its buckets: the original among its edited copies.
Proposed pairs are verified by the exact weighted Jaccard similarity. A second round proposes pairs
with further heads only between documents that are not yet in one class. A last round takes all other
pairs of a bucket whose documents are still not in one class, block against block, so that every pair
of a bucket ends in one class or is found to be below SIMILAR. Texts with equal
shingles are one node throughout, and joins on a hot node or bucket go by broadcast of that one row.

Every row of the input gets its class, repeated rows too; other columns are ignored by `classes` and
carried by `representatives`. Rows with a null id take part; a class of nothing else has a null class_id and all its rows are
kept. Ties of samples are broken by the shingle. Very long texts are shingled whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clinflow.llm import hashing
from clinflow.llm.pieces import as_bytes, groups, ragged, rest
from clinflow.shared import arrow_rows, join_hot, materialise

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 13, 3
SAMPLES = BANDS * ROWS
CELLS, CHUNK = 1 << 19, 1 << 10
#: A shingle in at most one of RARE documents has the largest idf, 1 + SPAN.
RARE, SPAN = 256, 0.5
#: Weight levels: exp(0.05 * level).
LEVELS, STEP = 80, 0.05
#: Heads of a bucket: first round, second round.
HEADS = 4
HOT = 0.005
#: Members of a block of the last round, on average.
BLOCK = 256
#: Bytes of text handled at once; a longer text is handled whole.
GROUP = 1_000_000
#: Rows that go to a worker at once; executor and worker each hold them, some of their columns more than once.
BATCH_ROWS = 1_000


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles, text after text, and the n + 1 offsets of the texts' shingles."""
    h, at = hashing.words(data, offsets)
    n = np.diff(at)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    if not count.sum():
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = ragged(at[:-1], count)
    last = np.repeat(at[1:], count)
    with np.errstate(over="ignore"):
        s = np.zeros(len(first), np.uint64)
        for j in range(SHINGLE):
            word = h[np.minimum(first + j, len(h) - 1)]
            s = (s * np.uint64(0xD6E8FEB86659FD93)) + np.where(first + j < last, word, np.uint64(0x632BE59BD9B4E019))
        s = hashing.mixed(s)
    return s, np.concatenate([[0], np.cumsum(count)])


def distinct(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each text once, in order, their counts, and the n + 1 offsets."""
    whose = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((s, whose))
    s, whose = s[order], whose[order]
    if not len(s):
        return s, np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (whose[1:] != whose[:-1])
    b = np.flatnonzero(new)
    return s[b], np.diff(np.append(b, len(s))), np.searchsorted(whose[b], np.arange(len(at)))


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(45)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents per hashed cell, over all documents, and the number of documents. The table has 2^19 numbers at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            data, offsets = as_bytes(batch.column(0))
            for lo, hi in groups(offsets, GROUP):
                s, _, _ = distinct(*shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                held += np.bincount(_cells(s), minlength=CELLS)
            n += batch.num_rows
        if n:
            yield pa.record_batch({"chunk": pa.array([-1], pa.int32()), "held": pa.array([np.array([n], np.int64).tobytes()], pa.binary())})
            for i in range(0, CELLS, CHUNK):
                part = held[i : i + CHUNK]
                part = part.astype(np.uint16 if part.max() < 1 << 16 else np.uint32 if part.max() < 1 << 32 else np.int64)
                yield pa.record_batch({"chunk": pa.array([i // CHUNK], pa.int32()), "held": pa.array([part.tobytes()], pa.binary())})
        rest()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width = 1 if c < 0 else CHUNK
                part = np.frombuffer(held, {2: np.uint16, 4: np.uint32, 8: np.int64}[len(held) // width]).astype(np.int64)
                sums[c] = sums[c] + part if c in sums else part
        yield pa.record_batch({"chunk": pa.array(list(sums), pa.int32()), "held": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    parts = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "chunk int, held binary")
    # a task holds the running sums of its chunks and no more
    rows = parts.repartition("chunk").mapInArrow(total, "chunk int, held binary").collect()
    held, n = np.zeros(CELLS, np.int64), 0
    for c, x in rows:
        x = np.frombuffer(x, np.int64)
        if c < 0:
            n += int(x[0])
        else:
            held[c * CHUNK : (c + 1) * CHUNK] += x
    return held, n


def idf_levels(held: np.ndarray, n: int) -> np.ndarray:
    """Level of each cell's idf."""
    share = np.clip(held / max(1, n), 1 / RARE, 1.0)
    return np.rint(np.log(1 + SPAN * np.log(1 / share) / np.log(RARE)) / STEP).astype(np.uint8)


def levels(s: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Level of each shingle's weight."""
    return np.minimum(idf[_cells(s)] + np.rint(np.log(1 + np.log(tf)) / STEP).astype(np.int64), LEVELS - 1)


class Sampler:
    """Improved consistent weighted sampling with tabled draws. A sample is a 64-bit value that holds the shingle and its level of y."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        size = 1 << 16
        r, c, beta = draw.gamma(2, 1, size), draw.gamma(2, 1, size), draw.random(size)
        lnc, table = np.log(c), np.empty((LEVELS, size), np.uint64)
        for level in range(LEVELS):  # one at a time, as every temporary of all levels has the table's 42 MB
            t = np.floor(STEP * level / r + beta)
            lna = lnc - r * (t - beta) - r
            # ln a as 24 bits that sort alike; equal values tie-break by the shingle
            table[level] = np.clip((lna + 60) * (1 << 24) / 80, 0, (1 << 24) - 1)
        table <<= np.uint64(40)
        self.table = table.ravel()
        self.odd = draw.integers(1 << 62, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, s: np.ndarray, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Band values, one row per text that has shingles."""
        full = np.flatnonzero(np.diff(at))
        starts = at[full]
        low = s >> np.uint64(24)
        row = level.astype(np.int64) << 16
        out = np.zeros((len(full), BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(SAMPLES):
                i = ((s * self.odd[k]) >> np.uint64(48)).astype(np.int64)
                i += row
                got = np.minimum.reduceat(self.table[i] | low, starts)
                band = out[:, k // ROWS]
                band *= np.uint64(0xD6E8FEB86659FD93)
                band += hashing.mixed(got + np.uint64(k))
            out = hashing.mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64))
        return out


def _names(s: np.ndarray, tf: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128-bit hash of each text's shingles and their counts; None without shingles."""
    out: list[bytes | None] = [None] * (len(at) - 1)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        with np.errstate(over="ignore"):
            both = [np.add.reduceat(hashing.mixed(s * np.uint64(m) + tf.astype(np.uint64)), at[full]) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        for i, key in zip(full, np.stack(both, 1), strict=True):
            out[i] = key.tobytes()
    return out


def _nodes(docs: DataFrame, id_col: str, text_col: str, idf: np.ndarray) -> DataFrame:
    """_id, _node (128-bit hash of the weighted shingles, null without shingles), _bands."""
    id_type = docs.schema[id_col].dataType
    arrow = to_arrow_type(id_type)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)  # 2^19 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in groups(offsets, GROUP):
                s, tf, at = distinct(*shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                full, node, bands = np.flatnonzero(np.diff(at)), _names(s, tf, at), [None] * (hi - lo)
                if len(full):
                    got = sampler.bands(s, levels(s, tf, shared.value), at)
                    for j, i in enumerate(full):
                        bands[i] = got[j].view(np.int64)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).cast(arrow), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["_id", "_node", "_bands"])
        rest()

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {id_type.simpleString()}, _node binary, _bands array<long>")


def _features(docs: DataFrame, wanted: DataFrame, idf: np.ndarray) -> DataFrame:
    """_node, _s (sorted 32-bit shingle hashes), _w (levels) of the rows in `wanted` (_id, _node). Rows without an id are found by their node."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in groups(offsets, GROUP):
                s, tf, at = distinct(*shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                w, own = levels(s, tf, shared.value).astype(np.uint8), batch.column(0).slice(lo, hi - lo)
                names = _names(s, tf, at)
                asked = pa.array([a is not None and b in (None, a) for a, b in zip(names, own.to_pylist(), strict=True)], pa.bool_())  # an id may have several texts
                own = pa.array(names, pa.binary())
                s = (s >> np.uint64(32)).astype(np.uint32)  # the order stays
                yield pa.record_batch([own, pa.array([s[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()), pa.array([w[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["_node", "_s", "_w"]).filter(asked)
        rest()

    rows = docs.join(wanted, "_id").select("_node", "_text").union(docs.where("_id is null").select(F.lit(None).cast("binary"), "_text"))
    return rows.mapInArrow(run, "_node binary, _s binary, _w binary").join(wanted.select("_node"), "_node", "left_semi")


def weighted_jaccard(s: np.ndarray, w: np.ndarray, t: np.ndarray, v: np.ndarray) -> float:
    """Of two sorted lists of shingles with their levels."""
    if not len(s) or not len(t):
        return 0.0
    if len(s) > len(t):
        s, w, t, v = t, v, s, w
    a, b = _WEIGHT[w], _WEIGHT[v]
    i = np.minimum(np.searchsorted(t, s), len(t) - 1)
    both = t[i] == s
    least = np.minimum(a[both], b[i[both]]).sum()
    return float(least / (a.sum() + b.sum() - least))


_WEIGHT = np.exp(STEP * np.arange(256))


def _verified(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those of weighted Jaccard similarity SIMILAR or more. b is the head and may be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            good = [weighted_jaccard(np.frombuffer(s, np.uint32), np.frombuffer(w, np.uint8), np.frombuffer(t, np.uint32), np.frombuffer(v, np.uint8)) >= SIMILAR for s, w, t, v in zip(*cols[2:6], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(features.select(F.col("_node").alias("a"), F.col("_s").alias("s"), F.col("_w").alias("w")), "a")
    heads = materialise(pairs.groupBy("b").agg(F.count("*").alias("n")).join(features.select(F.col("_node").alias("b"), F.col("_s").alias("t"), F.col("_w").alias("v")), "b"))
    both = join_hot(left, heads, ["b"], "n", HOT, F.octet_length("t") + F.octet_length("v")).select("a", "b", "s", "w", "t", "v")
    return both.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, label (smallest node of its component) of all nodes with an edge (a, b): least neighbour label, then pointer jumping, until nothing changes."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("label", "m").alias("label"))
        lower = materialise(lower)
        jumped = lower.alias("l").join(lower.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"))
        jumped = materialise(jumped)
        changed = jumped.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        labels = jumped
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def _blocks(members: DataFrame, buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """key, i, j, side, _node, label: the blocks i and j of a bucket that are still to be compared.

    Members are the nodes of a bucket that are no heads of it, buckets of one label left out. A label of more than BLOCK / 2
    members has blocks of its own, which are not compared with each other. No task gets a whole bucket or label.
    """
    heads = buckets.select("key", F.array(*[f"h{j}" for j in range(HEADS)]).alias("heads"), "n")
    rest_ = join_hot(members.join(heads.select("key"), "key", "left_semi"), heads, ["key"], "n", HOT).where(~F.array_contains("heads", F.col("_node"))).drop("heads", "n")
    rest_ = materialise(rest_.join(labels.withColumnRenamed("node", "_node"), "_node", "left").withColumn("label", F.coalesce("label", "_node")))
    runs = materialise(rest_.groupBy("key", "label").agg(F.count("*").alias("n")))
    open_ = materialise(runs.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") <= BLOCK // 2, F.col("n")).otherwise(0)).alias("small")).where("labels > 1"))
    runs = materialise(join_hot(runs.join(open_.select("key"), "key", "left_semi"), open_.select("key", "small", F.col("labels").alias("w")), ["key"], "w", HOT).drop("w"))
    mine = materialise(rest_.join(open_.select("key"), "key", "left_semi"))
    placed = join_hot(mine, runs, ["key", "label"], "n", HOT)
    cut = lambda h, n: F.pmod(h, F.ceil(n / BLOCK)).cast("int")
    large = F.col("n") > BLOCK // 2
    block = F.when(large, F.struct(F.col("label").alias("own"), cut(F.xxhash64("_node"), F.col("n")).alias("at"))).otherwise(F.struct(F.lit(None).cast("binary").alias("own"), cut(F.xxhash64("label"), F.col("small")).alias("at")))
    placed = materialise(placed.select("key", "_node", "label", block.alias("block")))
    blocks = materialise(placed.select("key", "block").distinct())
    left, right = (blocks.withColumnRenamed("block", x) for x in ("i", "j"))
    pairs = materialise(left.join(right, "key").where("i <= j and not (i.own is not null and i.own <=> j.own)"))
    sides = pairs.select("key", F.col("i").alias("block"), "i", "j", F.lit(0).alias("side")).union(pairs.where("i <> j").select("key", F.col("j").alias("block"), "i", "j", F.lit(1).alias("side")))
    return placed.join(sides, ["key", "block"]).select("key", "i", "j", "side", "_node", "label")


def _compared(blocks: DataFrame, nodes: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs (a, b) of the blocks that are SIMILAR. A pair that shares several bands is compared in the first of them, and not at all once it is in one class."""

    def run(table: pa.Table) -> pa.Table:
        side, node, label, key, bands = (table.column(c).to_pylist() for c in ("side", "_node", "label", "key", "_bands"))
        held = [(np.frombuffer(s, np.uint32), np.frombuffer(w, np.uint8)) for s, w in zip(table.column("_s").to_pylist(), table.column("_w").to_pylist(), strict=True)]
        weight = np.array([_WEIGHT[w].sum() for _, w in held])
        bands, up, a, b = np.array(bands, np.int64), {x: x for x in label}, [], []
        own = int(np.flatnonzero(bands[0] == key[0])[0])

        def top(x: bytes) -> bytes:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        first, second = (np.array([i for i, s in enumerate(side) if s == which], np.int64) for which in (0, 1))
        for at, x in enumerate(first):
            others = second if len(second) else first[at + 1 :]
            near = (np.minimum(weight[others], weight[x]) >= SIMILAR * np.maximum(weight[others], weight[x])) & ~(bands[others, :own] == bands[x, :own]).any(1)
            for y in others[near]:
                p, q = top(label[x]), top(label[y])
                if p != q and weighted_jaccard(*held[x], *held[y]) >= SIMILAR:
                    up[max(p, q)] = min(p, q)
                    a.append(node[x])
                    b.append(node[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    rows = blocks.join(nodes.select("_node", "_bands"), "_node").join(features, "_node")
    return rows.groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, class_id (smallest id of its class), class_size (rows), kept (is the class's id)."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):  # all work of Python ends in here
        return _classes(docs, id_col, text_col)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    idf = idf_levels(*document_frequencies(docs, text_col))
    rows = materialise(_nodes(docs, id_col, text_col, idf))
    nodes = materialise(rows.where("_node is not null").groupBy("_node").agg(F.min("_id").alias("least"), F.count("*").alias("n"), F.any_value("_bands").alias("_bands")))
    members = materialise(nodes.select("_node", F.explode("_bands").alias("key")))
    sizes = materialise(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialise(join_hot(members.join(sizes.select("key"), "key", "left_semi"), sizes, ["key"], "n", HOT))
    met = materialise(shared.join(shared.groupBy("_node").agg(F.sum("n").alias("met")), "_node").drop("n"))
    orders = [F.max_by("_node", F.struct(F.col("met") if j == 0 else F.lit(0), F.xxhash64(F.lit(j), F.col("_node")))).alias(f"h{j}") for j in range(HEADS)]
    buckets = materialise(met.groupBy("key").agg(F.count("*").alias("n"), *orders))
    proposed = join_hot(met.drop("met"), buckets, ["key"], "n", HOT)
    heads = F.array_distinct(F.array(*[F.struct(F.when(F.lit(j) == 0, 0).otherwise(1).alias("round"), F.col(f"h{j}").alias("b")) for j in range(HEADS)]))
    pairs = materialise(proposed.select(F.col("_node").alias("a"), F.explode(heads).alias("x")).select("a", "x.b", "x.round").where("a <> b").groupBy("a", "b").agg(F.min("round").alias("round")))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    named = pairs.select(F.col("a").alias("_node")).union(pairs.select(F.col("b").alias("_node"))).distinct()
    wanted = nodes.join(named, "_node", "left_semi").select(F.col("least").alias("_id"), "_node")
    features = materialise(_features(texts, wanted, idf).dropDuplicates(["_node"]))
    edges = materialise(_verified(pairs.where("round = 0"), features))
    labels = components(edges)
    label = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    open_ = pairs.where("round = 1").join(label("a"), "a", "left").join(label("b"), "b", "left").where("not (la <=> lb) or la is null").select("a", "b")
    more = materialise(_verified(materialise(open_), features))
    if more.limit(1).count():
        edges = materialise(edges.union(more))
        labels = components(edges)
    blocks = materialise(_blocks(members, buckets.where(F.col("n") > 2), labels))
    if blocks.limit(1).count():
        last = materialise(_compared(blocks, nodes, features))
        if last.limit(1).count():
            labels = components(edges.union(last))
    named = nodes.select("_node", "least", "n").join(labels.withColumnRenamed("node", "_node"), "_node", "left").select("_node", "least", "n", F.coalesce("label", "_node").alias("label"))
    named = materialise(named)
    whole = materialise(named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("nodes")))
    told = materialise(join_hot(named, whole, ["label"], "nodes", HOT).select("_node", "n", "class_id", "class_size"))
    out = join_hot(rows.select("_id", "_node"), told, ["_node"], "n", HOT)
    alone = F.col("_node").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | F.col("_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, in all their columns, that stand for their class. Texts without shingles all stay."""
    stays = materialise(classes(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept_id")).distinct())
    return docs.join(stays, F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")
