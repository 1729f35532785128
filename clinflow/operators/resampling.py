"""Cluster resampling in which no row is repeated for a replicate.

A cluster's draws are one vector, a count for each replicate, made once and joined to its rows. Everything after
works on such vectors: sums by score, areas, Gram matrices. A table is shuffled once with its vectors, so the
work is rows x replicates in arrays and never in rows. What comes to the driver has the size of replicates
(times folds, models and coefficients).

Draws are Poisson(1) by hash, the limit of drawing with replacement. A replicate that lacks a class is replaced by
one of a further five per cent of draws; if these do not do, the result is an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinflow.functions.scalars import unit_interval
from clinflow.shared import materialise

#: Share of replicates that may be replaced, and rows that are worked on at once.
REPLACED, ROWS = 0.05, 4_096
#: Rows whose scores one task puts in order.
RANGE = 4_000_000
#: Rows whose draws are added up together, replicates at once, rows of which a task at most keeps the sums.
BLOCK, WIDTH, SUMS = 1 << 19, 105, 20_000


def attempts(replicates: int) -> int:
    return replicates + math.floor(REPLACED * replicates)


def draws(cluster: Column, replicates: int, seed: int = 1) -> Column:
    """How often the cluster is drawn in replicates 1, 2, ...: an array of small counts."""
    tails, tail, term = [], 0.0, math.exp(-1)
    for k in range(1, 12):
        tail += term
        tails.append(tail)
        term /= k
    numbers = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: unit_interval(F.lit(seed), r, cluster))

    def count(u: Column) -> Column:
        out = F.lit(len(tails))
        for k in range(len(tails) - 1, -1, -1):
            out = F.when(u < F.lit(tails[k]), k).otherwise(out)
        return out.cast("byte")

    return F.transform(numbers, count)


def _key(cluster: Column) -> Column:
    """What `_counts` takes a cluster's name from."""
    return F.concat_ws("|", F.lit(""), cluster.cast("string"))


def _counts(keys: list[str], replicates: int, seed: int, first: int = 1) -> np.ndarray:
    """The draws of `draws` in replicates first, first + 1, ...: a row for each key. A digest costs a third of what Spark's function and its strings cost."""
    starts = [f"{seed}|{r}".encode() for r in range(first, first + replicates)]
    tails = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(11)])
    digest, numbers = hashlib.sha256, np.empty((len(keys), replicates), np.uint64)
    for i, key in enumerate(keys):
        name = key.encode()
        numbers[i] = np.frombuffer(b"".join([digest(s + name).digest() for s in starts]), ">u8")[::4]
    return np.searchsorted(tails, (numbers >> np.uint64(12)) / float(1 << 52), "right").astype(np.int8)


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().reshape(n, -1)


def _tasks(spark: SparkSession) -> int:
    """Tasks of a table whose rows are few and cost much."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _drawn(df: DataFrame, cluster: str, replicates: int, seed: int, *columns: Column) -> DataFrame:
    """_k, the columns and _m, the cluster's draws."""
    rows = df.select(F.col(cluster).alias("_k"), *columns)
    vectors = rows.select("_k").distinct().withColumn("_m", draws(F.col("_k"), replicates, seed))
    return rows.join(vectors, "_k")


def _kept(found: DataFrame, replicates: int, areas: list[str]) -> DataFrame:
    """The first `replicates` draws with both classes, numbered from 1. found has a row for each draw, so the window sees that many rows."""
    good = found.where(F.col(areas[0]).isNotNull())
    named = good.withColumn("replicate", F.row_number().over(Window.orderBy("attempt")))
    enough = F.count("*").over(Window.partitionBy()) >= F.lit(replicates)
    named = named.withColumn("_ok", F.when(enough, F.lit(True)).otherwise(F.raise_error(F.lit("more than 5 per cent of the replicates lack a class")).cast("boolean")))
    return named.where("_ok").where(F.col("replicate") <= replicates).drop("_ok", "attempt")


def _scored(which: list[int]):
    """Sums of draws by (which, score): cases and controls of every replicate."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                m = _vectors(part.column("_m"), part.num_rows).astype(np.int32) * part.column("_n").to_numpy()[:, None].astype(np.int32)
                y = part.column("_y").to_numpy()
                for w in which:
                    score = part.column(f"_s{w}").to_numpy()
                    order = np.argsort(score, kind="stable")
                    starts = np.flatnonzero(np.append(True, np.diff(score[order]) != 0))
                    both = [np.add.reduceat(m[order] * (y[order] == c)[:, None], starts, axis=0) for c in (1, 0)]
                    blobs = [pa.array([row.tobytes() for row in x], pa.binary()) for x in both]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), w, np.int32)), pa.array(score[order][starts]), *blobs], ["which", "score", "cases", "controls"])

    return sums


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a range of rising scores: its cases, its controls and the wins of cases over controls in it. A control beside an equal case is half won."""
    state: dict[int, dict] = {}

    def settle(s: dict) -> None:
        s["wins"] += s["c"] * (s["controls"] + s["n"] / 2)
        s["cases"], s["controls"] = s["cases"] + s["c"], s["controls"] + s["n"]

    for batch in batches:
        for w, score, c, n in zip(*(batch.column(k).to_pylist() for k in ("which", "score", "cases", "controls")), strict=True):
            c, n = (np.frombuffer(x, np.int32).astype(np.float64) for x in (c, n))
            if w not in state:
                state[w] = {"least": score, "at": score, "c": c, "n": n, **{k: np.zeros(len(c)) for k in ("cases", "controls", "wins")}}
            elif (s := state[w])["at"] == score:
                s["c"], s["n"] = s["c"] + c, s["n"] + n
            else:
                settle(s)
                s["at"], s["c"], s["n"] = score, c, n
    for w, s in state.items():
        settle(s)
        yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([s["least"]]), *(pa.array([s[k].tobytes()], pa.binary()) for k in ("cases", "controls", "wins"))], ["which", "least", "cases", "controls", "wins"])


_RANGE = "which int, least double, cases binary, controls binary, wins binary"


def _areas(ranges: pa.Table) -> pa.Table:
    """which, attempt, area from the ranges of one score: cases of a range beat all controls of those below it."""
    ranges = ranges.sort_by("least")
    cases, controls, wins = (np.array([np.frombuffer(x.as_py(), np.float64) for x in ranges[k]]) for k in ("cases", "controls", "wins"))
    below = np.cumsum(controls, axis=0) - controls
    total = cases.sum(axis=0) * controls.sum(axis=0)
    area = np.divide((wins + cases * below).sum(axis=0), total, out=np.full(len(total), np.nan), where=total > 0)
    return pa.table({"which": pa.array(np.full(len(area), ranges["which"][0].as_py(), np.int32)), "attempt": pa.array(np.arange(1, len(area) + 1, dtype=np.int32)), "area": pa.array(area, mask=np.isnan(area))})


def _wide(areas: DataFrame, names: list[str]) -> DataFrame:
    return areas.groupBy("attempt").agg(*[F.max(F.when(F.col("which") == w, F.col("area"))).alias(name) for w, name in enumerate(names)])


def cluster_bootstrap(df: DataFrame, cluster: str, label: str, base: str, other: str, replicates: int, seed: int = 1) -> DataFrame:
    """replicate, auc_base, auc_other, delta: both scores under the same cluster weights. Rows with a null score, label or cluster are left out."""
    rows = df.where(F.col(base).isNotNull() & F.col(other).isNotNull() & F.col(label).isNotNull())
    cells = rows.groupBy(F.col(cluster).alias("_c"), F.col(label).cast("int").alias("_y"), F.col(base).cast("double").alias("_s0"), F.col(other).cast("double").alias("_s1")).agg(F.count("*").alias("_n"))
    drawn = _drawn(cells, "_c", attempts(replicates), seed, F.col("_y"), F.col("_s0"), F.col("_s1"), F.col("_n"))
    sums = drawn.mapInArrow(_scored([0, 1]), "which int, score double, cases binary, controls binary")
    ranges = sums.repartitionByRange("which", "score").sortWithinPartitions("which", "score").mapInArrow(_ranged, _RANGE)
    found = _wide(ranges.groupBy("which").applyInArrow(_areas, "which int, attempt int, area double"), ["auc_base", "auc_other"])
    kept = _kept(found, replicates, ["auc_base", "auc_other"])
    return kept.select("replicate", "auc_base", "auc_other", (F.col("auc_other") - F.col("auc_base")).alias("delta"))


def mean_bootstrap(df: DataFrame, keys: list[str], id_: str, value: str, replicates: int, seed: int = 1) -> DataFrame:
    """keys, n, low, high: 2.5 and 97.5 per cent of the means of resampled rows; null with fewer than two finite values. One pass: sums of each task and group.

    A row is a few bytes and a digest for each replicate, so rows are dealt evenly to tasks before they are drawn.
    """
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)) & (F.abs(F.col(value)) < float("inf")))
    group = F.to_json(F.struct(*keys) if keys else F.struct(F.lit(0)))
    rows = finite.select(group.alias("_j"), F.col(value).cast("double").alias("_v"), _key(F.col(id_)).alias("_i"))
    rows = rows.repartition(_tasks(df.sparkSession))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                m = _counts(part.column("_i").to_pylist(), replicates, seed).astype(np.float64)
                v, group = part.column("_v").to_numpy(), part.column("_j").dictionary_encode()
                own = group.indices.to_numpy()
                for g, name in enumerate(group.dictionary.to_pylist()):
                    at = (own == g).astype(np.float64)
                    row = np.concatenate([[at.sum()], at @ m, (at * v) @ m])
                    held[name] = held.get(name, 0.0) + row
        for name, row in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([row.tolist()], pa.list_(pa.float64()))], ["_j", "sums"])

    parts = rows.mapInArrow(sums, "_j string, sums array<double>")
    at = parts.select("_j", F.posexplode("sums").alias("k", "x")).groupBy("_j", "k").agg(F.sum("x").alias("x"))
    whole = at.groupBy("_j").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("s"))
    mean = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.try_divide(F.col("s")[r + replicates], F.col("s")[r]))
    shape = df.select(*keys).schema.simpleString() if keys else "struct<col1:int>"
    one = whole.select(F.from_json("_j", shape).alias("_k"), F.col("s")[0].cast("long").alias("n"), F.explode(mean).alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    out = one.groupBy("_k", "n").agg(q.alias("q"))
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "n", F.when(F.col("n") > 1, F.col("q")[0]).alias("low"), F.when(F.col("n") > 1, F.col("q")[1]).alias("high"))


def _summed(cells: DataFrame, cluster: str, names: list[str], number: str, replicates: int, seed: int, rows: int) -> DataFrame:
    """names and _m (32-bit counts as bytes): how often rows that agree in all names are drawn in each replicate. cells: `rows` rows of cluster, names, number of rows.

    Clusters are drawn where their rows are, once; a task sends on a row for each distinct row of its block, so what is shuffled follows the distinct rows.
    """
    spark = cells.sparkSession
    fields = [f for f in cells.schema.fields if f.name in names]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    order = [f.name for f in fields]
    types = {f.name: pa.int32() if f.dataType.simpleString() == "int" else pa.float64() for f in fields}

    def combined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(held)
        seen, which = np.unique(np.column_stack([block[c].to_numpy().astype(np.float64) for c in order]), axis=0, return_inverse=True)
        own = block["_k"].combine_chunks().dictionary_encode()
        at = np.argsort(which.ravel(), kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(which.ravel()[at]) != 0))
        clusters, drawn, n = own.dictionary.to_pylist(), own.indices.to_numpy()[at], block["_n"].to_numpy()[at].astype(np.int32)
        for a in range(0, replicates, WIDTH):
            m = np.concatenate([_counts(clusters[i : i + 2048], min(WIDTH, replicates - a), seed, a + 1) for i in range(0, len(clusters), 2048)])
            for i in range(0, len(seen), ROWS):  # in slices of rows, so that no wide copy of the block is made
                some, lo, hi = seen[i : i + ROWS], starts[i], starts[i + ROWS] if i + ROWS < len(seen) else len(drawn)
                v = m[drawn[lo:hi]].astype(np.int32)
                v *= n[lo:hi, None]
                sums = np.add.reduceat(v, starts[i : i + ROWS] - lo, axis=0)
                if sums.max() < 1 << 15:
                    sums = sums.astype(np.int16)
                yield pa.RecordBatch.from_arrays([*(pa.array(some[:, j].astype(types[c].to_pandas_dtype()), types[c]) for j, c in enumerate(order)), pa.array(np.full(len(some), a, np.int32)), pa.array([x.tobytes() for x in sums], pa.binary())], [*order, "at", "sums"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield from combined(held)
                held, n = [], 0
        if n:
            yield from combined(held)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}
        total: list[np.ndarray] = []
        for batch in batches:
            for *key, a, x in zip(*(batch.column(c).to_pylist() for c in (*order, "at", "sums")), strict=True):
                if (i := place.setdefault(tuple(key), len(total))) == len(total):
                    total.append(np.zeros(replicates, np.int32))
                width = min(WIDTH, replicates - a)
                total[i][a : a + width] += np.frombuffer(x, f"i{len(x) // width}")
        keys = list(place)
        for i in range(0, len(keys), ROWS):
            columns = zip(*keys[i : i + ROWS], strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, types[c]) for x, c in zip(columns, order, strict=True)), pa.array([x.tobytes() for x in total[i : i + ROWS]], pa.binary())], [*order, "_m"])

    dealt = cells.select(_key(F.col(cluster)).alias("_k"), *order, F.col(number).alias("_n")).repartition(max(spark.sparkContext.defaultParallelism, -(-rows // BLOCK)), "_k")
    parts = dealt.mapInArrow(blocks, f"{kind}, at int, sums binary")
    return parts.repartition(max(spark.sparkContext.defaultParallelism, -(-rows // SUMS)), *order).mapInArrow(added, f"{kind}, _m binary")


class _Refit:
    """Weighted logistic models of all (replicate, fold, set of features) at once: features are columns of one matrix whose first is 1."""

    def __init__(self, features: int, sets: list[list[int]], folds: list[int], replicates: int, penalty: float):
        self.sets = [[0, *(1 + i for i in s)] for s in sets]
        self.folds, self.r, self.d, self.penalty = folds, replicates, features + 1, penalty

    def matrix(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = np.column_stack([np.ones(part.num_rows), *(part.column(f"_x{i}").to_numpy() for i in range(self.d - 1))])
        return x, part.column("_y").to_numpy(), part.column("_f").to_numpy(), np.frombuffer(b"".join(part.column("_m").to_pylist()), np.int32).reshape(part.num_rows, -1).astype(np.float64)

    def moments(self, x, y, fold, m) -> np.ndarray:
        """(fold, replicate, weight of cases and of all, sums, sums of squares)."""
        out = np.zeros((len(self.folds), self.r, 2 + 2 * self.d))
        for k, f in enumerate(self.folds):
            here = fold == f
            both = np.column_stack([y[here], np.ones(here.sum()), x[here], x[here] ** 2])
            out[k] = m[here].T @ both
        return out

    def scale(self, moments: np.ndarray) -> None:
        """Means and spreads of each training part, and start values."""
        train = moments.sum(axis=0) - moments
        n = np.maximum(train[:, :, 1:2], 1e-300)
        self.center = train[:, :, 2 : 2 + self.d] / n
        self.spread = np.sqrt(np.maximum(train[:, :, 2 + self.d :] / n - self.center**2, 0)) + 1e-12
        self.center[:, :, 0], self.spread[:, :, 0] = 0.0, 1.0
        self.beta = [np.zeros((len(self.folds), self.r, len(s))) for s in self.sets]

    def raw(self, s: int) -> np.ndarray:
        """Coefficients on the features as they are, from those on scaled ones: (fold, replicate, coefficient)."""
        columns = self.sets[s]
        out = self.beta[s] / self.spread[:, :, columns]
        out[:, :, 0] -= (out * self.center[:, :, columns]).sum(axis=2)
        return out

    def gram(self, x, y, fold, m) -> np.ndarray:
        """Slopes and curvatures on the features as they are, one after the other for all (set, fold, replicate)."""
        out = []
        for s, columns in enumerate(self.sets):
            part, beta = x[:, columns], self.raw(s)
            d = len(columns)
            pairs = np.column_stack([part[:, i] * part[:, j] for i in range(d) for j in range(i, d)])
            for k, f in enumerate(self.folds):
                train = fold != f
                p = 1 / (1 + np.exp(-np.clip(part[train] @ beta[k].T, -30, 30)))
                w = m[train]
                out.append(((w * (p - y[train, None])).T @ part[train]).ravel())
                out.append(((w * (p * (1 - p))).T @ pairs[train]).ravel())
        return np.concatenate(out)

    def step(self, flat: np.ndarray) -> float:
        """One Newton step of all models; the longest move."""
        at, longest = 0, 0.0
        for s, columns in enumerate(self.sets):
            d = len(columns)
            upper = [(i, j) for i in range(d) for j in range(i, d)]
            ridge = np.full(d, self.penalty)
            ridge[0] = 0.0
            for k in range(len(self.folds)):
                g = flat[at : at + self.r * d].reshape(self.r, d)
                at += self.r * d
                h_flat = flat[at : at + self.r * len(upper)].reshape(self.r, len(upper))
                at += self.r * len(upper)
                h = np.zeros((self.r, d, d))
                for c, (i, j) in enumerate(upper):
                    h[:, i, j] = h[:, j, i] = h_flat[:, c]
                scaled = np.zeros((self.r, d, d))  # columns of the scaled features in those as they are
                scaled[:, range(d), range(d)] = 1 / self.spread[k][:, columns]
                scaled[:, 0, 1:] = -(self.center[k] / self.spread[k])[:, columns[1:]]
                h = np.swapaxes(scaled, 1, 2) @ h @ scaled + np.diag(ridge + 1e-9)
                g = np.einsum("rij,ri->rj", scaled, g) + ridge * self.beta[s][k]
                move = np.linalg.solve(h, g[:, :, None])[:, :, 0]
                self.beta[s][k] -= move
                longest = max(longest, float(np.abs(move).max()))
        return longest


def refit_bootstrap(df: DataFrame, cluster: str, label: str, fold: str, base: list[str], more: list[str], replicates: int, penalty: float = 1.0, seed: int = 1, steps: int = 30) -> DataFrame:
    """replicate, auc_base, auc_more, delta: clusters are drawn, folds stay, and the logistic models of `base` and of `base` and `more` are fitted again
    outside each fold and score it.

    Rows that agree in label, fold and features are one row with the sum of their draws, so refits cost what the distinct rows cost.
    A Newton step is one aggregation for all replicates, folds and both models. Scores go to the task of their (model, replicate, range of scores). Features must
    be complete; rows without a label, fold or cluster are left out.
    """
    features = [*base, *more]
    most = attempts(replicates)
    rows = df.where(F.col(label).isNotNull() & F.col(fold).isNotNull() & F.col(cluster).isNotNull())
    cells = rows.groupBy(F.col(cluster).alias("_c"), F.col(label).cast("double").alias("_y"), F.col(fold).cast("int").alias("_f"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    cells = cells.agg(F.count("*").alias("_n"))
    cells = materialise(cells)
    drawn = cells.count()
    table = materialise(_summed(cells, "_c", [c for c in cells.columns if c not in ("_c", "_n")], "_n", most, seed, drawn))
    folds = sorted(r[0] for r in table.select("_f").distinct().collect())
    count = table.count()
    fit = _Refit(len(features), [list(range(len(base))), list(range(len(features)))], folds, most, penalty)

    def added(what: str, size: int) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    total += getattr(fit, what)(*fit.matrix(batch.slice(i, ROWS))).ravel()
            # in pieces, so that no one task adds up all of a wide sum
            for c in range(0, size, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([total[c : c + (1 << 16)].tobytes()], pa.binary())], ["at", "sums"])

        def add(rows: pa.Table) -> pa.Table:
            whole = np.sum([np.frombuffer(x.as_py()) for x in rows["sums"]], axis=0)
            return pa.table({"at": pa.array([rows["at"][0].as_py()]), "sums": pa.array([whole.tobytes()], pa.binary())})

        kind = "at long, sums binary"
        out = np.zeros(size)
        for r in table.mapInArrow(work, kind).groupBy("at").applyInArrow(add, kind).collect():
            part = np.frombuffer(bytes(r["sums"]))
            out[r["at"] : r["at"] + len(part)] = part
        return out

    if not count:
        return df.sparkSession.createDataFrame([], "replicate int, auc_base double, auc_more double, delta double")
    fit.scale(added("moments", len(folds) * most * (2 + 2 * fit.d)).reshape(len(folds), most, -1))
    size = sum(len(folds) * most * (len(s) + len(s) * (len(s) + 1) // 2) for s in fit.sets)
    for _ in range(steps):
        if fit.step(added("gram", size)) < 1e-8:
            break
    betas = [fit.raw(s) for s in range(2)]
    bounds = _bounds(fit, betas, table, count)
    place = {f: k for k, f in enumerate(folds)}

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, own, m = fit.matrix(batch)
            k = np.array([place[f] for f in own], np.int64)
            for s, columns in enumerate(fit.sets):
                for r in range(most):
                    here = m[:, r] > 0
                    score = (x[here][:, columns] * betas[s][k[here], r]).sum(axis=1)
                    part = np.searchsorted(bounds[s][r], score, "right")
                    for p in np.unique(part):
                        at = part == p
                        got = [score[at], (m[here, r] * y[here])[at].astype(np.int32), (m[here, r] * (1 - y[here]))[at].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([r + 1], pa.int32()), pa.array([int(p)], pa.int32()), *(pa.array([g.tobytes()], pa.binary()) for g in got)], ["which", "attempt", "part", "score", "cases", "controls"])

    def wins(rows: pa.Table) -> pa.Table:
        score, cases, controls = (np.concatenate([np.frombuffer(x.as_py(), t) for x in rows[c]]) for c, t in (("score", np.float64), ("cases", np.int32), ("controls", np.int32)))
        order = np.argsort(score, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(score[order]) != 0))
        c, n = (np.add.reduceat(v[order].astype(np.float64), starts) for v in (cases, controls))
        got = [float(x) for x in (c.sum(), n.sum(), (c * (np.cumsum(n) - n / 2)).sum())]
        return pa.table({"which": rows["which"][:1], "attempt": rows["attempt"][:1], "part": rows["part"][:1], "c": [got[0]], "n": [got[1]], "w": [got[2]]})

    runs = table.mapInArrow(scores, "which int, attempt int, part int, score binary, cases binary, controls binary")
    per = runs.groupBy("which", "attempt", "part").applyInArrow(wins, "which int, attempt int, part int, c double, n double, w double")
    below = F.sum("n").over(Window.partitionBy("which", "attempt").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    areas = per.withColumn("w", F.col("w") + F.col("c") * F.coalesce(below, F.lit(0.0))).groupBy("which", "attempt").agg(F.try_divide(F.sum("w"), F.sum("c") * F.sum("n")).alias("area"))
    kept = _kept(_wide(areas, ["auc_base", "auc_more"]), replicates, ["auc_base", "auc_more"])
    return kept.select("replicate", "auc_base", "auc_more", (F.col("auc_more") - F.col("auc_base")).alias("delta"))


def _bounds(fit: _Refit, betas: list[np.ndarray], table: DataFrame, count: int) -> list[np.ndarray]:
    """(set, replicate, bound): scores that cut each replicate's into ranges of about RANGE rows, from at most about 2,000 rows."""
    ranges = -(-count // RANGE)
    if ranges < 2:
        return [np.zeros((fit.r, 0)) for _ in betas]
    names = [f"_x{i}" for i in range(fit.d - 1)]
    sample = table.where(F.pmod(F.xxhash64(*names, "_y", "_f"), F.lit(max(1, count // 2000))) == 0).select(*names).toPandas().to_numpy(np.float64)
    x = np.column_stack([np.ones(len(sample)), sample])
    out = []
    for s, columns in enumerate(fit.sets):
        score = np.einsum("nd,krd->rnk", x[:, columns], betas[s]).reshape(fit.r, -1)
        out.append(np.quantile(score, np.linspace(0, 1, ranges + 1)[1:-1], axis=1).T)
    return out
