"""Random forests on cells: the rules of Spark ML's forest, learnt from the table of distinct binned rows.

Each fold's model has medians and bins of its own, from the rows outside the fold. Rows that agree in all bins are one cell
with a count for each class, and a tree's bootstrap draws how often a cell and class is taken: Poisson(count), which is what
Poisson(1) draws of its rows add up to. So rows are read four times in all and never again for a tree or a level; trees
are grown side by side in tasks that hold a model's cells. Draws are seeded by model and tree over cells in order, so they
depend on neither partitions nor order of rows.

Where a model has more than `cells` cells, all models are Spark ML's, which goes over the rows level by level.

Null and NaN continuous features get the median; binary ones go with the highest bin. Rows without a label are not learnt
from, those whose fold has no model are not scored. A model without rows to learn from scores null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinflow.operators import models as M
from clinflow.shared import materialise

#: Bins of a feature and rows that they are drawn from, cells that a task takes, trees that it grows.
BINS, BIN_ROWS, CELLS, TREES = 32, 200_000, 50_000, 10


def split_points(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Borders x <= border as Spark ML finds them: between all distinct values, or between those nearest to equal shares of the rows."""
    seen, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(seen) <= bins:
        return (seen[1:] + seen[:-1]) / 2
    out, stride = [], counts.sum() / bins
    target, before = stride, 0
    for i, now in enumerate(np.cumsum(counts)):
        if i and abs(before - target) < abs(now - target):
            out.append((seen[i - 1] + seen[i]) / 2)
            target += stride
        before = now
    return np.array(out)


def grow(columns: np.ndarray, counts: np.ndarray, depth: int, least: int, bins: int = BINS) -> np.ndarray:
    """Probability of class 1 at every cell. columns: (feature, cell) bins; counts: (class, cell) draws.

    A node is split by the largest fall of the Gini impurity, ties by the first feature and bin; neither side has less than `least` draws. Two leaves below
    one node that predict the same class are one leaf, as in Spark ML.
    """
    at = np.zeros(columns.shape[1], np.int64)  # node of each cell; below[node] is its left child, the right one comes next
    below, totals, live = [-1], [counts.sum(1)], np.array([0])
    for _ in range(depth):
        if not len(live):
            break
        place = np.full(len(below), -1)
        place[live] = np.arange(len(live))
        own = place[at]
        here = np.flatnonzero(own >= 0)
        whole = np.array([totals[n] for n in live], float)
        best, gain, feature = np.zeros(len(live)), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        all_n = np.maximum(whole.sum(1), 1)
        impurity = 1 - ((whole / all_n[:, None]) ** 2).sum(1)
        for f, column in enumerate(columns):
            key = own[here] * bins + column[here]
            left = np.array([np.bincount(key, c[here], len(live) * bins).reshape(-1, bins).cumsum(1) for c in counts])
            right = whole.T[:, :, None] - left
            n, m = left.sum(0), right.sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                fall = impurity[:, None] - (n - (left**2).sum(0) / n + m - (right**2).sum(0) / m) / all_n[:, None]
            fall = np.where((n >= least) & (m >= least), fall, 0.0)
            first = fall.argmax(1)
            more = fall[np.arange(len(live)), first]
            better = more > best + 1e-12
            best[better], gain[better], feature[better] = more[better], first[better], f
        split = np.flatnonzero(best > 1e-12)
        child = np.full(len(live), -1)
        child[split] = len(below) + 2 * np.arange(len(split))
        for i in split:
            below[live[i]] = child[i]
        below += [-1] * (2 * len(split))
        moved = here[child[own[here]] >= 0]
        i = own[moved]
        at[moved] = child[i] + (columns[feature[i], moved] > gain[i])
        sums = np.array([np.bincount(at[moved], c[moved], len(below)) for c in counts])
        live = np.arange(len(totals), len(below))
        totals += list(sums[:, live].T)
    totals, leaf = np.array(totals, float), np.arange(len(below))
    for n in range(len(below) - 1, -1, -1):  # children come after their node
        if (b := below[n]) >= 0 and below[b] < 0 and below[b + 1] < 0 and (totals[b, 1] > totals[b, 0]) == (totals[b + 1, 1] > totals[b + 1, 0]):
            leaf[b] = leaf[b + 1] = n
            below[n] = -1
    for n in range(len(leaf)):  # a node that is gone stands for the one above it
        leaf[n] = leaf[leaf[n]]
    with np.errstate(invalid="ignore"):
        return (totals[:, 1] / totals.sum(1))[leaf[at]]


def crossfit_forest(df: DataFrame, continuous: list[str], binary: list[str], label: str, fold: str, id_: str, folds: int = 5, trees: int = 100, depth: int = 12, least: int = 50, seed: int = 1, cells: int | None = None) -> DataFrame:
    """id_, fold, probability: rows of each fold 1..folds scored by a forest of the rows of all other folds."""
    names, known = [f"_x{i}" for i in range(len(continuous) + len(binary))], range(1, folds + 1)
    rows = df.select(F.col(id_).alias("_id"), F.col(fold).cast("int").alias("_fold"), F.col(label).cast("int").alias("_y"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(x) for c, x in zip([*continuous, *binary], names, strict=True)])
    rows = materialise(rows.where(F.col("_fold").isNotNull()))
    filled = names[: len(continuous)]
    middles = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(F.when((F.col("_fold") != k) & F.col("_y").isNotNull(), F.col(x)), 0.5, 10_000).alias(f"{x}_{k}") for k in known for x in filled]).first()
    cut = max(1, middles["n"] // BIN_ROWS)
    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(cut)) == 0).where("_y is not null").select("_fold", *names).toArrow()
    own = sample["_fold"].to_numpy()
    fill = {k: [middles[f"{x}_{k}"] if x in filled else np.nan for x in names] for k in known}

    def whole(column: pa.ChunkedArray | pa.Array, value: float | None) -> np.ndarray:
        x = column.to_numpy(zero_copy_only=False).astype(np.float64)
        return np.where(np.isnan(x), np.nan if value is None else value, x)

    edges = {k: [split_points(whole(sample[x], v)[own != k]) for x, v in zip(names, fill[k], strict=True)] for k in known}
    code = lambda batch, k: np.column_stack([np.zeros(batch.num_rows, np.uint8), *(np.searchsorted(e, whole(batch.column(x), v), "left").astype(np.uint8) for x, v, e in zip(names, fill[k], edges[k], strict=True))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, y = batch.column("_fold").to_numpy(), batch.column("_y").to_numpy(zero_copy_only=False).astype(np.float64)
            for k in known:
                bins = code(batch, k)
                seen, which = np.unique(np.ascontiguousarray(bins).view(f"V{bins.shape[1]}").ravel(), return_inverse=True)
                sums = [np.bincount(which, w, len(seen)).astype(np.int64) for w in ((at != k) & (y == 0), (at != k) & (y == 1), at == k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array([x.tobytes() for x in seen], pa.binary()), *map(pa.array, sums)], ["_m", "_cell", "n0", "n1", "held"])

    table = rows.mapInArrow(counted, "_m int, _cell binary, n0 long, n1 long, held long").groupBy("_m", "_cell").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "held")])
    table = materialise(table)
    if max((r["n"] for r in table.groupBy("_m").agg(F.count("*").alias("n")).collect()), default=0) > (CELLS if cells is None else cells):
        return M.crossfit(df.withColumn("label", F.col(label).cast("double")), [*M.dense_stages(continuous, binary), M.forest(seed, trees, depth, least)], fold, id_, folds)

    def grown(block: pa.Table) -> pa.Table:
        block = block.sort_by("_cell")
        bins = np.array([np.frombuffer(x, np.uint8) for x in block["_cell"].to_pylist()]).T
        n = np.array([block[c].to_numpy() for c in ("n0", "n1")])
        k, first = block["_m"][0].as_py(), block["_g"][0].as_py() * TREES
        total = np.zeros(bins.shape[1])
        for t in range(first, min(trees, first + TREES)):
            total += grow(bins, np.random.default_rng([seed, k, t]).poisson(n), depth, least)
        held = np.flatnonzero(block["held"].to_numpy())
        return pa.table({"_m": block["_m"].take(held), "_cell": block["_cell"].take(held), "p": pa.array(total[held])})

    groups = table.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // TREES))))
    # dealt by number, as few bytes would be put together in one task
    parts = groups.repartition(folds * (1 + (trees - 1) // TREES), "_m", "_g").groupBy("_m", "_g").applyInArrow(grown, "_m int, _cell binary, p double")
    chance = materialise(parts.groupBy("_m", "_cell").agg((F.sum("p") / trees).alias("probability")))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_fold").to_numpy()
            for k in known:
                if len(here := np.flatnonzero(at == k)):
                    part = batch.take(pa.array(here))
                    yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_fold"), pa.array([x.tobytes() for x in code(part, k)], pa.binary())], ["_id", "_m", "_cell"])

    kind = rows.schema["_id"].dataType.simpleString()
    got = rows.mapInArrow(placed, f"_id {kind}, _m int, _cell binary").join(F.broadcast(chance), ["_m", "_cell"])  # at most `cells` rows a model
    return got.select(F.col("_id").alias(id_), F.col("_m").alias(fold), F.when(~F.isnan("probability"), F.col("probability")).alias("probability"))
