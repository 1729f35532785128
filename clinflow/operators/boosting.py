"""Gradient boosting on histograms: leaf-wise trees, an L2 term on leaves, a learnt side for missing values.

Features are binned, and rows that agree in all bins, label and fold are one cell with a count, so what is
learnt from is the table of cells and not of rows. All folds of a cross-fit grow side by side. A level is one groupBy:
tasks add up gradients by (fold, node, feature, bin), Spark adds the tasks' sums, and the splits are drawn from
what is left, whose size is folds x leaves x features x bins whatever the rows. A level settles the children
of all leaves that may still be split, so a tree of 15 leaves takes about as many jobs as it is deep, and only left
children are summed. Gradients are whole numbers (multiples of 1 / SCALE), so sums are exact and a model
depends on neither partitions nor order.

If there are no more than `cells` cells, they are one block, and the same steps run inside one task without a job
a level: the trees are the same, bit for bit. The block is bounded by `cells`, not by the rows.

Null and NaN features are missing. Rows without a label or fold are not learnt from; those without a fold are not
scored. A training part with one class gets that class's share as every score. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinflow.shared import materialise

#: Gradients are whole multiples of 1 / SCALE: sums of up to 2^33 rows fit 64 bits.
SCALE = 1 << 30
#: Bins of a feature besides the one for missing values, and rows that the bins are drawn from.
BINS, BIN_ROWS = 255, 200_000
MISSING = BINS
#: Distinct binned rows that one task takes, and rounds after which the cells' scores are written anew.
CELLS, KEEP = 100_000, 10

Split = tuple[float, int, int, bool]


@dataclass(frozen=True)
class Boosting:
    """rounds trees of at most `leaves` leaves at `rate`; a leaf has `least` rows at least and its value an L2 term."""

    rounds: int = 300
    rate: float = 0.05
    leaves: int = 15
    least: int = 50
    l2: float = 1.0


def bin_edges(values: np.ndarray) -> np.ndarray:
    """Inner borders of a feature's bins: between distinct values where there are few, else between quantiles."""
    values = values[~np.isnan(values)]
    seen = np.unique(values)
    if len(seen) <= BINS:
        return (seen[1:] + seen[:-1]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1], method="linear"))


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.searchsorted(edges, values, "left").astype(np.uint8)
    out[np.isnan(values)] = MISSING
    return out


@dataclass
class Node:
    """A leaf or a split: the way to it, sums (feature, bin, gradient-hessian-rows), the best split, the nodes below. cells: in one block, those here."""

    path: str
    sums: np.ndarray
    way: tuple[tuple[Split, bool], ...] = ()
    cells: np.ndarray | None = None
    parts: tuple[np.ndarray | None, np.ndarray | None] = (None, None)
    best: Split = (0.0, 0, 0, False)
    below: list[Node] = field(default_factory=list)
    split: bool = False

    @property
    def order(self) -> tuple:
        """Highest gain first, then the node nearest to the root, then the left one."""
        return (-self.best[0], len(self.path), self.path)


def best_split(sums: np.ndarray, rules: Boosting) -> Split:
    """gain, feature, last bin of the left side, whether missing values go left. Ties: lowest feature, missing right before left, lowest bin."""
    g, h, n = (sums[..., k].astype(np.float64) / (1 if k == 2 else SCALE) for k in range(3))
    whole_g, whole_h, whole_n = g[0].sum(), h[0].sum(), n[0].sum()
    own = whole_g**2 / (whole_h + rules.l2)
    left = [np.cumsum(x[:, :BINS], axis=1) for x in (g, h, n)]
    gains = np.zeros((len(g), 2, BINS))
    for side in (0, 1):
        lg, lh, ln = (x + side * y[:, MISSING:] for x, y in zip(left, (g, h, n), strict=True))
        rg, rh, rn = whole_g - lg, whole_h - lh, whole_n - ln
        gain = lg**2 / (lh + rules.l2) + rg**2 / (rh + rules.l2) - own
        good = (ln >= rules.least) & (rn >= rules.least) & (lh >= 1e-3) & (rh >= 1e-3)
        gains[:, side] = np.where(good & ((n[:, MISSING:] > 0) | (side == 0)), gain, 0.0)
    at = int(gains.argmax())
    if gains.flat[at] <= 1e-9:
        return (0.0, 0, 0, False)
    f, side, b = np.unravel_index(at, gains.shape)
    return (float(gains.flat[at]), int(f), int(b), bool(side))


def goes_left(column: np.ndarray, split: Split) -> np.ndarray:
    _, _, b, missing = split
    return (column <= b) & (column != MISSING) | (missing & (column == MISSING))


def grow(roots: list[Node], left_sums: Callable[[list[tuple[int, Node]]], np.ndarray], rules: Boosting) -> list[Node]:
    """The roots with their trees below. left_sums: sums of the left side of each node's best split."""
    leaves = [[r] for r in roots]
    for r in roots:
        r.best = best_split(r.sums, rules)
    while True:
        asked: list[tuple[int, Node]] = []
        for k, held in enumerate(leaves):
            while len(held) < rules.leaves:
                node = min(held, key=lambda x: x.order)
                if node.best[0] <= 0 or not node.below:
                    break
                held.remove(node)
                node.split = True
                held += node.below
            wanted = sorted((x for x in held if x.best[0] > 0 and not x.below), key=lambda x: x.order)
            asked += [(k, node) for node in wanted[: rules.leaves - len(held)]]
        if not asked:
            return roots
        for (_, node), sums in zip(asked, left_sums(asked), strict=True):
            for side, name, part in ((True, "0", sums), (False, "1", node.sums - sums)):
                child = Node(node.path + name, part, (*node.way, (node.best, side)), node.parts[not side])
                child.best = best_split(part, rules)
                node.below.append(child)


Tree = tuple | float


def tree(node: Node, rules: Boosting) -> Tree:
    """(split, left, right), or a leaf's value."""
    if node.split:
        return (node.best, *(tree(x, rules) for x in node.below))
    g, h = (float(node.sums[0, :, k].sum()) / SCALE for k in range(2))
    return -rules.rate * g / (h + rules.l2)


def add(raw: np.ndarray, columns: np.ndarray, grown: Tree, rows: np.ndarray | None = None) -> None:
    """raw plus the tree's values of the rows."""
    rows = np.arange(len(raw)) if rows is None else rows
    if not isinstance(grown, tuple):
        raw[rows] += grown
        return
    split, left, right = grown
    side = goes_left(columns[split[1]][rows], split)
    add(raw, columns, left, rows[side])
    add(raw, columns, right, rows[~side])


def _gradients(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-raw))
    return np.rint((p - y) * SCALE), np.rint(p * (1 - p) * SCALE)


def _sums(columns: np.ndarray, cells: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums by (feature, bin) of some cells. In parts of 2^22 rows, in which sums of whole numbers are exact as doubles."""
    out = np.zeros((len(columns), BINS + 1, 3), np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(n[cells]) >> 22)) + 1, [len(cells)]]) if len(cells) else [0, 0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        these = cells[a:b]
        for f, column in enumerate(columns):
            bins = column[these]
            for j, weight in enumerate((g[these] * n[these], h[these] * n[these], n[these])):
                out[f, :, j] += np.bincount(bins, weight, BINS + 1).astype(np.int64)
    return out


def fit_block(columns: np.ndarray, y: np.ndarray, fold: np.ndarray, n: np.ndarray, models: list[int], start: dict[int, float], rules: Boosting) -> dict[int, list[Tree]]:
    """Trees of each model over the cells of one block."""
    going = list(start)
    raw = {m: np.full(len(y), start[m]) for m in going}
    out: dict[int, list[Tree]] = {m: [] for m in models}
    for _ in range(rules.rounds if going else 0):
        slopes = [_gradients(raw[m], y) for m in going]
        roots = []
        for m, (g, h) in zip(going, slopes, strict=True):
            cells = np.flatnonzero(fold != m)
            roots.append(Node("", _sums(columns, cells, g, h, n), (), cells))

        def left_sums(asked, slopes=slopes):
            got = []
            for k, node in asked:
                side = goes_left(columns[node.best[1]][node.cells], node.best)
                node.parts = (node.cells[side], node.cells[~side])
                got.append(_sums(columns, node.parts[0], *slopes[k], n))
            return got

        for m, root in zip(going, grow(roots, left_sums, rules), strict=True):
            out[m].append(tree(root, rules))
            add(raw[m], columns, out[m][-1])
    return out


def _matrix(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    return np.array([batch.column(c).to_numpy().astype(np.uint8) for c in names]).reshape(len(names), batch.num_rows)


def _fit_levels(cells: DataFrame, names: list[str], start: dict[int, float], models: list[int], rules: Boosting) -> dict[int, list[Tree]]:
    """Trees of each model by a job a level over cells of any number."""
    going = list(start)
    out: dict[int, list[Tree]] = {m: [] for m in models}

    def scored(batch, fresh: dict[int, list[Tree]]) -> tuple[np.ndarray, list[np.ndarray]]:
        columns, raw = _matrix(batch, names), []
        for m in going:
            own = batch.column(f"_raw{m}").to_numpy().copy()
            for t in fresh[m]:
                add(own, columns, t)
            raw.append(own)
        return columns, raw

    def summed(table: DataFrame, fresh: dict[int, list[Tree]], wanted: list[tuple[int, tuple]]) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(wanted), len(names), BINS + 1, 3), np.int64)
            for batch in batches:
                columns, raw = scored(batch, fresh)
                y, fold, n = (batch.column(c).to_numpy() for c in ("_y", "_fold", "_n"))
                slopes = [_gradients(r, y) for r in raw]
                for i, (k, way) in enumerate(wanted):
                    here = np.flatnonzero(fold != going[k])
                    for split, left in way:
                        here = here[goes_left(columns[split[1]][here], split) == left]
                    total[i] += _sums(columns, here, *slopes[k], n)
            at = np.flatnonzero(total[..., 2].reshape(-1))
            flat = total.reshape(-1, 3)[at]
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(flat[:, j]) for j in range(3))], ["at", "g", "h", "n"])

        got = table.mapInArrow(work, "at long, g long, h long, n long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow()
        sums = np.zeros((len(wanted) * len(names) * (BINS + 1), 3), np.int64)
        sums[got["at"].to_numpy()] = np.column_stack([got[c].to_numpy() for c in ("g", "h", "n")])
        return sums.reshape(len(wanted), len(names), BINS + 1, 3)

    table = materialise(cells.select("*", *[F.lit(start[m]).alias(f"_raw{m}") for m in going]))
    fresh: dict[int, list[Tree]] = {m: [] for m in going}
    for done in range(rules.rounds if going else 0):
        if done and done % KEEP == 0:
            def rewrite(batches: Iterator[pa.RecordBatch], fresh=fresh) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    raw = dict(zip(going, scored(batch, fresh)[1], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(raw[int(c[4:])]) if c.startswith("_raw") else batch.column(c) for c in batch.schema.names], batch.schema.names)

            table, fresh = materialise(table.mapInArrow(rewrite, table.schema)), {m: [] for m in going}
        roots = [Node("", sums) for sums in summed(table, fresh, [(k, ()) for k in range(len(going))])]
        ask = lambda asked, table=table, fresh=fresh: summed(table, fresh, [(k, (*node.way, (node.best, True))) for k, node in asked])
        for m, root in zip(going, grow(roots, ask, rules), strict=True):
            out[m].append(tree(root, rules))
            fresh[m].append(out[m][-1])
    return out


@dataclass(frozen=True)
class Model:
    """Fitted trees by held-out fold: bins of each feature, the score before the first tree, the trees."""

    features: list[str]
    edges: list[np.ndarray]
    start: dict[int, float]
    trees: dict[int, list[Tree]]


def learn(df: DataFrame, features: list[str], label: str, fold: str, models: list[int], rules: Boosting | None = None, cells: int = CELLS) -> Model:
    """One model for each fold in `models`, fitted on the rows outside it."""
    rules = rules or Boosting()
    names = [f"_x{i}" for i in range(len(features))]
    rows = df.select(F.col(label).cast("int").alias("_y"), F.col(fold).cast("int").alias("_fold"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, names, strict=True)])
    rows = rows.where("_y in (0, 1) and _fold is not null")
    cut = max(1, rows.count() // BIN_ROWS)
    sample = rows.where(F.pmod(F.xxhash64(*names, "_y", "_fold"), F.lit(cut)) == 0).select(*names).toArrow()
    edges = [bin_edges(sample[x].to_numpy(zero_copy_only=False).astype(np.float64)) for x in names]
    bins = _bin(rows, names, edges)
    table = materialise(bins.groupBy(*names, "_y", "_fold").agg(F.count("*").alias("_n")))
    share = {(r["_fold"], r["_y"]): r["n"] for r in table.groupBy("_fold", "_y").agg(F.sum("_n").alias("n")).collect()}  # two rows a fold
    counts = {m: [sum(n for (f, y), n in share.items() if f != m and y == c) for c in (0, 1)] for m in models}
    rate = {m: min(max(c[1] / sum(c) if sum(c) else 0.5, 1e-15), 1 - 1e-15) for m, c in counts.items()}
    start = {m: float(np.log(p / (1 - p))) for m, p in rate.items()}
    going = {m: start[m] for m in models if min(counts[m]) > 0}
    if not going or table.count() > cells:
        return Model(features, edges, start, _fit_levels(table, names, going, models, rules))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        if not (held := list(batches)):
            return
        block = pa.Table.from_batches(held)
        y, own, n = (block[c].to_numpy() for c in ("_y", "_fold", "_n"))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_block(_matrix(block, names), y, own, n, models, going, rules))], pa.binary())], ["trees"])

    import pickle

    got = table.coalesce(1).mapInArrow(work, "trees binary").collect()
    return Model(features, edges, start, pickle.loads(got[0]["trees"]))


def _bin(rows: DataFrame, names: list[str], edges: list[np.ndarray]) -> DataFrame:
    """The columns `names` as numbers of bins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [pa.array(binned(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64), e).astype(np.int16)) for c, e in zip(names, edges, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("_fold"), *bins], ["_y", "_fold", *names])

    return rows.mapInArrow(work, "_y int, _fold int, " + ", ".join(f"{c} short" for c in names))


def score(model: Model, df: DataFrame, fold: str, id_: str) -> DataFrame:
    """id_, fold, probability of the rows whose fold has a model."""
    rows = df.select(F.col(id_).alias("_id"), F.col(fold).cast("int").alias("_fold"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(model.features)])
    rows = rows.where(F.col("_fold").isin([int(m) for m in model.trees]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = np.array([binned(batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(np.float64), e) for i, e in enumerate(model.edges)]).reshape(len(model.edges), batch.num_rows)
            own = batch.column("_fold").to_numpy()
            raw = np.zeros(len(own))
            for m, trees in model.trees.items():
                at = np.flatnonzero(own == m)
                part = np.full(len(at), model.start[m])
                for t in trees:
                    add(part, columns[:, at], t)
                raw[at] = part
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_fold"), pa.array(1 / (1 + np.exp(-raw)))], ["_id", "_fold", "probability"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"_id {kind}, _fold int, probability double").select(F.col("_id").alias(id_), F.col("_fold").alias(fold), "probability")


def crossfit_boosted(df: DataFrame, features: list[str], label: str, fold: str, id_: str, models: list[int], rules: Boosting | None = None, cells: int = CELLS) -> DataFrame:
    """id_, fold, probability: rows of each fold in `models` scored by trees fitted on all other rows. A transfer from one site to another is one model whose fold is the other site."""
    return score(learn(df, features, label, fold, models, rules, cells), df, fold, id_)
