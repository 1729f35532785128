"""Greedy matching: the choices of one pass over all cases, block beside block, and in rounds where a block is large.

A block of at most PASS rows is gone through in one task, case by case, with the free controls in the order of the clock:
a case looks at those nearest to it and at more only while it lacks subjects. Larger blocks go in rounds. Where controls are scarce a
round settles few cases, so rounds are for what one task should not hold.

In a pass a case takes its k best controls that no earlier case has taken, or none. Which controls it takes depends on
earlier cases only through the subjects that these may take. A round therefore

1. gives every open case its LIST best subjects, from tasks that each hold a time slice of a block's controls;
2. goes through the open cases of a block in chunks of their order, chunk beside chunk. A case is settled if its k
   best subjects cannot be taken by an earlier open case; another one may take any subject up to the k-th that is safe
   for it, and later cases beware of those. What the cases of a chunk may take is told to later chunks until
   nothing changes;
3. marks what settled cases took as used.

The first open case of every block is always settled, so rounds end; with one chunk a block a round settles nearly all.
The result is that of the one pass, for any blocks, partitions and chunks. No task holds more than SLICE controls
or CHUNK cases with their lists, whatever a block's size.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinflow.functions.scalars import unit_interval
from clinflow.operators.ordered import positions
from clinflow.shared import materialise

#: Best subjects of a case that a round looks at (for each control wanted), controls and cases of a task.
LIST, SLICE, CHUNK = 8, 50_000, 2_000
#: Cases and controls of a block that one task goes through.
PASS = 500_000


def _best(case: tuple, pool: dict[str, np.ndarray], k: int, near: float, far: float, category: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Positions in the pool of the case's best row of each of its k best subjects, their priorities and distances, and whether there are more."""
    clock, subject, own_category = case
    lo, hi = pool["clock"].searchsorted(clock - far, "left"), pool["clock"].searchsorted(clock + far, "right")
    d = np.abs(pool["clock"][lo:hi] - clock)
    late = (d > near).astype(np.int64)
    if category:
        late += 2 * (pool["category"][lo:hi] != own_category) if own_category is not None else 2
    at = np.flatnonzero(pool["subject"][lo:hi] != subject)
    want, more = 4 * k, False
    while True:
        some = at
        if len(at) > want:
            rank = late[at] * (2 * far + 1) + d[at]
            some = at[rank <= np.partition(rank, want)[want]]  # ties stay together
        order = some[np.lexsort((pool["place"][lo:hi][some], pool["jitter"][lo:hi][some], d[some], late[some]))]
        first = np.sort(np.unique(pool["subject"][lo:hi][order], return_index=True)[1])
        if len(first) > k or len(some) == len(at):
            more = len(first) > k or more
            order = order[first[:k]]
            return lo + order, late[order], d[order], more
        want *= 4


def _settle(cases: Iterable[tuple], k: int, shut: bool = False) -> tuple[list, set, bool]:
    """cases: (name, subject, may the subject be taken from outside, rows of (key, subject, claimed from outside), complete) in order.

    Returns (name, rows taken) of settled cases, all subjects that any case may take, and whether a case may take others besides. shut: an earlier chunk has such a case.
    """
    done, taken, maybe = [], set(), set()
    cases = list(cases)
    every = lambda some: {r[1] for c in some for r in c[3]} | {c[1] for c in some}
    if shut:
        return done, every(cases), True
    for i, (name, own, own_claimed, rows, complete) in enumerate(cases):
        if own in taken:
            done.append((name, []))
            continue
        free = [r for r in rows if r[1] not in taken]
        if complete and len(free) < k:
            done.append((name, []))
            continue
        may, safe, unsure = [], 0, own_claimed or own in maybe
        for r in free:
            may.append(r)
            if r[2] or r[1] in maybe:
                unsure = True
            else:
                safe += 1
            if safe == k:
                break
        if safe < k and not complete:  # may take subjects beyond its list: nothing after it can be settled now
            return done, taken | maybe | every(cases[i:]), True
        if unsure or safe < k:
            maybe |= {r[1] for r in may} | {own}
        else:
            done.append((name, may))
            taken |= {r[1] for r in may} | {own}
    return done, taken | maybe, False


class _Free:
    """Rows in the order of the clock; `at` are their places in the block's columns."""

    def __init__(self, at: np.ndarray, clock: np.ndarray):
        self.at = at[np.argsort(clock[at], kind="stable")]
        self.clock = clock[self.at]

    def keep(self, free: np.ndarray) -> None:
        self.at, self.clock = self.at[free[self.at]], self.clock[free[self.at]]


def _one_pass(cases: pd.DataFrame, rows: pd.DataFrame, k: int, near: float, far: float, category: bool) -> list[tuple[int, list[tuple[int, float, int]]]]:
    """Matched cases of one block, in order: the case's place, and place, distance and priority of each of its rows."""
    subjects = pd.factorize(pd.concat([cases["subject_id"], rows["subject_id"]], ignore_index=True), use_na_sentinel=False)[0]
    own, subject = subjects[: len(cases)], subjects[len(cases) :]
    kinds = {c: pd.factorize(pd.concat([cases[c], rows[c]], ignore_index=True))[0] for c in ("category", "exact")}
    if rows["exact"].isna().all():  # not asked for
        kinds["exact"][:] = 0
    clock, jitter, place = rows["clock"].to_numpy(), rows["jitter"].to_numpy(), rows["id"].rank(method="first").to_numpy()
    group, sort = kinds["exact"][len(cases) :], kinds["category"][len(cases) :]
    used = np.zeros(int(subjects.max()) + 1, bool)
    pools: dict[tuple, _Free] = {}
    taken = 0

    def pool(e: int, c: int | None) -> _Free:
        if (e, c) not in pools:
            here = (group == e) & ~used[subject]
            pools[e, c] = _Free(np.flatnonzero(here if c is None else here & (sort == c)), clock)
        return pools[e, c]

    def nearest(some: _Free, t: float, banned: list[int], want: int, other: int | None) -> np.ndarray:
        """Places of the best row of each of the `want` best subjects by distance, jitter and id."""
        reach = far / 64
        while True:
            whole = reach >= far
            reach = min(reach, far)
            lo, hi = some.clock.searchsorted(t - reach, "left"), some.clock.searchsorted(t + reach, "right")
            at = some.at[lo:hi]
            good = ~used[subject[at]]
            for b in banned:
                good &= subject[at] != b
            if other is not None:
                good &= sort[at] != other
            at = at[good]
            if len(at) >= want or whole:
                d = np.abs(clock[at] - t)
                order = np.lexsort((place[at], jitter[at], d))
                first = np.sort(np.unique(subject[at[order]], return_index=True)[1])[:want]
                # what lies at the edge of the reach may have equals beyond it
                if whole or len(first) == want and d[order[first[-1]]] < 0.99 * reach:
                    return at[order[first]]
            reach *= 4

    out = []
    for i, (t, me, c, e) in enumerate(zip(cases["clock"].to_numpy(), own, kinds["category"][: len(cases)], kinds["exact"][: len(cases)], strict=True)):
        if used[me] or e < 0:
            continue
        if not category:
            got, late = nearest(pool(e, None), t, [me], k, None), 0
        else:
            got = nearest(pool(e, c), t, [me], k, None) if c >= 0 else np.zeros(0, int)
            late = np.zeros(len(got), int)
            if len(got) < k:
                more = nearest(pool(e, None), t, [me, *subject[got]], k - len(got), c if c >= 0 else None)
                got, late = np.append(got, more), np.append(late, np.full(len(more), 2))
        if len(got) < k:
            continue
        d = np.abs(clock[got] - t)
        out.append((i, list(zip(got.tolist(), d.tolist(), (late + (d > near)).tolist(), strict=True))))
        used[subject[got]] = used[me] = True
        taken += k
        if taken * 8 > len(rows):  # rows of used subjects are dropped now and then
            taken, free = 0, ~used[subject]
            for some in pools.values():
                some.keep(free)
    return out


def _passed(cases: DataFrame, pool: DataFrame, tasks: int, k: int, near: float, far: float, category: bool, id_type: str, subject_type: str) -> DataFrame:
    """Matched rows of blocks that are gone through in a task each."""
    names = ["match_set", "id", "subject_id", "label", "distance", "match_priority"]

    def work(_: tuple, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(rows):
            return pd.DataFrame(columns=names)
        own = own.sort_values("ord").reset_index(drop=True)
        case_id, case_subject, id_, subject = own["id"].tolist(), own["subject_id"].tolist(), rows["id"].tolist(), rows["subject_id"].tolist()
        out = []
        for i, got in _one_pass(own, rows, k, near, far, category):
            out.append((str(case_id[i]), case_id[i], case_subject[i], 1, 0.0, 0))
            out += [(str(case_id[i]), id_[at], subject[at], 0, d, late) for at, d, late in got]
        return pd.DataFrame(out, columns=names)

    kind = f"match_set string, id {id_type}, subject_id {subject_type}, label int, distance double, match_priority int"
    both = [d.repartition(tasks, "block").groupBy("block") for d in (cases, pool)]  # by number, as few bytes would be put together in one task
    return both[0].cogroup(both[1]).applyInPandas(work, kind)


def match(cases: DataFrame, controls: DataFrame, block: str, clock: str, k: int = 3, near: float = 6.0, far: float = 12.0, seed: int = 1, order: str = "hardest", category: str | None = None, exact: str | None = None) -> DataFrame:
    """match_set, id, subject_id, label, distance: greedy 1:k matching by distance on the clock, all or nothing, without replacement of subjects.

    cases, controls: id, subject_id, block, clock. A case looks at unused controls of its block within `far` hours, those within
    `near` first, then by distance and seeded jitter. order: 'hardest' takes cases by falling clock, 'sorted' by id.
    category: a column; cases then go by category, clock and subject, and look at controls of their own category first, within `near` and then within `far` hours,
    before those of others within `near` and then `far`; a null category is like no other. The match_priority (0 to 3) is then in the result.
    exact: a column that controls share with their case; cases go by it first. A subject with rows in several blocks may be taken once in each: where that must not be, make blocks of whole subjects.
    Ids are distinct. Rows without a clock or block are left out.
    """
    own = [F.col(c).cast("string").alias(n) if c else F.lit(None).cast("string").alias(n) for c, n in ((category, "category"), (exact, "exact"))]
    plain = lambda d: d.select("id", "subject_id", F.col(block).alias("block"), F.col(clock).cast("double").alias("clock"), *own).where("block is not null and clock is not null")
    id_type, subject_type, block_type = (dict(plain(cases).dtypes)[c] for c in ("id", "subject_id", "block"))
    by = ["category", "clock", "subject_id", "id"] if category else ["clock", "id"] if order == "hardest" else ["id"]
    falling = order == "hardest" and not category
    by = [x for c in (["exact", *by] if exact else by) for x in ([-F.col(c)] if c == "clock" and falling else [F.col(c).isNull(), F.col(c)])]
    waiting = materialise(positions(plain(cases), by, ["block"], "ord"))
    pool = plain(controls).withColumn("jitter", unit_interval(F.lit(seed), F.col("id"))).withColumn("slice", F.floor(F.col("clock") / max(far, 1e-9)))
    if exact:
        pool = pool.where("exact is not null")
    pool = materialise(pool)
    sizes = materialise(waiting.select("block").unionAll(pool.select("block")).groupBy("block").agg((F.count("*") > PASS).alias("large")))
    small, large = (sizes.where(c).count() for c in ("not large", "large"))
    names = ["match_set", "id", "subject_id", "label", "distance", *(["match_priority"] if category else [])]
    whole = None
    if small:
        tasks = min(4 * small, int(waiting.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        only = (lambda d: d.join(F.broadcast(sizes.where("large")), "block", "left_anti")) if large else (lambda d: d)  # of large blocks there are at most rows / PASS
        whole = _passed(only(waiting), only(pool), tasks, k, near, far, bool(category), id_type, subject_type).select(*names)
        if not large:
            return materialise(whole)
        waiting, pool = (materialise(d.join(F.broadcast(sizes.where("large")), "block", "left_semi")) for d in (waiting, pool))
    place = ["block", *(["exact"] if exact else []), "slice"]
    salts = materialise(pool.groupBy(*place).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("salts")))
    pool = pool.join(salts, place).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts").cast("long"))).drop("salts")
    used, out = None, None
    while waiting.limit(1).count():
        free = pool if used is None else pool.join(used, ["block", "subject_id"], "left_anti")
        lists = materialise(_lists(waiting, free, salts, place, k * LIST, near, far, bool(category), id_type, subject_type, block_type))
        settled = _round(waiting, lists, k, k * LIST, id_type, subject_type, block_type)
        got = settled.where("id is not null")
        out = got if out is None else out.unionByName(got)
        taken = got.select("block", "subject_id").distinct()
        used = materialise(taken if used is None else used.unionByName(taken))
        # a case whose subject was taken as a control is not matched
        waiting = materialise(waiting.join(settled.where("head").select("block", "ord"), ["block", "ord"], "left_anti").join(used, ["block", "subject_id"], "left_anti").select(*waiting.columns))
    if out is None:
        out = cases.sparkSession.createDataFrame([], f"match_set string, id {id_type}, subject_id {subject_type}, label int, distance double, match_priority int")
    return out.select(*names) if whole is None else out.select(*names).unionByName(materialise(whole))


def _lists(waiting: DataFrame, free: DataFrame, salts: DataFrame, place: list[str], length: int, near: float, far: float, category: bool, id_type: str, subject_type: str, block_type: str) -> DataFrame:
    """block, ord, id, subject_id, late, d, jitter, more: up to `length` best rows of each open case from each slice and salt near it."""
    looks = waiting.withColumn("slice", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(F.col("clock") / max(far, 1e-9)) + i)))
    looks = looks.join(salts, place).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).drop("salts")
    keys = [*place, "salt"]

    def look(_: tuple, cases: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["block", "ord", "id", "subject_id", "late", "d", "jitter", "more"]
        if not len(cases) or not len(rows):
            return pd.DataFrame(columns=names)
        rows = rows.sort_values(["clock", "id"]).reset_index(drop=True)
        table = {"clock": rows["clock"].to_numpy(), "jitter": rows["jitter"].to_numpy(), "subject": rows["subject_id"].to_numpy(), "category": rows["category"].to_numpy(object), "place": rows["id"].rank(method="first").to_numpy()}
        parts = []
        for c in cases.itertuples():
            at, late, d, more = _best((c.clock, c.subject_id, c.category), table, length, near, far, category)
            part = rows.iloc[at][["block", "id", "subject_id", "jitter"]].assign(ord=c.ord, late=late, d=d, more=more)
            parts.append(part)
        return pd.concat(parts)[names]

    kind = f"block {block_type}, ord long, id {id_type}, subject_id {subject_type}, late int, d double, jitter double, more boolean"
    return looks.groupBy(*keys).cogroup(free.groupBy(*keys)).applyInPandas(look, kind)


def _round(waiting: DataFrame, lists: DataFrame, k: int, length: int, id_type: str, subject_type: str, block_type: str) -> DataFrame:
    """Rows of the cases settled in this round: a head row for each (with null id if it stays without controls), and its controls."""
    heads = waiting.select("block", "ord", "id", "subject_id", F.lit(None).cast("int").alias("late"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("double").alias("jitter"), F.lit(False).alias("more"), F.lit(True).alias("head"))
    rows = heads.unionByName(lists.withColumn("head", F.lit(False))).withColumn("chunk", F.floor((F.col("ord") - 1) / CHUNK))
    rows = materialise(rows)
    names = ["block", "ord", "match_set", "id", "subject_id", "label", "distance", "match_priority", "head", "claim"]
    kind = f"block {block_type}, ord long, match_set string, id {id_type}, subject_id {subject_type}, label int, distance double, match_priority int, head boolean, claim boolean"

    def simulate(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["head"]].sort_values("ord").set_index("ord")
        found = group[~group["head"]].sort_values(["ord", "late", "d", "jitter", "id"]).drop_duplicates(["ord", "subject_id"])
        more = found.groupby("ord")["more"].any().to_dict()
        by_case: dict[int, list] = {}
        for r in zip(found["ord"], found["id"], found["subject_id"], found["outside"], found["d"], found["late"], strict=True):
            by_case.setdefault(r[0], []).append(((r[1], r[4], r[5]), r[2], r[3]))
        todo = []
        for o, subject, outside in zip(own.index, own["subject_id"], own["outside"], strict=True):
            whole = by_case.get(o, [])
            todo.append((o, subject, outside, whole[:length], not more.get(o, False) and len(whole) <= length))
        done, claims, beyond = _settle(todo, k, bool(group["shut"].iloc[0]))
        block, out = group["block"].iloc[0], []
        for o, took in done:
            name, case = str(own.at[o, "id"]), (own.at[o, "id"], own.at[o, "subject_id"]) if took else (None, None)
            out.append((block, o, name, *case, 1, 0.0, 0, True, False))
            out += [(block, o, name, key[0], subject, 0, float(key[1]), int(key[2]), False, False) for key, subject, _ in took]
        out += [(block, own.index[0], None, None, s, None, None, None, False, True) for s in [*claims, *([None] if beyond else [])]]
        got = pd.DataFrame(out, columns=names)
        return got.astype({c: "Int64" for c in ("label", "match_priority")})

    several = bool(rows.groupBy("block").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").limit(1).count())
    claims, count = None, -1
    while True:
        if claims is None:
            told = rows.withColumn("outside", F.lit(False)).withColumn("shut", F.lit(False))
        else:  # a claim of no subject is one of any subject
            first = claims.where("subject_id is not null").groupBy("block", "subject_id").agg(F.min("chunk").alias("_first"))
            wide = claims.where("subject_id is null").groupBy("block").agg(F.min("chunk").alias("_wide"))
            earlier = lambda c: F.coalesce(F.col(c) < F.col("chunk"), F.lit(False))
            told = rows.join(first, ["block", "subject_id"], "left").join(wide, "block", "left").withColumn("outside", earlier("_first")).withColumn("shut", earlier("_wide")).drop("_first", "_wide")
        got = materialise(told.groupBy("block", "chunk").applyInPandas(simulate, kind))
        if not several:
            return got.where("not claim").drop("claim")
        claims = materialise(got.where("claim").select("block", "subject_id", F.floor((F.col("ord") - 1) / CHUNK).alias("chunk")))
        if (now := claims.count()) == count:  # claims only grow, so an equal number is the same claims
            return got.where("not claim").drop("claim")
        count = now
