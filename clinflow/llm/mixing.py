"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's share of all tokens is raised to an exponent in 0..1 and normalised. The exponent is found
by bisection (section search: each round weighs SECTIONS exponents in one pass over the sources'
table, which is never collected) so that the weights' entropy reaches a target, or so that no source
is repeated more than a limit. The weights become token budgets. Each source is a row of
blocks, each a permutation by hash; full passes take every block, the last pass takes blocks in their
permuted order, and of the block in which the budget ends, documents in permuted order up to it. A
block has a bounded number of rows, so a source with a third of all rows is many blocks.

Tokens are words (runs without white space). Null and empty texts have none; a source without tokens
keeps each document once. A null source is a source of its own. Repeated rows are documents of their
own. An empty table gives an empty result. The columns that `mix` adds are mix_pass, mix_block and
mix_rank; columns of these names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinflow.shared import join_hot, materialise

SPACE = " \\t\\n\\x0B\\f\\r"
#: Exponents weighed at once, rounds (each narrows the range SECTIONS + 1 times), rows of a block aimed at.
SECTIONS, ROUNDS, BLOCK = 31, 5, 2_000
ADDED = ["mix_pass", "mix_block", "mix_rank"]


def tokens(text: Column) -> Column:
    """Words of a text."""
    text = F.coalesce(text, F.lit(""))
    return F.greatest(F.lit(0), F.size(F.split(F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", ""), f"[{SPACE}]+")) - F.when(F.length(F.regexp_replace(text, f"^[{SPACE}]+", "")) == 0, 1).otherwise(0)).cast("long")


def source_table(rows: DataFrame, source: str = "_source") -> DataFrame:
    """_source, rows, tokens of every source."""
    return rows.groupBy(source).agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))


def find_exponent(sources: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """Exponent for the target.

    entropy: of the weights, in shares of the largest possible (0..1); the largest exponent that reaches it.
    repetition: most passes over any source when the least repeated has one pass; the smallest exponent that keeps to it.
    Exponent 1 (natural shares) has one pass over each source; 0 is even weights.
    """
    lo, hi = 0.0, 1.0
    have = sources.where("tokens > 0")
    head = have.agg(F.sum("tokens"), F.count("*"), F.max(F.log("tokens")), F.min(F.log("tokens"))).first()
    if not head[1] or head[1] == 1:
        return 1.0
    total, n, top, least = float(head[0]), int(head[1]), float(head[2]), float(head[3])
    if repetition is not None:
        # passes of a source are w_i / tokens_i up to a factor, so the most over the least is (top / least)^(1 - exponent)
        spread = top - least
        reached = lambda a: (1 - a) * spread <= _ln(repetition)
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if reached(mid) else (mid, hi)
        return hi
    target = entropy * _ln(n)
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * (i + 1) / (SECTIONS + 1) for i in range(SECTIONS)]
        x = F.log(F.col("tokens") / F.lit(total))
        got = have.select(x.alias("x"), F.explode(F.array(*[F.lit(g) for g in grid])).alias("a")).groupBy("a").agg(F.sum(F.exp(F.col("a") * F.col("x"))).alias("z"), F.sum(F.col("a") * F.col("x") * F.exp(F.col("a") * F.col("x"))).alias("s"))
        reached = {r["a"]: _ln(r["z"]) - r["s"] / r["z"] >= target for r in got.collect()}  # SECTIONS rows
        good = [g for g in grid if reached[g]]
        lo, hi = max([lo, *good]), min([hi, *[g for g in grid if not reached[g]]])
    return lo


def _ln(x: float) -> float:
    import math

    return math.log(max(x, 1e-300))


def weights(sources: DataFrame, exponent: float, budget: float | str = "cover") -> DataFrame:
    """sources with weight, budget (tokens) and passes (budget / tokens).

    budget: tokens in all, or 'cover': as many as give the least repeated source one whole pass, so that no document is left out.
    """
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))).otherwise(0.0)
    z = sources.agg(F.sum(raw).alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / raw)).alias("c")).first()
    z, cover = z["z"] or 1.0, z["c"] or 1.0
    whole = F.lit(float(cover * z)) if budget == "cover" else F.lit(float(budget))
    out = sources.withColumn("weight", raw / F.lit(float(z))).withColumn("budget", F.col("weight") * whole)
    # a hair above a whole number of passes is that number
    passes = F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(1.0)
    return out.withColumn("passes", F.when(F.abs(passes - F.round(passes)) < 1e-9, F.round(passes)).otherwise(passes))


def plan(docs: DataFrame, entropy: float | None = None, repetition: float | None = 1.5, budget: float | str = "cover", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 3) -> DataFrame:
    """_id, _key (hash of the row), _source, tokens, weight, passes, copies, block, part: how often each row appears in the mix."""
    return _planned(materialise(_rows(docs, id_col, text_col, source_col, seed)), entropy, repetition, budget)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col), F.col(source_col).cast("string"))
    return docs.select(F.col(id_col).alias("_id"), key.alias("_key"), F.col(source_col).alias("_source"), tokens(F.col(text_col)).alias("tokens"))


def _planned(rows: DataFrame, entropy: float | None, repetition: float | None, budget: float | str) -> DataFrame:
    sources = materialise(source_table(rows))
    told = materialise(weights(sources, find_exponent(sources, entropy, repetition if entropy is None else None), budget).withColumn("blocks", F.ceil(F.col("rows") / BLOCK)))
    placed = join_hot(rows, told.select("_source", "rows", "weight", "budget", "passes", "blocks"), ["_source"], "rows").drop("rows")
    # blocks and the places in them are permutations by hash
    placed = materialise(placed.withColumn("block", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("blocks"))))
    own = ["_source", "block"]
    sums = placed.groupBy(*own).agg(F.sum("tokens").alias("block_tokens"), F.first("budget").alias("budget"), F.first("passes").alias("passes"))
    order = Window.partitionBy("_source").orderBy(F.xxhash64("block", F.lit(2)), "block").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("budget") * (1 - F.floor("passes") / F.col("passes"))  # tokens of the last, partial pass
    sums = sums.withColumn("left", whole - F.coalesce(F.sum("block_tokens").over(order), F.lit(0)))
    within = Window.partitionBy("_source", "block").orderBy(F.xxhash64("_key", F.lit(3)), "_key", "_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0))).withColumn("part", F.count("*").over(within))
    joined = ranked.alias("l").join(
        sums.select("_source", "block", "left").alias("r"), F.col("l._source").eqNullSafe(F.col("r._source")) & (F.col("l.block") == F.col("r.block"))
    )
    last = (F.col("r.left") > 0) & (F.col("l.before") < F.col("r.left")) & (F.col("l.tokens") > 0)
    return joined.select("l._id", "l._key", "l._source", "l.tokens", "l.weight", "l.passes", (F.floor("l.passes") + F.when(last, 1).otherwise(0)).cast("int").alias("copies"), "l.block", "l.part")


def mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = 1.5, budget: float | str = "cover", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 3) -> DataFrame:
    """docs, each row as often as the plan says, with mix_pass, mix_block and mix_rank; sort by these for the mixed order.

    Rows that repeat have the same number of copies: their share of the sum, rounded up.
    """
    clash = [c for c in ADDED if c in docs.columns]
    docs = docs.drop(*clash)
    rows = materialise(_rows(docs, id_col, text_col, source_col, seed))
    planned = _planned(rows, entropy, repetition, budget)
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col), F.col(source_col).cast("string"))
    by_key = planned.groupBy("_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_same"), F.first("block").alias("mix_block"), F.first("part").alias("mix_rank"))
    # rows that repeat share the sum of their copies evenly, rounded up
    out = docs.withColumn("__key", key).join(by_key.where("_copies > 0").withColumnsRenamed({"_key": "__key", "_copies": "__copies", "_same": "__same"}), "__key")
    number = F.ceil(F.col("__copies") / F.col("__same")).cast("int")
    return out.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), number))).select(*docs.columns, "mix_pass", "mix_block", "mix_rank")
