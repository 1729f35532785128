"""Exact duplicates by content sort, in DataFrame operations only.

Sampled splitters over (first code points of the normalised text, its digest, id) deal the rows to
buckets that are ranges of one order, in which equal texts are neighbours. Inside a bucket an external
sort puts the rows in that order and each text is compared in full with the one before it: a run of
equal texts begins where the comparison finds a difference. The first text of a bucket is compared in
full with the last one of the bucket before, so a run may go on through many buckets. Runs are numbered
through all buckets by sums of their counts, one small row per bucket. A bucket holds no more than its
share of rows even when a third of all rows are one text, because the splitters also cut along the id.
The digest orders rows and is returned; it decides nothing.

Null texts count as empty. Rows with the same text and the same id are told apart by nothing: the
group's size counts each of them and all of them that hold the kept id are marked kept; `dedup` keeps
one. Very long texts are sorted and compared whole. An empty table gives an empty result. Other columns
of the input are carried through `dedup` and ignored by `classes`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinflow.shared import join_hot, materialise

#: Code points of a text that the splitters look at.
PREFIX = 48
#: Rows sampled per bucket to choose the splitters, rows per bucket aimed at, and the most buckets (which bounds the sample).
SAMPLED, PER_BUCKET, MOST_BUCKETS = 16, 4_000, 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased and nothing else. Texts of single-byte characters take the faster lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _splitters(raw: DataFrame, count: int) -> list:
    """Sorted (prefix, digest, id) triples that cut the rows into buckets of about PER_BUCKET rows."""
    buckets = min(MOST_BUCKETS, max(8, count // PER_BUCKET))
    share = max(1, count // (buckets * SAMPLED))
    sample = raw.where(F.col("_id").isNotNull() & (F.pmod(F.xxhash64(F.substring("_x", 1, PREFIX), "_id"), F.lit(share)) == 0)).withColumn("_t", normalised(F.col("_x")))
    got = sorted((r[0].encode(), r[1], r[2], r[0]) for r in sample.select(F.substring("_t", 1, PREFIX), F.sha2("_t", 256), "_id").distinct().toLocalIterator())
    step = max(1, len(got) // buckets)
    return [(p, h, i) for _, h, i, p in got[step::step]]


def _differs(before: Column, text: Column) -> Column:
    """The comparison that decides: true where the text is not the one before it in full."""
    return ~before.eqNullSafe(text)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256. keep: 'min' or 'max' id stays.

    A null id sorts before every other and is kept only if its group has no other.
    """
    best = F.min if keep == "min" else F.max
    raw = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x"))
    cuts = _splitters(raw, docs.count())
    rows = raw.select("_id", normalised(F.col("_x")).alias("_t")).select("_id", "_t", F.substring("_t", 1, PREFIX).alias("_p"), F.sha2("_t", 256).alias("_h"))
    if cuts:
        at = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(h).alias("h"), F.lit(i).cast(docs.schema[id_col].dataType).alias("i")) for p, h, i in cuts])
        bucket = _rank(at, F.struct(F.col("_p").alias("p"), F.col("_h").alias("h"), F.col("_id").alias("i")), len(cuts))
    else:
        bucket = F.lit(0)
    order = Window.partitionBy("_b").orderBy("_p", "_h", "_id")
    first, last = F.lag("_h").over(order).isNull(), F.lead("_h").over(order).isNull()
    near = rows.withColumn("_b", bucket).select("*", first.alias("_first"), last.alias("_last"), F.lag("_t").over(order).alias("_before"))
    near = near.select(
        "_id", "_b", "_p", "_h", "_first", "_last", F.when(F.col("_first") | _differs(F.col("_before"), F.col("_t")), 1).otherwise(0).alias("_new"),
        F.when(F.col("_first") | F.col("_last"), F.col("_t")).alias("_edge"),
    )
    # materialised narrow: of the texts only those at the buckets' ends are read again
    runs = materialise(near.select("_id", "_b", "_h", "_first", "_last", "_edge", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_run")))
    per_run = runs.groupBy("_b", "_run").agg(best("_id").alias("_k"), F.count("*").alias("_n"))
    per_run = materialise(per_run.join(_offsets(runs), "_b").select((F.col("_base") + F.col("_run")).alias("_g"), "_b", "_run", "_k", "_n"))
    whole = per_run.groupBy("_g").agg(best("_k").alias("keep_id"), F.sum("_n").alias("group_size"))
    told = materialise(per_run.select("_g", "_b", "_run", "_n").join(whole, "_g").drop("_g"))
    out = join_hot(runs.select("_id", "_h", "_b", "_run"), told, ["_b", "_run"], "_n")
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_h").alias("text_sha256")
    )


def _offsets(runs: DataFrame) -> DataFrame:
    """_b, _base: what to add to the numbers of a bucket's runs, so that runs are numbered through all buckets and one that goes on over a bucket's end keeps its number.

    There are at most MOST_BUCKETS + 1 buckets, so the two windows over all of them see that many small rows; the texts at their ends are compared in a join.
    """
    along = Window.orderBy("_b")
    buckets = runs.groupBy("_b").agg(F.max("_run").alias("_runs"))
    buckets = materialise(buckets.select("_b", "_runs", F.lag("_b").over(along).alias("_left")))
    edge = lambda flag, name, key: runs.where(flag).select(F.col("_b").alias(key), F.col("_edge").alias(name))
    joined = buckets.join(edge("_first", "_t", "_b"), "_b").join(edge("_last", "_before", "_left"), "_left", "left")
    goes_on = F.when(F.col("_left").isNotNull() & ~_differs(F.col("_before"), F.col("_t")), 1).otherwise(0)
    joined = joined.select("_b", "_runs", goes_on.alias("_on"))
    before = F.coalesce(F.sum("_runs").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.select("_b", (before - F.sum("_on").over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("_base"))


def _rank(at: Column, key: Column, n: int) -> Column:
    """Number of splitters not after the key, by halving."""
    steps = max(1, n.bit_length())
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(at, mid) <= key)
        left = (s["lo"] < s["hi"]) & ~(F.get(at, mid) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs, in all their columns, that stay: of equal texts the one with the smallest (largest) id.

    Repeated rows (same id and text) stay once.
    """
    kept = classes(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("__kept_id"), F.col("text_sha256").alias("__kept_h"))
    stays = kept.distinct()
    repeated = kept.count() != stays.count()
    rows = docs.withColumn("__own_h", F.sha2(normalised(F.col(text_col)), 256))
    rows = rows.join(stays, F.col(id_col).eqNullSafe(F.col("__kept_id")) & (F.col("__own_h") == F.col("__kept_h")), "left_semi")
    return (rows.dropDuplicates([id_col, "__own_h"]) if repeated else rows).drop("__own_h")
