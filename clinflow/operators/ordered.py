"""Orders that no task sees whole: ranges of one order, what each range holds, and what is carried over its borders.

`sliced` deals rows by ranges of (keys, order) and writes them once, so ranges stay what they are. A window then
runs inside a range and key; one small row for each range and key (`carried`) adds what lies before or after. A
key with any share of all rows is spread over as many ranges as its rows fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinflow.shared import materialise


def sliced(df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """df with `_part`, the number of its range of (keys, order). Rows equal in all of these are in one range."""
    by = [*keys, *order]
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()))


def carried(slices: DataFrame, keys: list[str], values: dict[str, Column], over: dict[str, tuple[Column, bool]]) -> DataFrame:
    """slices with columns of `over`, each an aggregate (Column over names of `values`) of the key's ranges before (or, if true, after) the row's own.

    values: aggregates of a range and key. The windows see a row for each range that a key is in.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    per = slices.groupBy(F.col("_part").alias("_whose"), *[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]).agg(*[c.alias(name) for name, c in values.items()])
    before = Window.partitionBy(*own).orderBy("_whose").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*own).orderBy(F.desc("_whose")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_whose", *own, *[c.over(later if ahead else before).alias(name) for name, (c, ahead) in over.items()])
    same = F.col("_part") == F.col("_whose")
    for k, o in zip(keys, own, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    return slices.join(per, same).select(*slices.columns, *over)


def positions(df: DataFrame, order: list[str | Column], keys: list[str] | None = None, name: str = "position", total: str | None = None) -> DataFrame:
    """df with each row's place from 1 in the order, of its key where keys are given. total: a column with the key's rows."""
    keys = keys or []
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, order, strict=True)})
    over = {"_before": (F.sum("_rows"), False)} | ({"_after": (F.sum("_rows"), True)} if total else {})
    got = carried(sliced(rows, keys, names), keys, {"_rows": F.count("*")}, over)
    own = Window.partitionBy("_part", *keys)
    got = got.withColumn(name, F.row_number().over(own.orderBy(*names)) + F.coalesce("_before", F.lit(0)))
    if total:
        got = got.withColumn(total, F.count("*").over(own) + F.coalesce("_before", F.lit(0)) + F.coalesce("_after", F.lit(0)))
    return got.select(*df.columns, name, *([total] if total else []))


def next_after(left: DataFrame, right: DataFrame, key: str, t: str, u: str, name: str = "next_time") -> DataFrame:
    """left with the first time of right, of the same key, strictly after its own; null where there is none or its own is null. Linear in the rows, whatever a key's share."""
    rows = left.withColumn("_t", F.col(t)).withColumn("_side", F.lit(0))
    times = right.select(key, F.col(u).alias("_t"), F.lit(1).alias("_side"))
    both = sliced(rows.unionByName(times, allowMissingColumns=True), [key], ["_t"])
    seen = F.when(F.col("_side") == 1, F.col("_t"))
    both = carried(both, [key], {"_first": F.min(seen)}, {"_ahead": (F.min("_first"), True)})
    # descending: rows of left come before equal times of right, so only later ones are seen
    w = Window.partitionBy("_part", key).orderBy(F.col("_t").desc(), F.col("_side").asc()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn(name, F.when(F.col("_t").isNotNull(), F.coalesce(F.min(seen).over(w), F.col("_ahead"))))
    return both.where("_side = 0").select(*left.columns, name)


def nearest(left: DataFrame, right: DataFrame, key: str, t: str, u: str) -> DataFrame:
    """left with previous_time (at or before) and following_time (at or after) of right by key, null where there is none."""
    rows = left.withColumn("_t", F.col(t)).withColumn("_side", F.lit(0))
    times = right.select(key, F.col(u).alias("_t"), F.lit(1).alias("_side"))
    both = sliced(rows.unionByName(times, allowMissingColumns=True), [key], ["_t"])
    seen = F.when(F.col("_side") == 1, F.col("_t"))
    both = carried(both, [key], {"_first": F.min(seen), "_last": F.max(seen)}, {"_back": (F.max("_last"), False), "_ahead": (F.min("_first"), True)})
    inside = Window.partitionBy("_part", key)
    up, down = (inside.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow) for c in (F.col("_t").asc(), F.col("_t").desc()))
    known = lambda c: F.when(F.col("_t").isNotNull(), c)
    both = both.withColumn("previous_time", known(F.coalesce(F.max(seen).over(up), F.col("_back")))).withColumn("following_time", known(F.coalesce(F.min(seen).over(down), F.col("_ahead"))))
    return both.where("_side = 0").select(*left.columns, "previous_time", "following_time")
