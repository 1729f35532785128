"""First rows, ranks, bins, samples and permutations by key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinflow.operators.ordered import positions
from clinflow.shared import materialise


def top_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order, which must settle ties. Orders of one time and one tie are cheaper by `latest` and `earliest`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Row with the greatest (time, tie) of each key; rows without a time count only if no other is there. One map-side combined aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def earliest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Row with the smallest (time, tie) of each key among rows with a time."""
    rest = [c for c in df.columns if c not in keys]
    return df.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(time, tie)).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def first_per_stay_then_subject(df: DataFrame, stay: str, subject: str, time: str, tie: str) -> DataFrame:
    return earliest(earliest(df, [stay], time, tie), [subject], time, tie)


def following(df: DataFrame, keys: list[str], time: str, tie: str, name: str) -> DataFrame:
    """df with the next row's time."""
    return df.withColumn(name, F.lead(time).over(Window.partitionBy(*keys).orderBy(time, tie)))


def latest_gap(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, gap_hours between the latest and the second-latest row; null with one row."""
    from clinflow.functions.scalars import hours

    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    two = df.where(F.col(time).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    return two.groupBy(*keys).agg(hours(F.max(F.when(F.col("_rn") == 1, F.col(time))), F.max(F.when(F.col("_rn") == 2, F.col(time)))).alias("gap_hours"))


def rank_deciles(df: DataFrame, value: str, tie: str, n: int = 10, name: str = "decile") -> DataFrame:
    """floor((position - 1) * n / rows) + 1 in the order of (value, tie)."""
    got = positions(df, [value, tie], name="_position", total="_total")
    return got.withColumn(name, (F.floor((F.col("_position") - 1) * n / F.col("_total")) + 1).cast("int")).drop("_position", "_total")


def quantile_bins(df: DataFrame, value: str, n: int = 10, name: str = "bin") -> DataFrame:
    """Bin 0 .. by exact quantile edges, repeated edges dropped, closed on the right, the least value in bin 0."""
    edges = df.agg(F.percentile(F.col(value), F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("e")).first()["e"]
    if edges is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    cut = sorted(set(edges))
    out = F.lit(len(cut) - 2)
    for i in range(len(cut) - 2, 0, -1):
        out = F.when(F.col(value) <= F.lit(cut[i]), i - 1).otherwise(out)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(out, F.lit(0))).cast("int"))


def hash_order(seed: int | str, *ids: Column) -> Column:
    """A value whose order is a permutation that depends on the seed alone."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]), 256)


def stratified_sample(df: DataFrame, strata: list[str], id_: str, n: int, seed: int = 1) -> DataFrame:
    """n rows of each stratum, or all where it has fewer."""
    w = Window.partitionBy(*strata).orderBy(hash_order(seed, F.col(id_)), id_)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def uniform_sample(df: DataFrame, id_: str, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(hash_order(seed, F.col(id_)), id_).limit(n)


def permuted(df: DataFrame, id_: str, seed: int = 1, name: str = "place") -> DataFrame:
    """df with the row's place from 1 in a seeded permutation."""
    return positions(df, [hash_order(seed, F.col(id_)), id_], name=name).withColumn(name, F.col(name).cast("int"))


def deranged(df: DataFrame, stratum: str, subject: str, id_: str, values: list[str], seed: int = 1) -> DataFrame:
    """df with each row's values taken from a row of another subject of its stratum.

    Rows of a stratum are ordered by subject and shifted around by the size of its largest subject, which
    moves every row past its own subject whenever no subject has more than half of the stratum; rows where that is so get nulls.
    """
    largest = df.groupBy(stratum, subject).agg(F.count("*").alias("_k")).groupBy(stratum).agg(F.max("_k").alias("_shift"), F.sum("_k").alias("_rows"))
    at = positions(df, [hash_order(seed, F.col(subject)), subject, hash_order(seed, F.col(id_)), id_], [stratum], "_at").withColumn("_at", F.col("_at") - 1)
    rows = materialise(at.join(largest, stratum))
    donors = rows.select(stratum, F.col("_at").alias("_from"), F.col(subject).alias("donor_subject"), *[F.col(v).alias(f"_d_{v}") for v in values])
    moved = rows.withColumn("_from", (F.col("_at") + F.col("_shift")) % F.col("_rows")).join(donors, [stratum, "_from"])
    other = F.col("donor_subject") != F.col(subject)
    kept = [c for c in df.columns if c not in values]
    return moved.select(*kept, F.when(other, F.col("donor_subject")).alias("donor_subject"), *[F.when(other, F.col(f"_d_{v}")).alias(v) for v in values])


def rows_hash(df: DataFrame, columns: list[str], sep: str = "\n", keys: list[str] | None = None) -> DataFrame:
    """keys, sha256 over the sorted rows, their columns joined by pipes (null as empty), rows joined by sep. Without keys an empty table gives the digest of nothing.

    A digest is read in one order, so a key's rows go to one task; there they are sorted outside memory and streamed into the digest one by one,
    so a key of any size takes no more memory than a small one.
    """
    keys = keys or []
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = df.select(F.struct(*keys).alias("_k") if keys else F.struct(F.lit(0).alias("_all")).alias("_k"), row.alias("_row"))
    rows = rows.withColumn("_key", F.to_json("_k", {"ignoreNullFields": "false"})).select("_key", "_row")
    dealt = (rows.repartition("_key") if keys else rows.repartition(1)).sortWithinPartitions("_key", "_row")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            for k, r in zip(batch.column("_key"), batch.column("_row"), strict=True):
                if (k := k.as_py()) != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["_key", "sha256"])
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(sep.encode())
                digest.update(r.as_buffer())
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["_key", "sha256"])

    got = dealt.mapInArrow(stream, "_key string, sha256 string")
    if not keys:
        return got.agg(F.coalesce(F.max("sha256"), F.lit(hashlib.sha256().hexdigest())).alias("sha256"))  # one row, or none
    return got.select(F.from_json("_key", df.select(*keys).schema).alias("k"), "sha256").select("k.*", "sha256")


def stratified_limit(df: DataFrame, label: str, id_: str, limit: int, positive: float = 0.25, seed: int = 1) -> DataFrame:
    """At most `limit` rows with that share of positives, at least two of them."""
    k = max(2, round(limit * positive))
    w = Window.partitionBy(label).orderBy(hash_order(seed, F.col(id_)), id_)
    return df.withColumn("_rn", F.row_number().over(w)).where(((F.col(label) == 1) & (F.col("_rn") <= k)) | ((F.col(label) == 0) & (F.col("_rn") <= limit - k))).drop("_rn")
