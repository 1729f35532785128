"""Queries that write small trees and tables from the given ones and read them back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.plans import fixtures as X
from clinflow.plans.register import Register
from clinflow.shared import new_path
from clinflow.sources import store
from clinflow.sources.resumable import Sink

R = Register()


def _packed(rows: DataFrame, top: str) -> None:
    """For each brand an archive with a table for each type, or (`_how` 1) a plain file in GB 18030."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        import zipfile

        where, base = store._open(top)
        brand, table = part["p_brand"].iloc[0], lambda d: d[["p_partkey", "name"]].to_csv(index=False)
        folder = f"{base}/{'plain1' if part['_how'].iloc[0] == 1 else 'zips'}"
        where.create_dir(folder, recursive=True)
        if part["_how"].iloc[0] == 1:
            with where.open_output_stream(f"{folder}/{brand}.csv") as out:
                out.write(table(part).encode("gb18030"))
        else:
            with where.open_output_stream(f"{folder}/{brand}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, own in part.groupby("p_type"):
                    z.writestr(f"tables/{name.replace(' ', '_')}.csv", table(own))
        return pd.DataFrame({"n": [len(part)]})

    rows.groupBy("p_brand", "_how").applyInPandas(pack, "n long").agg(F.sum("n")).collect()


def _tree(spark: SparkSession, sf_dir: str, packed: bool = False) -> str:
    """A folder with all of `part`: a third as gzipped UTF-8, a third as GB 18030 and a third in archives (packed: all in archives)."""
    top = new_path(spark)
    rows = X.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" é")).alias("name"), "p_brand", "p_type", (F.lit(2) if packed else F.col("p_partkey") % 3).cast("int").alias("_how"))
    if not packed:
        rows.where("_how = 0").select("p_partkey", "name").repartition(2).write.options(header=True, compression="gzip").csv(f"{top}/plain0")
    _packed(rows.where("_how > 0"), top)
    return top


@R.add("SELECT p_partkey, p_name || ' é' AS name FROM part", fixtures=False)
def csv_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two encodings, compressed or not, and tables inside archives through one scan, a task for each."""
    top = _tree(spark, sf_dir)
    paths = [p for p, _ in store.tree(spark, top, (".csv", ".csv.gz", ".zip"))]
    return store.scan(spark, paths, ["p_partkey", "name"]).select(F.col("p_partkey").cast(X.table(spark, sf_dir, "part").schema["p_partkey"].dataType).alias("p_partkey"), "name")


@R.add("SELECT 'plain' || k AS folder, 2 AS n_columns, 'p_partkey,name' AS columns FROM (SELECT unnest([0, 1]) AS k)", fixtures=False)
def tree_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a tree with their columns, a row for each folder and header."""
    got = store.inventory(spark, _tree(spark, sf_dir))
    return got.select(F.substring_index("path", "/", 1).alias("folder"), "n_columns", "columns").distinct()


@R.add("SELECT p_partkey FROM part", fixtures=False)
def unpacked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are streamed into a folder, whose tables Spark's own reader takes."""
    top, target = _tree(spark, sf_dir, packed=True), new_path(spark)
    store.unzip(spark, [p for p, _ in store.tree(spark, top, (".zip",))], target).agg(F.sum("bytes")).collect()
    rows = spark.read.option("header", True).csv([p for p, _ in store.tree(spark, target)])
    return rows.select(F.col("p_partkey").cast(X.table(spark, sf_dir, "part").schema["p_partkey"].dataType).alias("p_partkey"))


@R.add("SELECT o_orderkey, 1::BIGINT AS n_ok FROM orders", fixtures=False)
def resumed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a part of the orders in which some fail, and a second over all, which does what is left: each order is ok once."""
    sink = Sink(spark, new_path(spark), "o_orderkey")
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sink.append(orders.where("o_orderkey % 3 = 0"), lambda d: d.withColumn("status", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok")), parts=2)
    sink.append(orders, lambda d: d.withColumn("status", F.lit("ok")), parts=2)
    return sink.read().where("status = 'ok'").groupBy("o_orderkey").agg(F.count("*").alias("n_ok"))


QUERIES, ORACLE_SQL = R.queries, R.sql
