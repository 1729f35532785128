"""The corpus pipeline: toxicity, exact duplicates, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clinflow.llm import exact_dedup, mixing, near_dedup, packing, queries, toxicity
from clinflow.shared import made, new_path, release

#: The mix repeats no source more than so many times as often as the least repeated, which is taken whole once.
REPETITION = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the lexicon is learnt from the labelled documents outside fold 0. Null texts match nothing and stay; repeated rows are judged each; an empty table stays empty."""
    return toxicity.without_toxic(docs, queries.toxic_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id. Null texts are equal to empty ones; repeated rows stay once; an empty table stays empty."""
    return exact_dedup.dedup(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id. Null and empty texts are classes of their own; an empty table stays empty."""
    return near_dedup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, documents of scarce sources in up to REPETITION passes. Null sources are one source; an empty table stays empty."""
    return mixing.mix(docs, repetition=REPETITION, budget="cover").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens. A null text is its end token alone; an empty table gives no piece."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The stages train a model, sample consistently and tokenize, which SQL cannot express; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again. Columns of any name are carried to the last stage; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = made()
    for _, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := new_path(spark))
        release(spark, begun, keep=(path,))  # the stage's own tables and the stage before
        docs = spark.read.parquet(path)
    return docs
