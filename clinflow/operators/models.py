"""Folds, cross-fitting and models on the Spark ML surface."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, Imputer, NGram, StandardScaler, Tokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinflow.functions.scalars import unit_interval
from clinflow.operators.ordered import positions
from clinflow.operators.ordering import hash_order
from clinflow.shared import materialise


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 20260924, name: str = "fold") -> DataFrame:
    """group, fold 1..folds: no group is in two folds, and groups with the same numbers of cases and rows are dealt round evenly.

    Groups are sorted inside classes of (cases, rows) by a seeded hash and dealt in turn, each class starting at a
    fold of its own. A class of any size is ordered range by range.
    """
    per = df.groupBy(group).agg(F.sum(F.col(label).cast("long")).alias("_c"), F.count("*").alias("_n"))
    start = F.floor(unit_interval(F.lit(seed), F.col("_c"), F.col("_n")) * folds).cast("int")
    placed = positions(per, [hash_order(seed, F.col(group)), group], ["_c", "_n"], "_place")
    return placed.select(group, (F.pmod(F.col("_place") + start, F.lit(folds)) + 1).cast("int").alias(name))


def repeated_folds(df: DataFrame, group: str, label: str, seeds: list[int], folds: int = 5) -> DataFrame:
    """group, repeat_1_fold, repeat_2_fold, ..."""
    out = None
    for i, seed in enumerate(seeds, 1):
        one = group_folds(df, group, label, folds, seed, f"repeat_{i}_fold")
        out = one if out is None else out.join(one, group)
    return out


def logistic(c: float, rows: int, **more) -> LogisticRegression:
    """L2 logistic regression; c is the inverse penalty of a sum of losses, so the penalty of their mean is 1 / (c * rows)."""
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (c * max(1, rows)), elasticNetParam=0.0, standardization=False, maxIter=200, **more)


def forest(seed: int = 1, trees: int = 100, depth: int = 12, least: int = 50) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="all", seed=seed)


def dense_stages(continuous: list[str], binary: list[str]) -> list:
    """Median imputation and scaling of continuous columns, binary ones beside them; fitted on training folds alone by way of the pipeline."""
    filled = [f"{c}_filled" for c in continuous]
    return [
        Imputer(strategy="median", inputCols=continuous, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_cont"),
        StandardScaler(inputCol="_cont", outputCol="_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_scaled", *binary], outputCol="features", handleInvalid="keep"),
    ]


def with_missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in columns})


def crossfit(df: DataFrame, stages: list, fold: str, id_: str, folds: int = 5) -> DataFrame:
    """id, fold, probability: each fold scored by a pipeline fitted on the others; every row exactly once."""
    df, out = materialise(df), None
    for k in range(1, folds + 1):
        model = Pipeline(stages=stages).fit(df.where(F.col(fold) != k))
        one = model.transform(df.where(F.col(fold) == k)).select(id_, fold, vector_to_array("probability")[1].alias("probability"))
        out = one if out is None else out.unionByName(one)
    return out


def source_proxy(df: DataFrame, features: list[str], source: str, value: str, fold: str, id_: str, penalty: float = 1.0, folds: int = 5) -> DataFrame:
    """n_cases, n_controls, auroc, average_precision of telling the source system from features that should not show it, out of fold."""
    from clinflow.operators.stats import auroc

    rows = df.withColumn("label", F.when(F.col(source) == value, 1.0).otherwise(0.0))
    got = crossfit(rows, [*dense_stages(features, []), logistic(penalty, rows.count())], fold, id_, folds)
    return auroc(got.join(rows.select(id_, "label"), id_), "label", "probability")


#: Columns that hold 0 or 1, and the prefix of one-hot note categories.
BINARY_COLUMNS = [
    "sex_male", "has_note", "treat_high_flow_any_6h", "treat_niv_any_6h", "treat_vasoactive_any", "treat_sedative_any",
    "code_status_available", "code_status_limitation", "code_status_comfort_or_no_cpr", "code_status_other",
]
CATEGORY_PREFIX = "note_category_"


def roles(columns: list[str]) -> dict[str, list[str]]:
    """Columns by role, each in the order given: continuous, binary (one-hot ones among them), category."""
    category = [c for c in columns if c.startswith(CATEGORY_PREFIX)]
    binary = [c for c in columns if c in BINARY_COLUMNS or c in category]
    return {"continuous": [c for c in columns if c not in binary], "binary": binary, "category": category}


def stacked(parts: list[str], name: str = "features") -> VectorAssembler:
    """Dense columns and sparse vectors side by side; the result stays sparse where that is shorter."""
    return VectorAssembler(inputCols=parts, outputCol=name)


def tfidf(train: DataFrame, df: DataFrame, text: str, words: int = 10_000, least: int = 5, most: float = 0.98) -> DataFrame:
    """df with `tfidf`: one- and two-word terms, accents removed, sublinear counts, smooth idf of the training rows, unit length; no text gives no terms."""
    ready = lambda d: d.withColumn("_t", F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), r"[^a-z0-9]+", " ")))

    def terms(d: DataFrame) -> DataFrame:
        d = Tokenizer(inputCol="_t", outputCol="_one").transform(ready(d)).withColumn("_one", F.filter("_one", lambda w: F.length(w) >= 2))
        d = NGram(n=2, inputCol="_one", outputCol="_two").transform(d)
        return d.withColumn("_terms", F.concat("_one", "_two"))

    rows = terms(train)
    n = rows.count()
    vector = CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=words, minDF=float(least), maxDF=most).fit(rows)
    vocabulary = vector.vocabulary
    names = df.sparkSession.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], "term string, i int")
    df_counts = rows.select(F.explode(F.array_distinct("_terms")).alias("term")).join(F.broadcast(names), "term").groupBy("i").count().collect()  # at most `words` rows
    idf = [0.0] * len(vocabulary)
    import math

    for r in df_counts:
        idf[r["i"]] = math.log((1 + n) / (1 + r["count"])) + 1
    from pyspark.ml.linalg import Vectors, VectorUDT

    shared = df.sparkSession.sparkContext.broadcast(idf)

    @F.udf(VectorUDT())
    def weigh(v):
        values = [(1 + math.log(x)) * shared.value[i] for i, x in zip(v.indices, v.values, strict=True)]
        norm = math.sqrt(sum(x * x for x in values)) or 1.0
        return Vectors.sparse(v.size, v.indices, [x / norm for x in values])

    return vector.transform(terms(df)).withColumn("tfidf", weigh("_counts")).drop("_t", "_one", "_two", "_terms", "_counts")


#: Accented letters and the letters they are read as.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def site_transfer(train: DataFrame, score: DataFrame, stages: list, id_: str) -> DataFrame:
    """id, probability of a site's rows by a pipeline fitted on another's, unchanged."""
    return Pipeline(stages=stages).fit(train).transform(score).select(id_, vector_to_array("probability")[1].alias("probability"))
