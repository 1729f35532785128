"""Choosing rows and items: by dictionaries, maps of ids, sources and availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.operators.joins import set_differences, unique_on
from clinflow.operators.text import mentions, normal


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is null."""
    return df.na.drop(subset=columns)


def flat_ids(mapping: dict) -> set[int]:
    """All whole numbers in the lists of a nested mapping; truth values are none."""
    found: set[int] = set()
    for inner in mapping.values():
        found |= flat_ids(inner) if isinstance(inner, dict) else {int(x) for x in inner if isinstance(x, int) and not isinstance(x, bool)} if isinstance(inner, list) else set()
    return found


def id_map(spark: SparkSession, mapping: dict[str, list[int]], name: str = "name", item: str = "itemid") -> DataFrame:
    """item, name of a mapping from names to ids; an id under two names, or twice, is an error."""
    rows = [(int(i), n) for n, ids in mapping.items() for i in ids]
    if repeated := {i for i, _ in rows if sum(i == j for j, _ in rows) > 1}:
        raise ValueError(f"mapped more than once: {sorted(repeated)}")
    return spark.createDataFrame(rows, f"{item} long, {name} string")


def gated(events: DataFrame, allowed: dict[str, dict], source: str = "dbsource", item: str = "itemid") -> DataFrame:
    """Events whose item is listed for their own source system; allowed: a nested mapping of ids for each source."""
    keep = F.lit(False)
    for name, ids in allowed.items():
        keep = keep | ((F.col(source) == name) & F.col(item).isin(sorted(flat_ids({"": ids} if isinstance(ids, list) else ids))))
    return events.where(keep)


def discovered(dictionary: DataFrame, label: str, terms: list[str]) -> DataFrame:
    """Rows of a dictionary whose label has any of the terms (regular expressions, case ignored)."""
    return dictionary.where(mentions(F.col(label), terms))


def by_alias(dictionary: DataFrame, label: str, item: str, aliases: dict[str, list[str]], prefer: tuple[str, str] | None = None) -> DataFrame:
    """feature, item: rows whose normalised label is an alias. prefer: (column, value); where a feature has such rows, only these."""
    low = normal(F.col(label))
    features = F.array_compact(F.array(*[F.when(low.isin([" ".join(a.lower().split()) for a in own]), F.lit(f)) for f, own in aliases.items()]))
    best = F.coalesce(F.lower(F.col(prefer[0])) == prefer[1].lower(), F.lit(False)) if prefer else F.lit(False)
    rows = dictionary.select(F.explode(features).alias("feature"), F.col(item).try_cast("long").alias(item), best.alias("_best")).where(F.col(item).isNotNull()).distinct()
    any_best = rows.groupBy("feature").agg(F.bool_or("_best").alias("_any"))
    return rows.join(any_best, "feature").where("_best or not _any").select("feature", item).distinct()


def by_exact_label(dictionary: DataFrame, label: str, link: str, item: str, curated: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """group, item: rows whose normalised label is in the group's list and whose link names the group's table."""
    own = [F.when((normal(F.col(link)) == table) & normal(F.col(label)).isin(labels), F.lit(g)) for g, (table, labels) in curated.items()]
    return dictionary.select(F.explode(F.array_compact(F.array(*own))).alias("group"), F.col(item)).distinct()


#: What a product's text must have, what it must not have, and the agents in the order they are looked for with the sizes (in ml) that make them infusions.
INFUSION, OTHER_FORMS = "IV SOLN", ["LIDOCAINE-EPINEPHRINE", "BUPIVACAINE-EPINEPHRINE", "RACEPINEPHRINE", "NASL", "RECT", "ORAL", "OPHT", "SYRG", "ATIN"]
AGENTS = [
    ("norepinephrine", ["NOREPINEPHRINE"], None),
    ("dopamine", ["DOPAMINE"], None),
    ("phenylephrine", ["PHENYLEPHRINE", "NEOSYNEPHRINE"], [100, 250, 500]),
    ("epinephrine", ["EPINEPHRINE"], [100, 250, 500]),
    ("vasopressin", ["VASOPRESSIN"], [50, 100, 250, 500]),
]


def product_agent(text: Column) -> Column:
    """The agent of an infusion product: the first one named, null where its size is none of an infusion's or the product has another form."""
    up = F.upper(text)
    other = up.rlike("|".join(OTHER_FORMS))
    agent = F.when(~up.contains(INFUSION) | other, F.lit(None).cast("string"))
    for name, words, sizes in AGENTS:
        large = F.lit(True) if sizes is None else up.rlike(rf"\b(?:{'|'.join(map(str, sizes))})\s*ML\b")
        agent = agent.when(up.rlike("|".join(words)), F.when(large, F.lit(name)))
    return agent


#: Fixed value: names of pressor agents; the look-behinds keep two longer names from being read as the shorter.
PRESSOR = r"(?i)norepinephrine|noradrenaline|levophed|phenylephrine|neosynephrine|\bdopamine\b|(?<!nor)(?<!deoxy)epinephrine|(?<!nor)adrenaline|vasopressin"


def aligned(order: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of values for every row of order, null where values lacks the key; a key that values has twice is an error."""
    return order.join(unique_on(values.select(key, *columns), [key], "values"), key, "left")


def bound(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both tables side by side, by key and never by place. Different keys, or one twice, are an error."""
    n_missing, n_extra = set_differences(left, right, key).first()
    if n_missing or n_extra:
        raise ValueError(f"{n_missing} keys missing, {n_extra} beyond")
    return unique_on(left, [key], "left").join(unique_on(right, [key], "right"), key)


def stored_by(events: DataFrame, store: str, anchor: str) -> DataFrame:
    """Events that were stored at their anchor; an unknown store time is not in time."""
    return events.where(F.coalesce(F.col(store) <= F.col(anchor), F.lit(False)))


def lagged_lookbacks(events: DataFrame, anchors: DataFrame, key: str, time: str, anchor: str, h: float, lags: list[int]) -> DataFrame:
    """lag_hours and the events of the h hours up to the anchor that are known when results come that many hours late: one join for all lags."""
    from clinflow.operators.joins import lookback

    near = lookback(events, anchors, key, time, anchor, h)
    return near.withColumn("lag_hours", F.explode(F.array(*[F.lit(x) for x in lags]))).where(F.timestamp_add("HOUR", F.col("lag_hours"), F.col(time)) <= F.col(anchor))

