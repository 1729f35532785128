"""Text flags, stripping, chunking, pooling and tolerant reading of JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinflow.functions.scalars import CJK
from clinflow.operators.ordering import uniform_sample


def union_pattern(patterns: list[str], flags: str = "iU") -> str:
    """One pattern that matches where any of the patterns does; case and Unicode aware by default."""
    return f"(?{flags})" + "|".join(f"(?:{p})" for p in patterns)


def mentions(text: Column, patterns: list[str], flags: str = "iU") -> Column:
    return F.coalesce(text.rlike(union_pattern(patterns, flags)), F.lit(False))


def stripped(text: Column, patterns: list[str], flags: str = "iU") -> tuple[Column, Column]:
    """The text with every match replaced by one space, and the number of matches."""
    p = union_pattern(patterns, flags)
    return F.regexp_replace(text, p, " "), F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))


def groups_hit(text: Column, groups: dict[str, list[str]], flags: str = "iU") -> Column:
    """Names of the groups of patterns that occur, in the order given."""
    return F.array_compact(F.array(*[F.when(mentions(text, p, flags), F.lit(n)) for n, p in groups.items()]))


def complete_sets(df: DataFrame, keys: list[str], member: str, members: list[str]) -> DataFrame:
    """Rows of keys for which every member is left."""
    whole = df.where(F.col(member).isin(members)).groupBy(*keys).agg(F.countDistinct(member).alias("_n")).where(F.col("_n") == len(members)).select(*keys)
    return df.join(whole, keys, "left_semi")


def normal(text: Column) -> Column:
    """Lower case, white space of any length as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


#: Texts that stand for no text.
NULL_TEXTS = ["", "nan", "none", "null"]


def cleaned(text: Column, leaks: list[str]) -> Column:
    """Null for texts that stand for none and for texts that mention a leak; else the text without white space at its ends."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.lower(t).isin(NULL_TEXTS) | mentions(t, leaks), None).otherwise(t)


def phrase_labels(text: Column, phrases: dict[str, list[str]]) -> Column:
    """Map of construct to 1 or 0: any of its phrases is contained, case ignored."""
    low = F.lower(F.coalesce(text, F.lit("")))
    entries = []
    for name, own in phrases.items():
        hit = F.lit(False)
        for p in own:
            hit = hit | low.contains(p)
        entries += [F.lit(name), hit.cast("int")]
    return F.create_map(*entries)


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def probability(answer: Column, paths: list[str]) -> Column:
    """The first of the JSON paths that gives a number in [0, 1]."""
    tried = []
    for p in paths:
        x = F.get_json_object(answer, p).try_cast("double")
        tried.append(F.when((x >= 0) & (x <= 1), x))
    return F.coalesce(*tried)


def last_scores(text: Column, keys: list[str]) -> Column:
    """The scores of the last {...} in the text that has all keys as numbers in [0, 1], as a map; null if none has."""
    found = F.reverse(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), 1))
    parsed = F.transform(found, lambda s: F.from_json(s, "map<string,double>"))

    def good(m: Column) -> Column:
        ok = m.isNotNull()
        for k in keys:
            v = F.try_element_at(m, F.lit(k))
            ok = ok & F.coalesce((v >= 0) & (v <= 1), F.lit(False))
        return ok

    return F.get(F.filter(parsed, good), 0)


def chunks(words: Column, size: int, overlap: int, most: int) -> Column:
    """Windows of `size` words, each `size - overlap` on, until the text is covered or there are `most`; one window for short texts."""
    step = size - overlap
    n = F.size(words)
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((n - overlap) / step).cast("int")))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(words, i * step + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def truncated(words: Column, size: int, overlap: int, most: int) -> Column:
    """True where the windows do not reach the text's end."""
    return F.size(words) > size + (most - 1) * (size - overlap)


def pooled(values: Column, how: str = "max") -> Column:
    """One value of a text's windows: max, min, mean, or top2 (mean of the two greatest)."""
    if how == "max":
        return F.array_max(values)
    if how == "min":
        return F.array_min(values)
    top = F.slice(F.sort_array(values, asc=False), 1, 2) if how == "top2" else values
    return F.try_divide(F.aggregate(top, F.lit(0.0), lambda a, x: a + x), F.size(top))


def packs(lengths: Column, base: int, most: int, size: int) -> Column:
    """Questions with these lengths in order as packs of at most `size` whose lengths and the base stay within `most`; arrays of indices. A question too long for any pack is one by itself."""
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("open"), F.lit(base).alias("used"), F.lit(0).alias("i"))

    def add(s: Column, n: Column) -> Column:
        fits = (F.size(s["open"]) < size) & (s["used"] + n <= most)
        full = ~fits & (F.size(s["open"]) > 0)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
            F.when(fits, F.concat(s["open"], F.array(s["i"]))).otherwise(F.array(s["i"])).alias("open"),
            F.when(fits, s["used"] + n).otherwise(F.lit(base) + n).cast("int").alias("used"),
            (s["i"] + 1).alias("i"),
        )

    return F.aggregate(lengths, start, add, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def distinct_texts(df: DataFrame, text: str, member: str, prefix: str = "note_") -> DataFrame:
    """note_id (hash of the text), n_rows, members (sorted set of what the text belongs to)."""
    key = F.concat(F.lit(prefix), F.substring(F.sha2(F.col(text), 256), 1, 24))
    return df.where(F.col(text).isNotNull()).groupBy(key.alias("note_id")).agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_set(F.col(member).cast("string"))).alias("members"))


def script_share(df: DataFrame, text: str, id_: str, letters: str = CJK, most: int = 5_000, seed: int = 20260920) -> DataFrame:
    """n_sampled, share of texts with a letter of a class, in a seeded sample of `most` texts that are not null; share is null without texts."""
    sample = uniform_sample(df.where(F.col(text).isNotNull()), id_, most, seed)
    return sample.agg(F.count("*").alias("n_sampled"), F.avg(F.col(text).rlike(letters).cast("double")).alias("share"))
