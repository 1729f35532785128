"""Quality rules: a threshold table compiled into one projection of DataFrame expressions.

Words are runs of characters other than space and \\t \\n \\v \\f \\r. A null text has no words. Every
measure of a text comes from the whole text, with work that grows as n log n in its words, so very
long texts are safe. A ratio of an empty text is 0. A rule with a null bound on one side has no bound
there. Repeated rows are judged each for itself; other columns are carried through `measures` and
`judge`, and the measures' names replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \\t\\n\\x0B\\f\\r"
#: Frequent function words of the four languages, lower case.
STOP_WORDS = [
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "aber", "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ich", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "ce", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "con", "de", "del", "el", "en", "es", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "una", "y",
]
#: (measure, least, most): a text fails when the measure is below least or above most.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_ratio", 0.04, None),
    ("dup_line_ratio", None, 0.5),
    ("shout_ratio", None, 0.5),
]


def _here(measure: Column) -> Column:
    """The measure, never moved into a filter: there the arrays below it would be built again for each of their elements."""
    return F.when(F.monotonically_increasing_id() >= 0, measure)


def _columns(text: Column) -> list[tuple[str, Column]]:
    """Names and expressions, in an order in which each may use those before it."""
    text = F.coalesce(text, F.lit(""))
    n = F.col("n_words")
    hashed = F.transform(
        F.when(F.size("__qr_w") >= 3, F.sequence(F.lit(0), F.size("__qr_w") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get("__qr_w", i), F.get("__qr_w", i + 1), F.get("__qr_w", i + 2)).alias("h"), i.alias("i")),
    )
    same = lambda x, k: F.coalesce(F.get("__qr_g", k)["h"] == x["h"], F.lit(False))
    twin = lambda x, k: same(x, k - 1) | same(x, k + 1)
    covered = F.array_distinct(F.flatten(F.transform(F.filter("__qr_g", twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{SPACE}]"))
    ratio = lambda a: F.when(n > 0, a / n).otherwise(F.lit(0.0))
    return [
        ("__qr_w", F.filter(F.split(text, f"[{SPACE}]+"), lambda s: s != "")),
        ("__qr_j", F.array_join("__qr_w", "")),
        ("__qr_g", F.sort_array(hashed)),
        ("__qr_l", lines),
        ("n_words", _here(F.size("__qr_w").cast("long"))),
        ("word_chars", F.length("__qr_j").cast("long")),
        ("n_symbols", (F.length("__qr_j") - F.length(F.regexp_replace("__qr_j", r"[#*$%&|<>]", ""))).cast("long")),
        ("n_dup_lines", _here((F.size("__qr_l") - F.size(F.array_distinct("__qr_l"))).cast("long"))),
        ("n_repeat_words", _here(F.size(covered).cast("long"))),
        ("n_stop_words", _here(F.size(F.filter("__qr_w", lambda s: F.lower(s).isin(STOP_WORDS))).cast("long"))),
        ("repeat_word_ratio", ratio(F.col("n_repeat_words"))),
        ("mean_word_chars", ratio(F.col("word_chars"))),
        ("symbols_per_word", ratio(F.col("n_symbols"))),
        ("stop_word_ratio", ratio(F.col("n_stop_words"))),
        ("dup_line_ratio", F.when(F.size("__qr_l") > 0, F.col("n_dup_lines") / F.size("__qr_l")).otherwise(F.lit(0.0))),
        ("shout_ratio", F.when(F.length("__qr_j") > 0, 1 - F.length(F.regexp_replace("__qr_j", r"\p{Lu}", "")) / F.length("__qr_j")).otherwise(F.lit(0.0))),
    ]


HELPERS = ["__qr_w", "__qr_j", "__qr_g", "__qr_l"]


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measures as columns."""
    clash = [c for c in docs.columns if c in {n for n, _ in _columns(F.lit(""))} and c != text_col]
    out = docs.drop(*clash)
    text = F.col(text_col)
    for layer in (("__qr_w", "__qr_l"), ("__qr_j", "__qr_g")):
        out = out.withColumns({n: e for n, e in _columns(text) if n in layer})
    rest = [(n, e) for n, e in _columns(text) if n not in HELPERS]
    counts = {n: e for n, e in rest if n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words")}
    out = out.withColumns(counts)
    out = out.withColumns({n: e for n, e in rest if n not in counts})
    return out.drop(*HELPERS)


def verdict(thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> Column:
    """True where no rule of the table fails."""
    good = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            good = good & (F.col(name) >= F.lit(least))
        if most is not None:
            good = good & (F.col(name) <= F.lit(most))
    return good


def judge(docs: DataFrame, text_col: str = "text", thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """docs with the measures, `kept` and `failed` (names of the rules that failed, in the table's order)."""
    out = measures(docs, text_col)
    failed = [F.when(~verdict([rule]), F.lit(rule[0])) for rule in thresholds]
    return out.withColumn("failed", F.array_compact(F.array(*failed))).withColumn("kept", verdict(thresholds))
