"""Column expressions: tolerant casts, masks, unit rules, bins, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Open or closed bounds of measurements, as (name, low, low is allowed, high, high is allowed).
RANGES = [
    ("hr", 0, False, 300, False), ("sbp", 0, False, 400, False), ("dbp", 0, False, 300, False), ("map", 0, False, 300, False),
    ("rr", 0, False, 70, False), ("spo2", 0, False, 100, True), ("temp_c", 10, False, 50, False), ("temp_f", 70, False, 120, False),
    ("gcs_eye", 1, True, 4, True), ("gcs_verbal", 1, True, 5, True), ("gcs_motor", 1, True, 6, True),
    ("lactate", 0, False, 50, False), ("creatinine", 0, False, 150, False), ("bun", 0, False, 300, False), ("wbc", 0, False, 1000, False),
    ("hemoglobin", 0, False, 50, False), ("platelets", 0, False, 10000, False), ("sodium", 0, False, 200, False), ("potassium", 0, False, 30, False),
    ("bicarbonate", 0, False, 10000, False), ("chloride", 0, False, 10000, False), ("glucose", 0, False, 10000, False),
    ("bilirubin", 0, False, 150, False), ("inr", 0, False, 50, False), ("ph", 6.0, False, 8.5, False),
]
#: Decision thresholds, coverage windows (hours), time bins as (low exclusive, high inclusive, name).
THRESHOLDS = [0.0025, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.05]
WINDOWS = [6, 12, 24, 48]
TIME_BINS = [(0, 6, "0-6"), (6, 12, "6-12"), (12, 24, "12-24")]


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr("0L") + F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), t)


def hours(later: Column, earlier: Column) -> Column:
    """Hours from earlier to later, with fractions."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3.6e9)


def after(t: Column, h: float) -> Column:
    """t and h hours."""
    return F.timestamp_add("MICROSECOND", F.lit(int(h * 3_600_000_000)), t)


def number(x: Column) -> Column:
    """Double, or null where the text is no number; NaN becomes null."""
    got = x.try_cast("double")
    return F.when(~F.isnan(got), got)


def whole_number(x: Column) -> Column:
    """Long by way of double, or null."""
    return number(x).cast("bigint")


def moment(x: Column) -> Column:
    """Timestamp without zone, or null where the text is none."""
    return x.try_cast("timestamp_ntz")


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def not_blank(x: Column) -> Column:
    return F.coalesce(strip(x) != "", F.lit(False))


def error_is_zero(e: Column) -> Column:
    """No error: the flag is a number equal to 0, or missing."""
    return F.coalesce(number(e), F.lit(0.0)) == 0


def error_not_one(e: Column) -> Column:
    """The older rule: any flag but the text 1."""
    return F.coalesce(e.cast("string"), F.lit("0")) != "1"


def not_cancelled(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit(""))).rlike("rewritten|cancelled")


def age_years(birth: Column, at: Column) -> Column:
    """Calendar days over the mean length of a year; no overflow for spans of centuries."""
    return F.datediff(at, birth) / F.lit(365.2425)


def capped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def eligible(age: Column, unit: Column) -> Column:
    """Adult and not in the neonatal unit; an unknown age is not eligible."""
    return F.coalesce((age >= 18) & (F.upper(F.trim(F.coalesce(unit, F.lit("")))) != "NICU"), F.lit(False))


def in_range(name: Column, value: Column) -> Column:
    """True where the value is within the bounds of its measurement; names without bounds are false."""
    out = F.lit(False)
    for n, low, low_in, high, high_in in RANGES:
        above = value >= low if low_in else value > low
        below = value <= high if high_in else value < high
        out = F.when(name == n, above & below).otherwise(out)
    return F.coalesce(out, F.lit(False))


def celsius(fahrenheit: Column) -> Column:
    """Converted where the Fahrenheit value itself is plausible."""
    return F.when((fahrenheit > 70) & (fahrenheit < 120), (fahrenheit - 32) / F.lit(1.8))


#: Texts that mark a verbal score as not assessable.
AIRWAY_VALUES = ["1.0 et/trach", "no response-ett"]


def airway_coded(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(AIRWAY_VALUES), F.lit(False))


def percent_of_fraction(x: Column) -> Column:
    """A fraction in (0, 1] as per cent, [20, 100] as it is, all else null."""
    return F.when((x > 0) & (x <= 1), x * 100).when((x >= 20) & (x <= 100), x)


def signed_volume(item: Column, value: Column, negative: list[int], most: float = 5000) -> Column:
    """Negated for irrigation items; values from `most` on are dropped."""
    got = F.when(item.isin(negative), -value).otherwise(value)
    return F.when(got < most, got)


def note_group(category: Column) -> Column:
    """Four groups; null stays null."""
    c = F.lower(F.trim(category))
    return F.when(c.isNull(), None).when(c.startswith("nursing"), "nursing").when(c.startswith("physician"), "physician").when(c.startswith("resp"), "respiratory").otherwise("other")


def sex_code(sex: Column) -> Column:
    """M 1, F 0; anything else is an error."""
    s = F.upper(F.trim(sex))
    return F.when(s == "M", 1.0).when(s == "F", 0.0).otherwise(F.raise_error(F.concat(F.lit("sex is neither M nor F: "), F.coalesce(sex, F.lit("null")))).cast("double"))


def one_hot(x: Column, levels: list[str], prefix: str) -> list[Column]:
    """A 0/1 column for each level; a value outside the list is an error."""
    checked = F.when(x.isin(levels), x).otherwise(F.raise_error(F.concat(F.lit("unexpected level: "), F.coalesce(x, F.lit("null")))).cast("string"))
    return [F.when(checked == v, 1.0).otherwise(0.0).alias(f"{prefix}{v}") for v in levels]


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first pattern, in the list's order, that occurs in the text; (name, pattern) pairs."""
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in rules], F.lit(None).cast("string"))


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "1.0", "yes", "y"), F.lit(False))


#: Fixed value: characters of the script looked for.
CJK = "[㐀-䶿一-鿿]"


def has_cjk(x: Column) -> Column:
    return F.coalesce(x.rlike(CJK), F.lit(False))


def time_bin(h: Column, bins: list[tuple[float, float, str]] | None = None) -> Column:
    """Name of the bin (low, high] that holds h, or null."""
    out = F.lit(None).cast("string")
    for low, high, name in bins or TIME_BINS:
        out = F.when((h > low) & (h <= high), F.lit(name)).otherwise(out)
    return out


def floor_bin(x: Column, width: float) -> Column:
    return F.floor(x / width)


def qualifies(depth: Column, volume_a: Column, volume_b: Column) -> Column:
    """Depth in [10, 40] and the first known volume in [100, 1000]."""
    return F.coalesce(depth.between(10, 40) & F.coalesce(volume_a, volume_b).between(100, 1000), F.lit(False))


def clipped(p: Column, e: float = 1e-8) -> Column:
    return F.least(F.greatest(p, F.lit(e)), F.lit(1 - e))


def logit(p: Column, e: float = 1e-8) -> Column:
    q = clipped(p, e)
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def later_of(*t: Column) -> Column:
    """The latest of the times that are known."""
    return F.greatest(*t)


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """prefix and the first hexadecimal digits of SHA-256 over the parts joined by pipes."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length))


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of SHA-256, exact in a double."""
    digits = F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def split_name(u: Column, shares: tuple[float, float] = (0.70, 0.85)) -> Column:
    return F.when(u < shares[0], "train").when(u < shares[1], "validation").otherwise("test")


def equal_width_bin(p: Column, n: int = 10) -> Column:
    """Bin 0 .. n - 1 on [0, 1], closed on the left, 1.0 in the last; edges are literals, so no product is rounded across one."""
    out = F.lit(n - 1)
    for i in range(n - 1, 0, -1):
        out = F.when(p < F.lit(i / n), i - 1).otherwise(out)
    return F.when(p.isNotNull(), out)


def auc_variance(auc: Column, cases: Column, controls: Column) -> Column:
    """Variance of an area from its value and the numbers of cases and controls."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return (auc * (1 - auc) + (cases - 1) * (q1 - auc * auc) + (controls - 1) * (q2 - auc * auc)) / (cases * controls)
