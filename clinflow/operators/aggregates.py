"""Summaries: counts, quantiles, first and last values, missingness, correlations, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinflow.operators.ordered import carried, sliced
from clinflow.shared import materialise


def histogram(df: DataFrame, columns: list[str], keep_null: bool = True) -> DataFrame:
    """Rows per value; without nulls unless they are kept."""
    if not keep_null:
        df = df.na.drop(subset=columns)
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def small_cells(counts: DataFrame, column: str, least: int = 5) -> DataFrame:
    """Cells below `least` folded into one row named (suppressed)."""
    name = F.when(F.col("n") < least, F.lit("(suppressed)")).otherwise(F.col(column).cast("string"))
    return counts.groupBy(name.alias(column)).agg(F.sum("n").alias("n"))


def collapse_times(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """One row for each key and time: the mean of what was measured then."""
    return df.groupBy(*keys, time).agg(F.avg(value).alias(value))


def first_last(df: DataFrame, keys: list[str], time: str, value: str, distinct_times: bool = True) -> DataFrame:
    """first_value, last_value, delta and n_times of the non-null values. delta needs two times (or, by the older rule, two rows)."""
    known = df.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    n = F.countDistinct(time) if distinct_times else F.count("*")
    out = known.groupBy(*keys).agg(F.min_by(value, time).alias("first_value"), F.max_by(value, time).alias("last_value"), n.alias("n_times"))
    return out.withColumn("delta", F.when(F.col("n_times") >= 2, F.col("last_value") - F.col("first_value")))


def quantile_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, p05, p25, median, p75, p95, max by exact linear interpolation."""
    q = F.percentile(F.col(value), F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return out.select(*keys, "n", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p25", "median", "p75", "p95"))], "max")


def percent_where(condition: Column) -> Column:
    return 100 * F.avg(F.when(condition, 1.0).otherwise(0.0))


def one_or_mixed(column: str, mixed: str = "mixed") -> Column:
    """The only value of a group, or `mixed`."""
    return F.when(F.countDistinct(column) == 1, F.min(column)).otherwise(F.lit(mixed))


def flags(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Per key and condition 1 where any row has it, else 0."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(c, 1)), F.lit(0)).alias(n) for n, c in conditions.items()])


def missingness(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """feature, missing_all, missing_cases, missing_controls as shares. One pass over df."""
    null = lambda c: F.col(c).isNull().cast("double")
    aggs = []
    for c in columns:
        aggs += [F.avg(null(c)).alias(f"{c}_a"), F.avg(F.when(F.col(label) == 1, null(c))).alias(f"{c}_1"), F.avg(F.when(F.col(label) == 0, null(c))).alias(f"{c}_0")]
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_a").alias("missing_all"), F.col(f"{c}_1").alias("missing_cases"), F.col(f"{c}_0").alias("missing_controls")) for c in columns]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def running_sums(df: DataFrame, value: str, sums: dict[str, str], keys: list[str] | None = None, parts: int | None = None, falling: bool = False) -> DataFrame:
    """df with the sum of each column of sums, under the name it is given there, over the rows of the key whose value is at most (falling: at least) the row's.

    Values must be known and, in a key, distinct. They are dealt by ranges of (key, value); sums inside a range and those of the key's ranges before it
    are added, so no task orders a whole table or key. NaN is the highest value.
    """
    keys = keys or []
    by = F.col(value).desc() if falling else F.col(value).asc()
    over = {f"_before_{c}": (F.sum(f"_sum_{c}"), False) for c in sums}
    rows = carried(sliced(df, keys, [by], parts), keys, {f"_sum_{c}": F.sum(c) for c in sums}, over)
    inside = Window.partitionBy("_part", *keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*df.columns, *[(F.sum(c).over(inside) + F.coalesce(f"_before_{c}", F.lit(0))).alias(name) for c, name in sums.items()])


def average_rank(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "avg_rank") -> DataFrame:
    """Rank from 1 of non-null values, ties sharing the mean rank.

    Ranks come from counts by value: rows below plus half of the ties, so only distinct values are ordered, not rows, and these range by range.
    """
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranks = running_sums(counts, value, {"_n": "_upto"}, keys).select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, [*keys, value], "left")


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, rho: rank correlation over rows where both are known."""
    keys = keys or []
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_rank(average_rank(both, x, keys, "_rx"), y, keys, "_ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, rho for every pair of columns, in their order: rank correlation over the rows where both are known, ranked among these rows.

    rho is null with fewer than three such rows or one value. All pairs go together through the same few shuffles, whatever their number: rows become counts by
    (pair, value, value), the counts' sides are ranked in one order by ranges, and one aggregation adds up products of ranks.
    """
    pairs = [F.struct(F.lit(i * len(columns) + j).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    rows = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    joint = materialise(rows.groupBy("pair", "x", "y").agg(F.count("*").alias("n")))
    sides = joint.select("pair", "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("v")), F.struct(F.lit(1).alias("side"), F.col("y").alias("v")))).alias("s")).select("pair", "n", "s.*")
    counts = sides.groupBy("pair", "side", "v").agg(F.sum("n").alias("n"))
    ranks = materialise(running_sums(counts, "v", {"n": "upto"}, ["pair", "side"]).select("pair", "side", "v", (F.col("upto") - (F.col("n") - 1) / 2).alias("r")))
    side = lambda k, v, r: ranks.where(F.col("side") == k).select("pair", F.col("v").alias(v), F.col("r").alias(r))
    both = joint.join(side(0, "x", "rx"), ["pair", "x"]).join(side(1, "y", "ry"), ["pair", "y"])
    # ranks less half of the rows, so that sums of squares keep their digits
    whole = joint.groupBy("pair").agg(F.sum("n").alias("rows"))
    both = both.join(F.broadcast(whole), "pair").withColumns({c: F.col(c) - (F.col("rows") + 1) / 2 for c in ("rx", "ry")})
    add = lambda c: F.sum(F.col("n") * c)
    got = both.groupBy("pair").agg(F.sum("n").alias("n"), add(F.col("rx") * F.col("ry")).alias("xy"), add(F.col("rx") * F.col("rx")).alias("xx"), add(F.col("ry") * F.col("ry")).alias("yy"))
    names = F.array(*[F.lit(c) for c in columns])
    k = len(columns)
    rho = F.when(F.col("n") >= 3, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))))
    every = df.sparkSession.createDataFrame([(i * k + j,) for i in range(k) for j in range(i + 1, k)], "pair int")
    out = every.join(got, "pair", "left")
    return out.select(F.get(names, F.floor(F.col("pair") / k).cast("int")).alias("a"), F.get(names, F.col("pair") % k).alias("b"), F.coalesce("n", F.lit(0)).alias("n"), rho.alias("rho"))


def contrast(df: DataFrame, flag: str, values: list[str]) -> DataFrame:
    """value_name, mean where the flag is 1, mean where it is 0, difference."""
    aggs = [F.avg(F.when(F.col(flag) == k, F.col(v))).alias(f"{v}_{k}") for v in values for k in (0, 1)]
    rows = [F.struct(F.lit(v).alias("value_name"), F.col(f"{v}_1").alias("mean_1"), F.col(f"{v}_0").alias("mean_0"), (F.col(f"{v}_1") - F.col(f"{v}_0")).alias("difference")) for v in values]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def repeat_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, sd (n - 1; 0 for one repeat), min, max over repeats."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def _fields(df: DataFrame, keep: dict[str, Column], fields: list[str]) -> DataFrame:
    """A row for each row and field that is not blank: the columns to keep, field, value (trimmed)."""
    long = df.select(*[c.alias(n) for n, c in keep.items()], F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields])).alias("x"))
    return long.select(*keep, "x.*").where("value <> ''")


def field_profile(df: DataFrame, entity: str, fields: list[str], least: int = 5) -> DataFrame:
    """field, n_rows (not blank), n_entities, numeric_share, n_values, n_common_values (seen `least` times or more)."""
    long = _fields(df, {"_e": F.col(entity)}, fields)
    by_field = long.groupBy("field").agg(F.count("*").alias("n_rows"), F.countDistinct("_e").alias("n_entities"), F.avg(F.col("value").try_cast("double").isNotNull().cast("double")).alias("numeric_share"))
    by_value = long.groupBy("field", "value").agg(F.count("*").alias("n")).groupBy("field").agg(F.count("*").alias("n_values"), F.count_if(F.col("n") >= least).alias("n_common_values"))
    return by_field.join(by_value, "field")


def top_values(df: DataFrame, fields: list[str], support: list[str], least: int = 5, most: int = 30) -> DataFrame:
    """field, rank, value, n, n_support of the `most` most frequent values of each field with `least` rows or more; ties by value.

    n_support: rows of the value in which any support field is filled; null for support fields themselves. Values are counted exactly: a task passes on one row for each
    value it met, and only the highest of each task and field are ranked.
    """
    filled = F.lit(False)
    for f in support:
        filled = filled | (F.trim(F.col(f).cast("string")) != "")
    long = _fields(df, {"_s": F.coalesce(filled, F.lit(False))}, fields)
    counts = long.groupBy("field", "value").agg(F.count("*").alias("n"), F.count_if(F.col("_s")).alias("n_support")).where(F.col("n") >= least)
    order = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.select("field", "rank", "value", "n", F.when(~F.col("field").isin(support), F.col("n_support")).alias("n_support"))


def dictionary_usage(events: DataFrame, dictionary: DataFrame, item: str, value: str, entity: str) -> DataFrame:
    """dictionary with n_rows, n_numeric, n_entities of each item; items without rows have 0."""
    used = events.groupBy(item).agg(F.count("*").alias("n_rows"), F.count(F.col(value).try_cast("double")).alias("n_numeric"), F.countDistinct(entity).alias("n_entities"))
    return dictionary.join(used, item, "left").na.fill(0, ["n_rows", "n_numeric", "n_entities"])


def trajectory(df: DataFrame, key: str, bin_: str, value: str, bins: list[str]) -> DataFrame:
    """One row over keys that have all bins: n, a mean for each bin, percent_increased (last over first), percent_monotone."""
    wide = df.groupBy(key).pivot(bin_, bins).agg(F.avg(value)).na.drop(subset=bins)
    rising = F.lit(True)
    for a, b in zip(bins, bins[1:], strict=False):
        rising = rising & (F.col(f"`{b}`") >= F.col(f"`{a}`"))
    return wide.agg(
        F.count("*").alias("n"), *[F.avg(F.col(f"`{b}`")).alias(f"mean_{i}") for i, b in enumerate(bins)],
        percent_where(F.col(f"`{bins[-1]}`") > F.col(f"`{bins[0]}`")).alias("percent_increased"), percent_where(rising).alias("percent_monotone"),
    )


def coverage(events: DataFrame, notes: DataFrame, key: str, event_time: str, note_time: str, windows: list[int]) -> DataFrame:
    """window_hours, n_events, n_covered, percent_covered, n_two, median_closest_hours over events and the notes before them.

    Notes join once, within the longest window; each event's notes are counted for all windows in one pass.
    """
    from clinflow.functions.scalars import hours
    from clinflow.operators.joins import strictly_before

    ids = events.select(key, event_time).distinct()
    near = strictly_before(notes.select(key, note_time), ids, key, note_time, event_time, max(windows)).withColumn("h", hours(F.col(event_time), F.col(note_time)))
    per = near.groupBy(key, event_time).agg(*[F.count_if(F.col("h") <= w).alias(f"n{w}") for w in windows], F.min("h").alias("closest"))
    all_ = ids.join(per, [key, event_time], "left")
    rows = [F.struct(F.lit(w).alias("window_hours"), F.coalesce(f"n{w}", F.lit(0)).alias("k"), F.when(F.col("closest") <= w, F.col("closest")).alias("c")) for w in windows]
    long = all_.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return long.groupBy("window_hours").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("k") >= 1).alias("n_covered"), percent_where(F.col("k") >= 1).alias("percent_covered"),
        F.count_if(F.col("k") >= 2).alias("n_two"), F.percentile("c", 0.5).alias("median_closest_hours"),
    )


def contract(observed: DataFrame, expected: dict[str, int]) -> DataFrame:
    """name, expected, observed of the counts that differ. observed: one row with a column for each name."""
    rows = [F.struct(F.lit(n).alias("name"), F.lit(v).cast("long").alias("expected"), F.col(n).cast("long").alias("observed")) for n, v in expected.items()]
    return observed.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("not (expected <=> observed)")


def require_contract(observed: DataFrame, expected: dict[str, int]) -> None:
    bad = contract(observed, expected).collect()  # a row for each expected count at most
    if bad:
        raise ValueError("; ".join(f"{r['name']}: expected {r['expected']}, found {r['observed']}" for r in bad))


def inconsistent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys with more than one value in a column."""
    counts = df.groupBy(key).agg(*[F.countDistinct(c).alias(c) for c in columns])
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c) > 1)
    return counts.where(bad)


def population(df: DataFrame, keys: list[str], label: str, subject: str, covered: str) -> DataFrame:
    """n_rows, n_subjects, n_cases, n_controls, prevalence, coverage of cases and of controls."""
    share = lambda k: F.avg(F.when(F.col(label) == k, F.col(covered).cast("double")))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.countDistinct(subject).alias("n_subjects"), F.count_if(F.col(label) == 1).alias("n_cases"), F.count_if(F.col(label) == 0).alias("n_controls"),
        F.avg(F.col(label).cast("double")).alias("prevalence"), share(1).alias("covered_cases"), share(0).alias("covered_controls"),
    )


def repeat_difference(df: DataFrame, repeat: str, model: str, value: str, base: str, other: str) -> DataFrame:
    """mean, sd, p2.5, p97.5 of other minus base over repeats, and the per cent above 0."""
    wide = df.groupBy(repeat).pivot(model, [base, other]).agg(F.first(value)).withColumn("d", F.col(f"`{other}`") - F.col(f"`{base}`"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return wide.agg(F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"), q[0].alias("low"), q[1].alias("high"), percent_where(F.col("d") > 0).alias("percent_positive"))


def sensitivity(main: DataFrame, other: DataFrame, key: str, effect: str, n: str, low: str, high: str) -> DataFrame:
    """key, retained_percent, same_direction, excludes_zero of a second summary against the first."""
    j = main.alias("m").join(other.alias("o"), key)
    return j.select(
        key, (100 * F.try_divide(F.col(f"o.{n}"), F.col(f"m.{n}"))).alias("retained_percent"),
        (F.signum(f"m.{effect}") == F.signum(f"o.{effect}")).alias("same_direction"), ((F.col(f"o.{low}") > 0) | (F.col(f"o.{high}") < 0)).alias("excludes_zero"),
    )
