"""Evaluation of scores: rank metrics with ties, calibration, decision curves, cluster resampling.

Rank metrics are computed from counts by distinct score, which are summed range by range of the scores.
"""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinflow.functions.scalars import clipped, equal_width_bin, logit, unit_interval
from clinflow.operators.aggregates import percent_where, running_sums


def auroc(df: DataFrame, label: str, score: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """keys, n_cases, n_controls (weights where given), auroc, average_precision. Equal scores are one group; with one class both are null."""
    keys = keys or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    groups = rows.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("_n"))
    groups = running_sums(groups, score, {"_p": "_cp", "_n": "_cn"}, keys, falling=True)
    # a control at a score is beaten by the cases above it and half of those beside it
    wins = F.col("_n") * (F.col("_cp") - F.col("_p") / 2)
    precision = F.try_divide(F.col("_cp"), F.col("_cp") + F.col("_cn")) * F.col("_p")
    out = groups.groupBy(*keys).agg(F.sum("_p").alias("n_cases"), F.sum("_n").alias("n_controls"), F.sum(wins).alias("_w"), F.sum(precision).alias("_a"))
    both = (F.col("n_cases") > 0) & (F.col("n_controls") > 0)
    return out.select(*keys, "n_cases", "n_controls", F.when(both, F.col("_w") / (F.col("n_cases") * F.col("n_controls"))).alias("auroc"), F.when(both, F.col("_a") / F.col("n_cases")).alias("average_precision"))


def oriented(name: Column, score: Column, reversed_: list[str]) -> Column:
    """1 - score for the constructs that speak for the other side."""
    return F.when(name.isin(reversed_), 1 - score).otherwise(score)


def brier_logloss(df: DataFrame, label: str, p: str, keys: list[str] | None = None) -> DataFrame:
    y, q = F.col(label).cast("double"), clipped(F.col(p))
    return df.groupBy(*(keys or [])).agg(F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"), (-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))


def calibration_bins(df: DataFrame, label: str, p: str, bin_: Column) -> DataFrame:
    """bin, n, mean_predicted, observed."""
    return df.withColumn("bin", bin_).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed"))


def expected_error(bins: DataFrame) -> DataFrame:
    """ece: mean gap between observed and predicted, weighted by rows."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("observed") - F.col("mean_predicted"))) / F.sum("n")).alias("ece"))


def ece_equal_width(df: DataFrame, label: str, p: str, n: int = 10) -> DataFrame:
    return expected_error(calibration_bins(df, label, p, equal_width_bin(F.col(p), n)))


def calibration_in_the_large(df: DataFrame, label: str, p: str, weight: str | None = None, most: int = 100, tolerance: float = 1e-10) -> float:
    """Intercept with slope 1 by Newton steps, each one aggregation over df."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(F.col(label).cast("double").alias("y"), logit(F.col(p)).alias("z"), w.cast("double").alias("w"))
    a = 0.0
    for _ in range(most):
        q = 1 / (1 + F.exp(-(F.col("z") + F.lit(a))))
        g, h = rows.agg(F.sum(F.col("w") * (F.col("y") - q)), F.sum(F.col("w") * q * (1 - q))).first()
        if not h:
            return float("nan")
        a += g / h
        if abs(g / h) < tolerance:
            break
    return a


def recalibration(df: DataFrame, label: str, p: str, weight: str | None = None, most: int = 50, tolerance: float = 1e-10) -> tuple[float, float]:
    """Intercept and slope together."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(F.col(label).cast("double").alias("y"), logit(F.col(p)).alias("z"), w.cast("double").alias("w"))
    a, b = 0.0, 1.0
    for _ in range(most):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("z"))))
        r, v = F.col("w") * (F.col("y") - q), F.col("w") * q * (1 - q)
        g0, g1, h00, h01, h11 = rows.agg(F.sum(r), F.sum(r * F.col("z")), F.sum(v), F.sum(v * F.col("z")), F.sum(v * F.col("z") * F.col("z"))).first()
        det = (h00 or 0) * (h11 or 0) - (h01 or 0) ** 2
        if det <= 0:
            return float("nan"), float("nan")
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < tolerance:
            break
    return a, b


def decision_curve(df: DataFrame, label: str, p: str, thresholds: list[float], weight: str | None = None) -> DataFrame:
    """threshold, net_benefit, treat_all. One pass over df for all thresholds."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    case, sums = F.when(F.col(label) == 1, w).otherwise(0.0), [F.sum(w).alias("n"), F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("c")]
    for i, t in enumerate(thresholds):
        hit = F.col(p) >= F.lit(t)
        sums += [F.sum(F.when(hit, case).otherwise(0.0)).alias(f"tp{i}"), F.sum(F.when(hit & (F.col(label) == 0), w).otherwise(0.0)).alias(f"fp{i}")]
    rows = []
    for i, t in enumerate(thresholds):
        odds = t / (1 - t)
        benefit = F.col(f"tp{i}") / F.col("n") - F.col(f"fp{i}") / F.col("n") * odds
        rows.append(F.struct(F.lit(t).alias("threshold"), benefit.alias("net_benefit"), (F.col("c") / F.col("n") - (1 - F.col("c") / F.col("n")) * odds).alias("treat_all")))
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def multiplicity(cluster: Column, replicate: Column, seed: int = 1) -> Column:
    """How often a cluster is drawn in a replicate: Poisson(1) by hash, the limit of drawing with replacement, with nothing to collect."""
    u = unit_interval(F.lit(seed), replicate, cluster)
    out, tail, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 12):
        tail += term
        out = F.when(u >= F.lit(tail), k).otherwise(out)
        term /= k
    return out


def percentile_interval(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, low, high: 2.5 and 97.5 per cent, linear."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return df.groupBy(*(keys or [])).agg(F.count(value).alias("n"), q[0].alias("low"), q[1].alias("high"))


def centred_p(df: DataFrame, value: str, observed: float) -> DataFrame:
    """p: share of draws whose distance above the observed value reaches it, one added to both counts."""
    return df.agg(((1 + F.count_if(F.col(value) - F.lit(observed) >= F.lit(observed))) / (F.count(value) + 1)).alias("p"))


#: Bounds of an area in its variance, of an area plus a difference, the least variance of a difference, and the range of a detectable difference.
LEAST_AREA, LEAST_SUM, LEAST_VARIANCE, DIFFERENCES, HIGHEST = 1e-6, 1e-5, 1e-16, (0.0001, 0.20), 0.999


def hanley_mcneil(auc: float, cases: int, controls: int) -> float:
    """Variance of an area; NaN where there is no more than one case or one control."""
    if min(cases, controls) <= 1:
        return math.nan
    a = max(LEAST_AREA, min(float(auc), 1 - LEAST_AREA))
    more_cases = (cases - 1) * (a / (2 - a) - a * a)
    more_controls = (controls - 1) * (2 * a * a / (1 + a) - a * a)
    return (a - a * a + more_cases + more_controls) / (cases * controls)


def difference_se(base: float, delta: float, cases: int, controls: int, correlation: float) -> float:
    """Standard error of the difference of two correlated areas, base and base + delta."""
    other = max(LEAST_SUM, min(base + delta, 1 - LEAST_SUM))
    v, w = hanley_mcneil(base, cases, controls), hanley_mcneil(other, cases, controls)
    return math.sqrt(max(LEAST_VARIANCE, v + w - 2 * correlation * math.sqrt(v * w)))


def power(base: float, delta: float, cases: int, controls: int, correlation: float, alpha: float = 0.05) -> float:
    """Power of a one-sided test at level alpha of the difference."""
    normal = statistics.NormalDist()
    return normal.cdf(delta / difference_se(base, delta, cases, controls, correlation) - normal.inv_cdf(1 - alpha))


def detectable(base: float, cases: int, controls: int, correlation: float, alpha: float = 0.05, wanted: float = 0.8) -> float | None:
    """Smallest difference with that power, by bisection; None if the largest one looked at has less."""
    low, high = DIFFERENCES[0], min(DIFFERENCES[1], HIGHEST - base)
    enough = lambda d: power(base, d, cases, controls, correlation, alpha) >= wanted
    if not enough(high):
        return None
    while high - low > 1e-15:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def icc(df: DataFrame, subject: str, rater: str, value: str) -> DataFrame:
    """n_subjects, n_raters, icc_single, icc_average: two-way, absolute agreement, over subjects that every rater rated."""
    full = df.groupBy(subject).agg(F.countDistinct(rater).alias("_k")).join(df.agg(F.countDistinct(rater).alias("_all")), F.col("_k") == F.col("_all")).select(subject)
    rows = df.join(full, subject, "left_semi")
    by_subject = rows.groupBy(subject).agg(F.avg(value).alias("m")).agg(F.count("*").alias("n"), F.var_pop("m").alias("vs"))
    by_rater = rows.groupBy(rater).agg(F.avg(value).alias("m")).agg(F.count("*").alias("k"), F.var_pop("m").alias("vr"))
    total = rows.agg(F.var_pop(value).alias("vt"))
    j = by_subject.join(by_rater, how="cross").join(total, how="cross")
    n, k = F.col("n"), F.col("k")
    msr, msc = n * k * F.col("vs") / (n - 1), n * k * F.col("vr") / (k - 1)
    mse = n * k * (F.col("vt") - F.col("vs") - F.col("vr")) / ((n - 1) * (k - 1))
    return j.select(n.alias("n_subjects"), k.alias("n_raters"), F.try_divide(msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n).alias("icc_single"), F.try_divide(msr - mse, msr + (msc - mse) / n).alias("icc_average"))


def rater_mean(df: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """Mean rating, null with fewer than `least` ratings."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.when(F.count(value) >= least, F.avg(value)).alias("mean_rating"))


def group_weights(df: DataFrame, group: str, name: str = "weight") -> DataFrame:
    """df with total / (groups * rows of the group)."""
    counts = df.groupBy(group).agg(F.count("*").alias("_c"))
    whole = counts.agg(F.sum("_c").alias("_t"), F.count("*").alias("_g"))
    return df.join(counts.join(whole, how="cross").select(group, (F.col("_t") / (F.col("_g") * F.col("_c"))).alias(name)), group)


def prevalence(df: DataFrame, flags: list[str], label: str) -> DataFrame:
    """flag, n_flagged, percent_all, percent_cases, percent_controls."""
    aggs = []
    for f in flags:
        hit = F.coalesce(F.col(f).cast("boolean"), F.lit(False))
        aggs += [F.count_if(hit).alias(f"{f}_n"), percent_where(hit).alias(f"{f}_a"), (100 * F.avg(F.when(F.col(label) == 1, hit.cast("double")))).alias(f"{f}_1"), (100 * F.avg(F.when(F.col(label) == 0, hit.cast("double")))).alias(f"{f}_0")]
    rows = [F.struct(F.lit(f).alias("flag"), F.col(f"{f}_n").alias("n_flagged"), F.col(f"{f}_a").alias("percent_all"), F.col(f"{f}_1").alias("percent_cases"), F.col(f"{f}_0").alias("percent_controls")) for f in flags]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def increments(metrics: DataFrame, key: str, model: str, value: str, contrasts: list[tuple[str, str]]) -> DataFrame:
    """key, contrast, difference of models (other, base)."""
    names = sorted({m for c in contrasts for m in c})
    wide = metrics.groupBy(key).pivot(model, names).agg(F.first(value))
    rows = [F.struct(F.lit(f"{a} - {b}").alias("contrast"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("difference")) for a, b in contrasts]
    return wide.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")


def cross_construct(df: DataFrame, rows: list[str], columns: list[str]) -> DataFrame:
    """row, matched_rho, mean_other_rho, matched_rank: each row construct's rank correlation with its own column beside those with the others. rows[i] belongs to columns[i]."""
    from clinflow.operators.aggregates import correlation_matrix

    own = F.create_map(*[F.lit(x) for pair in zip(rows, columns, strict=True) for x in pair])
    got = correlation_matrix(df, [*rows, *columns]).where(F.col("a").isin(rows) & F.col("b").isin(columns)).select(F.col("a").alias("row"), (own[F.col("a")] == F.col("b")).alias("own"), "rho")
    ranked = got.withColumn("k", F.rank().over(Window.partitionBy("row").orderBy(F.desc_nulls_last("rho"))))
    return ranked.groupBy("row").agg(F.max(F.when(F.col("own"), F.col("rho"))).alias("matched_rho"), F.avg(F.when(~F.col("own"), F.col("rho"))).alias("mean_other_rho"), F.max(F.when(F.col("own"), F.col("k"))).alias("matched_rank"))


def variances(df: DataFrame, keys: list[str], label: str, base: str, other: str, correlation: float) -> DataFrame:
    """keys, n_cases, n_controls, auc_base, auc_other, variance_base, variance_other, difference, difference_se of two scores of the same rows."""
    from clinflow.functions.scalars import auc_variance

    one = lambda score, name: auroc(df, label, score, keys).select(*keys, "n_cases", "n_controls", F.col("auroc").alias(f"auc_{name}"))
    got = one(base, "base").join(one(other, "other").drop("n_cases", "n_controls"), keys)
    bounded = lambda c, least: F.least(F.greatest(F.col(c), F.lit(least)), F.lit(1 - least))
    got = got.withColumns({f"variance_{n}": F.when((F.col("n_cases") > 1) & (F.col("n_controls") > 1), auc_variance(bounded(f"auc_{n}", LEAST_AREA if n == "base" else LEAST_SUM), F.col("n_cases"), F.col("n_controls"))) for n in ("base", "other")})
    both = F.col("variance_base") + F.col("variance_other") - 2 * F.lit(correlation) * F.sqrt(F.col("variance_base") * F.col("variance_other"))
    return got.withColumn("difference", F.col("auc_other") - F.col("auc_base")).withColumn("difference_se", F.sqrt(F.greatest(both, F.lit(LEAST_VARIANCE))))


def power_table(df: DataFrame, keys: list[str], label: str, score: str, delta: float, correlations: list[float], alpha: float = 0.05, wanted: float = 0.8) -> DataFrame:
    """keys, n_cases, n_controls, auroc, correlation, power to see `delta`, detectable (the least difference seen with power `wanted`; null beyond those looked at) with the key's own area and numbers."""
    import pandas as pd

    areas = auroc(df, label, score, keys).where("auroc is not null").select(*keys, "n_cases", "n_controls", "auroc")
    rows = areas.withColumn("correlation", F.explode(F.array(*[F.lit(float(c)) for c in correlations])))

    def work(batches):
        for b in batches:
            args = list(zip(b["auroc"], b["n_cases"].astype(int), b["n_controls"].astype(int), b["correlation"], strict=True))
            several = [min(n, m) > 1 for _, n, m, _ in args]
            b["power"] = pd.Series([power(a, delta, n, m, c, alpha) if ok else None for (a, n, m, c), ok in zip(args, several, strict=True)], b.index, "float64")
            b["detectable"] = pd.Series([detectable(a, n, m, c, alpha, wanted) if ok else None for (a, n, m, c), ok in zip(args, several, strict=True)], b.index, "float64")
            yield b

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(work, f"{kind}, power double, detectable double")
