"""Queries over scores, folds and matched sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.functions import scalars as S
from clinflow.operators import aggregates as A
from clinflow.operators import models as M
from clinflow.operators import ordering as E
from clinflow.operators import resampling as Z
from clinflow.operators import stats as I
from clinflow.plans import fixtures as X
from clinflow.plans.register import Register

R = Register()


def r6(c, name):
    return F.round(c, 6).alias(name)


def _six(x: float | None) -> float | None:
    return None if x is None else round(x, 6)


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[r6(F.col(c), c) if c in columns else F.col(c) for c in df.columns])


def _auc(group: str, weight: str = "1.0") -> str:
    by = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    keys = f"GROUP BY {group}" if group else ""
    return f"""
g AS (SELECT {by}p_base, sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN {weight} ELSE 0 END) AS n FROM sc GROUP BY {by}p_base),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS ({part} ORDER BY p_base DESC))
SELECT {by}sum(p)::DOUBLE AS n_cases, sum(n)::DOUBLE AS n_controls, round((sum(n * (cp - p / 2.0)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auroc, round((sum(CASE WHEN cp + cn > 0 THEN cp / (cp + cn) * p ELSE 0 END) / sum(p))::DOUBLE, 6) AS average_precision FROM c {keys}"""


@R.add(_auc("source"))
def auroc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties are one group."""
    return rounded(I.auroc(X.scores(spark, sf_dir), "y", "p_base", ["source"]), ["auroc", "average_precision"])


@R.add(_auc("", "(1.0 + subject_id % 3)"))
def weighted_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2 with weights."""
    s = X.scores(spark, sf_dir).withColumn("w", 1.0 + F.col("subject_id") % 3)
    return rounded(I.auroc(s, "y", "p_base", weight="w"), ["auroc", "average_precision"])


@R.add("""
r AS (SELECT y, rank() OVER (ORDER BY p_aug) + (count(*) OVER (PARTITION BY p_aug) - 1) / 2.0 AS rk FROM sc)
SELECT round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auroc FROM r
""")
def auroc_by_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same area by average ranks."""
    r = A.average_rank(X.scores(spark, sf_dir).select("y", "p_aug"), "p_aug")
    n1, n0 = F.sum("y"), F.sum(1 - F.col("y"))
    return r.agg(r6((F.sum(F.when(F.col("y") == 1, F.col("avg_rank"))) - n1 * (n1 + 1) / 2) / (n1 * n0), "auroc"))


@R.add("SELECT source, round(avg((p_base - y) * (p_base - y)), 6) AS brier, round(-avg(y * ln(least(greatest(p_base, 1e-8), 1 - 1e-8)) + (1 - y) * ln(1 - least(greatest(p_base, 1e-8), 1 - 1e-8))), 6) AS log_loss FROM sc GROUP BY 1")
def brier_and_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3."""
    return rounded(I.brier_logloss(X.scores(spark, sf_dir), "y", "p_base", ["source"]), ["brier", "log_loss"])


_BIN = "CASE WHEN p_base < 0.1 THEN 0 WHEN p_base < 0.2 THEN 1 WHEN p_base < 0.3 THEN 2 WHEN p_base < 0.4 THEN 3 WHEN p_base < 0.5 THEN 4 WHEN p_base < 0.6 THEN 5 WHEN p_base < 0.7 THEN 6 WHEN p_base < 0.8 THEN 7 WHEN p_base < 0.9 THEN 8 ELSE 9 END"


@R.add(f"SELECT {_BIN} AS bin, count(*) AS n, round(avg(p_base), 6) AS mean_predicted, round(avg(y), 6) AS observed FROM sc GROUP BY 1")
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10, D10."""
    return rounded(I.calibration_bins(X.scores(spark, sf_dir), "y", "p_base", S.equal_width_bin(F.col("p_base"))), ["mean_predicted", "observed"])


@R.add(f"b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p_base) AS m, avg(y) AS o FROM sc GROUP BY 1) SELECT round(sum(n * abs(o - m)) / sum(n), 6) AS ece FROM b")
def ece_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4."""
    return rounded(I.ece_equal_width(X.scores(spark, sf_dir), "y", "p_base"), ["ece"])


@R.add("""
e AS (SELECT list_sort(list_distinct(quantile_cont(p_base::DOUBLE, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM sc),
b AS (SELECT greatest(len(list_filter(e[:-2], lambda x: x < p_base)) - 1, 0) AS bin, p_base AS p, y FROM sc, e),
c AS (SELECT bin, count(*) AS n, avg(p) AS m, avg(y) AS o FROM b GROUP BY 1)
SELECT round(sum(n * abs(o - m)) / sum(n), 6) AS ece, count(*) AS n_bins FROM c
""")
def ece_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11, I4."""
    rows = E.quantile_bins(X.scores(spark, sf_dir).select("y", "p_base"), "p_base", 10, "qb")
    bins = I.calibration_bins(rows, "y", "p_base", F.col("qb"))
    return I.expected_error(bins).crossJoin(bins.agg(F.count("*").alias("n_bins"))).select(r6(F.col("ece"), "ece"), "n_bins")


@R.add("""
t AS (SELECT unnest([0.0025, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.05]) AS threshold)
SELECT threshold::DOUBLE AS threshold, round(avg(CASE WHEN p_base >= threshold AND y = 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN p_base >= threshold AND y = 0 THEN 1.0 ELSE 0.0 END) * threshold / (1 - threshold), 6)::DOUBLE AS net_benefit,
  round(avg(y) - (1 - avg(y)) * threshold / (1 - threshold), 6)::DOUBLE AS treat_all FROM sc, t GROUP BY threshold
""")
def decision_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I7."""
    return rounded(I.decision_curve(X.scores(spark, sf_dir), "y", "p_base", S.THRESHOLDS), ["net_benefit", "treat_all"])


@R.add("""
t AS (SELECT unnest([0.1, 0.3, 0.5]) AS threshold), w AS (SELECT *, 1.0 + subject_id % 4 AS w FROM sc)
SELECT threshold::DOUBLE AS threshold, round((sum(CASE WHEN p_base >= threshold AND y = 1 THEN w ELSE 0 END) / sum(w) - sum(CASE WHEN p_base >= threshold AND y = 0 THEN w ELSE 0 END) / sum(w) * threshold / (1 - threshold))::DOUBLE, 6) AS net_benefit,
  round((sum(CASE WHEN y = 1 THEN w ELSE 0 END) / sum(w) - (1 - sum(CASE WHEN y = 1 THEN w ELSE 0 END) / sum(w)) * threshold / (1 - threshold))::DOUBLE, 6) AS treat_all FROM w, t GROUP BY threshold
""")
def weighted_decision_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8."""
    s = X.scores(spark, sf_dir).withColumn("w", 1.0 + F.col("subject_id") % 4)
    return rounded(I.decision_curve(s, "y", "p_base", [0.1, 0.3, 0.5], "w"), ["net_benefit", "treat_all"])


@R.add()
def calibration_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against score equations that must vanish."""
    s = X.scores(spark, sf_dir)
    a, (b, c) = I.calibration_in_the_large(s, "y", "p_base"), I.recalibration(s, "y", "p_base")
    return spark.createDataFrame([(round(a, 6), round(b, 6), round(c, 6))], "citl double, intercept double, slope double")


@R.add("""
r AS (SELECT fold, round(avg(p_aug - p_base), 9) AS d FROM sc GROUP BY 1)
SELECT count(d) AS n, round(quantile_cont(d::DOUBLE, 0.025), 6) AS low, round(quantile_cont(d::DOUBLE, 0.975), 6) AS high, round((1 + count(*) FILTER (d - 0.01 >= 0.01)) / (count(d) + 1.0), 6)::DOUBLE AS p FROM r
""")
def interval_and_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I14, I16."""
    d = X.scores(spark, sf_dir).groupBy("fold").agg(F.round(F.avg(F.col("p_aug") - F.col("p_base")), 9).alias("d"))
    return rounded(I.percentile_interval(d, "d").crossJoin(I.centred_p(d, "d", 0.01)), ["low", "high", "p"])


def _area_of(score: str, name: str) -> str:
    return f"""
g{name} AS (SELECT source, {score} AS s, sum(y) AS p, sum(1 - y) AS n FROM sc GROUP BY 1, 2),
a{name} AS (SELECT source, sum(p)::DOUBLE AS c1, sum(n)::DOUBLE AS c0, (sum(n * (cp - p / 2.0)) / (sum(p) * sum(n)))::DOUBLE AS a FROM (SELECT *, sum(p) OVER (PARTITION BY source ORDER BY s DESC) AS cp FROM g{name}) GROUP BY 1),
v{name} AS (SELECT *, (a * (1 - a) + (c1 - 1) * (a / (2 - a) - a * a) + (c0 - 1) * (2 * a * a / (1 + a) - a * a)) / (c1 * c0) AS v FROM a{name})"""


@R.add(f"""{_area_of("p_base", "0").strip()},{_area_of("p_aug", "1")}
SELECT v0.source, v0.c1 AS n_cases, v0.c0 AS n_controls, round(v0.a, 6) AS auc_base, round(v1.a, 6) AS auc_other, round(v0.v, 12) AS variance_base, round(v1.v, 12) AS variance_other, round(v1.a - v0.a, 6) AS difference,
  round(sqrt(v0.v + v1.v - 2 * 0.5 * sqrt(v0.v * v1.v)), 9) AS difference_se FROM v0 JOIN v1 USING (source)
""")
def auc_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances of every source's two areas and the standard error of their difference."""
    got = I.variances(X.scores(spark, sf_dir), ["source"], "y", "p_base", "p_aug", 0.5)
    digits = {"auc_base": 6, "auc_other": 6, "variance_base": 12, "variance_other": 12, "difference": 6, "difference_se": 9}
    return got.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in got.columns])


@R.add()
def power_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power and the detectable difference of every source, with its own area, cases and controls. Tested against a plain version."""
    return rounded(I.power_table(X.scores(spark, sf_dir), ["source"], "y", "p_aug", 0.02, [0.5, 0.9]), ["auroc", "power", "detectable"])


def _ranks(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(x, y), 6) AS rho FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM six WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


_SIX = ["p_base", "p_aug", "fold_low", "gap_base", "gap_aug", "blend"]


@R.add(
    "six AS (SELECT p_base, p_aug, CASE WHEN fold <= 3 THEN fold::DOUBLE END AS fold_low, CASE WHEN p_base > 0.3 THEN p_base END AS gap_base, CASE WHEN case_id % 3 <> 0 THEN p_aug END AS gap_aug, round(p_base * 2 + p_aug, 9) AS blend FROM sc) "
    + " UNION ALL ".join(_ranks(a, b) for i, a in enumerate(_SIX) for b in _SIX[i + 1 :])
)
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six columns with nulls, pair by pair."""
    s = X.scores(spark, sf_dir)
    six = s.select(
        "p_base", "p_aug", F.when(F.col("fold") <= 3, F.col("fold").cast("double")).alias("fold_low"), F.when(F.col("p_base") > 0.3, F.col("p_base")).alias("gap_base"),
        F.when(F.col("case_id") % 3 != 0, F.col("p_aug")).alias("gap_aug"), F.round(F.col("p_base") * 2 + F.col("p_aug"), 9).alias("blend"),
    )
    return rounded(A.correlation_matrix(six, _SIX), ["rho"])


@R.add("""
x AS (SELECT case_id, subject_id % 12 AS subject, fold AS rater, p_base AS v FROM sc), m AS (SELECT subject, rater, avg(v) AS v FROM x GROUP BY 1, 2),
s AS (SELECT count(*) AS n, var_pop(a) AS vs FROM (SELECT subject, avg(v) AS a FROM m GROUP BY 1)), r AS (SELECT count(*) AS k, var_pop(a) AS vr FROM (SELECT rater, avg(v) AS a FROM m GROUP BY 1)), t AS (SELECT var_pop(v) AS vt FROM m),
q AS (SELECT n, k, n * k * vs / (n - 1) AS msr, n * k * vr / (k - 1) AS msc, n * k * (vt - vs - vr) / ((n - 1) * (k - 1)) AS mse FROM s, r, t)
SELECT n AS n_subjects, k AS n_raters, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc_single, round((msr - mse) / (msr + (msc - mse) / n), 6) AS icc_average FROM q
""")
def icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I18."""
    m = X.scores(spark, sf_dir).groupBy((F.col("subject_id") % 12).alias("subject"), F.col("fold").alias("rater")).agg(F.avg("p_base").alias("v"))
    return rounded(I.icc(m, "subject", "rater", "v"), ["icc_single", "icc_average"])


@R.add("SELECT subject_id, count(p_base) AS n, CASE WHEN count(p_base) >= 8 THEN round(avg(p_base), 6) END AS mean_rating FROM sc GROUP BY 1")
def rater_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I20."""
    return rounded(I.rater_mean(X.scores(spark, sf_dir), ["subject_id"], "p_base", 8), ["mean_rating"])


@R.add("""
c AS (SELECT source, count(*) AS c FROM sc GROUP BY 1), t AS (SELECT sum(c) AS t, count(*) AS g FROM c)
SELECT source, round(t / (g * c)::DOUBLE, 6) AS weight, count(*) AS n FROM sc JOIN c USING (source), t GROUP BY 1, 2
""")
def group_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I25."""
    return I.group_weights(X.scores(spark, sf_dir), "source").groupBy("source", r6(F.col("weight"), "weight")).agg(F.count("*").alias("n"))


@R.add("""
f AS (SELECT y, p_base > 0.5 AS high, p_aug > 0.7 AS very_high FROM sc)
SELECT 'high' AS flag, count(*) FILTER (high) AS n_flagged, round(100 * avg(high::INT), 6) AS percent_all, round(100 * avg(CASE WHEN y = 1 THEN high::INT END), 6) AS percent_cases, round(100 * avg(CASE WHEN y = 0 THEN high::INT END), 6) AS percent_controls FROM f
UNION ALL SELECT 'very_high', count(*) FILTER (very_high), round(100 * avg(very_high::INT), 6), round(100 * avg(CASE WHEN y = 1 THEN very_high::INT END), 6), round(100 * avg(CASE WHEN y = 0 THEN very_high::INT END), 6) FROM f
""")
def flag_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9."""
    f = X.scores(spark, sf_dir).withColumns({"high": F.col("p_base") > 0.5, "very_high": F.col("p_aug") > 0.7})
    return rounded(I.prevalence(f, ["high", "very_high"], "y"), ["percent_all", "percent_cases", "percent_controls"])


@R.add("""
m AS (SELECT fold, round(avg(p_base), 9) AS a, round(avg(p_aug), 9) AS b, round(avg(p_base * p_aug), 9) AS c FROM sc GROUP BY 1)
SELECT fold, 'b - a' AS contrast, round(b - a, 6) AS difference FROM m UNION ALL SELECT fold, 'c - a', round(c - a, 6) FROM m
""")
def increment_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I22, D22."""
    s = X.scores(spark, sf_dir)
    rows = F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("p_base").alias("v")), F.struct(F.lit("b").alias("model"), F.col("p_aug").alias("v")), F.struct(F.lit("c").alias("model"), (F.col("p_base") * F.col("p_aug")).alias("v"))))
    m = s.select("fold", rows.alias("x")).groupBy("fold", "x.model").agg(F.round(F.avg("x.v"), 9).alias("value"))
    return rounded(I.increments(m, "fold", "model", "value", [("b", "a"), ("c", "a")]), ["difference"])


@R.add("""
n AS (SELECT source AS name, y, CASE WHEN source IN ('1-URGENT', '2-HIGH') THEN 1 - p_base ELSE p_base END AS s FROM sc)
SELECT name, round(avg(CASE WHEN y = 1 THEN s END), 6) AS mean_cases, round(avg(CASE WHEN y = 0 THEN s END), 6) AS mean_controls FROM n GROUP BY 1
""")
def oriented_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I24."""
    s = X.scores(spark, sf_dir).withColumn("s", I.oriented(F.col("source"), F.col("p_base"), ["1-URGENT", "2-HIGH"]))
    return s.groupBy(F.col("source").alias("name")).agg(r6(F.avg(F.when(F.col("y") == 1, F.col("s"))), "mean_cases"), r6(F.avg(F.when(F.col("y") == 0, F.col("s"))), "mean_controls"))


@R.add("""
r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY p_base) + (count(*) OVER (PARTITION BY source, p_base) - 1) / 2.0 AS a, rank() OVER (PARTITION BY source ORDER BY p_aug) + (count(*) OVER (PARTITION BY source, p_aug) - 1) / 2.0 AS b FROM sc)
SELECT source, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1
""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D23."""
    return rounded(A.spearman(X.scores(spark, sf_dir), "p_base", "p_aug", ["source"]), ["rho"])


@R.add("""
SELECT 'p_base' AS value_name, round(avg(CASE WHEN y = 1 THEN p_base END), 6) AS mean_1, round(avg(CASE WHEN y = 0 THEN p_base END), 6) AS mean_0, round(avg(CASE WHEN y = 1 THEN p_base END) - avg(CASE WHEN y = 0 THEN p_base END), 6) AS difference FROM sc
UNION ALL SELECT 'p_aug', round(avg(CASE WHEN y = 1 THEN p_aug END), 6), round(avg(CASE WHEN y = 0 THEN p_aug END), 6), round(avg(CASE WHEN y = 1 THEN p_aug END) - avg(CASE WHEN y = 0 THEN p_aug END), 6) FROM sc
""")
def contrast_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D24."""
    return rounded(A.contrast(X.scores(spark, sf_dir), "y", ["p_base", "p_aug"]), ["mean_1", "mean_0", "difference"])


@R.add("""
f AS (SELECT source, fold, avg(p_base) AS v FROM sc GROUP BY 1, 2)
SELECT source, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max FROM f GROUP BY 1
""")
def repeat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D25, D26."""
    f = X.scores(spark, sf_dir).groupBy("source", "fold").agg(F.avg("p_base").alias("v"))
    return rounded(A.repeat_summary(f, ["source"], "v"), ["mean", "sd", "min", "max"])


@R.add("""
f AS (SELECT fold, avg(p_aug) - avg(p_base) AS d FROM sc GROUP BY 1)
SELECT round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(100 * avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS percent_positive FROM f
""")
def repeat_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D27."""
    s = X.scores(spark, sf_dir)
    rows = s.select("fold", F.explode(F.array(F.struct(F.lit("base").alias("model"), F.col("p_base").alias("v")), F.struct(F.lit("aug").alias("model"), F.col("p_aug").alias("v")))).alias("x"))
    m = rows.groupBy("fold", "x.model").agg(F.avg("x.v").alias("value"))
    return rounded(A.repeat_difference(m, "fold", "model", "value", "base", "aug"), ["mean", "sd", "low", "high", "percent_positive"])


@R.add("""
m AS (SELECT source, avg(p_aug - p_base) AS e, count(*) AS n FROM sc GROUP BY 1), o AS (SELECT source, avg(p_aug - p_base) AS e, count(*) AS n FROM sc WHERE fold <> 1 GROUP BY 1)
SELECT source, round(100.0 * o.n / m.n, 6)::DOUBLE AS retained_percent, sign(m.e) = sign(o.e) AS same_direction, (o.e - 0.01 > 0 OR o.e + 0.01 < 0) AS excludes_zero FROM m JOIN o USING (source)
""")
def sensitivity_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D33, I21."""
    s = X.scores(spark, sf_dir).withColumn("d", F.col("p_aug") - F.col("p_base"))
    of = lambda d: d.groupBy("source").agg(F.avg("d").alias("e"), F.count("*").alias("n")).withColumns({"lo": F.col("e") - 0.01, "hi": F.col("e") + 0.01})
    return rounded(A.sensitivity(of(s), of(s.where("fold <> 1")), "source", "e", "n", "lo", "hi"), ["retained_percent"])


@R.add("""
p AS (SELECT subject_id, avg(p_base) AS m FROM sc GROUP BY 1)
SELECT decile, count(*) AS n FROM (SELECT CAST(floor((row_number() OVER (ORDER BY m, subject_id) - 1) * 10 / count(*) OVER ()) + 1 AS INT) AS decile FROM p) GROUP BY 1
""")
def risk_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9."""
    p = X.scores(spark, sf_dir).groupBy("subject_id").agg(F.avg("p_base").alias("m"))
    return E.rank_deciles(p, "m", "subject_id").groupBy("decile").agg(F.count("*").alias("n"))


@R.add("SELECT case_id, n FROM (SELECT case_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7|' || case_id), case_id)::INT AS n FROM sc) WHERE n <= 20")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here the order is by hash, so SQL can follow it."""
    from pyspark.sql import Window

    got = E.stratified_sample(X.scores(spark, sf_dir), ["source"], "case_id", 20, seed=7)
    w = Window.partitionBy("source").orderBy(E.hash_order(7, F.col("case_id")), "case_id")
    return got.select("case_id", F.row_number().over(w).alias("n"))


@R.add("SELECT case_id FROM sc ORDER BY sha256('3|' || case_id), case_id LIMIT 200")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14."""
    return E.uniform_sample(X.scores(spark, sf_dir), "case_id", 200, seed=3).select("case_id")


@R.add("p AS (SELECT subject_id, count(*) AS n FROM sc GROUP BY 1) SELECT subject_id, row_number() OVER (ORDER BY sha256('4|' || subject_id), subject_id)::INT AS place FROM p")
def permuted_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15."""
    p = X.scores(spark, sf_dir).groupBy("subject_id").agg(F.count("*").alias("n"))
    return E.permuted(p, "subject_id", seed=4).select("subject_id", "place")


@R.add("SELECT case_id FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha256('5|' || case_id), case_id) AS rn FROM sc) WHERE (y = 1 AND rn <= 100) OR (y = 0 AND rn <= 300)")
def stratified_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I26."""
    return E.stratified_limit(X.scores(spark, sf_dir), "y", "case_id", 400, seed=5).select("case_id")


@R.add()
def crossfit_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of a dense logistic model, one per case."""
    s = X.scores(spark, sf_dir).withColumn("label", F.col("y").cast("double")).withColumn("x_missing", F.when(F.col("p_base") > 0.1, F.col("p_base")))
    s = M.with_missing_indicators(s, ["x_missing"])
    return rounded(M.crossfit(s, [*M.dense_stages(["p_aug", "x_missing"], ["x_missing_missing"]), M.logistic(1.0, s.count())], "fold", "case_id"), ["probability"])


@R.add()
def site_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on one source, scored on another."""
    s = X.scores(spark, sf_dir).withColumn("label", F.col("y").cast("double"))
    train = s.where("source = '1-URGENT'")
    return rounded(M.site_transfer(train, s.where("source = '5-LOW'"), [*M.dense_stages(["p_aug", "p_base"], []), M.logistic(1.0, train.count())], "case_id"), ["probability"])


@R.add()
def refit_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models fitted again in each of 500 replicates. Tested against a loop on repeated rows."""
    return rounded(Z.refit_bootstrap(X.scores(spark, sf_dir), "subject_id", "y", "fold", ["p_base"], ["p_aug"], 500), ["auc_base", "auc_more", "delta"])


@R.add("""
a AS (SELECT subject_id, round(avg(p_base), 9) AS x, round(avg(p_aug), 9) AS y, round(avg(p_base * 2 + fold), 9) AS u, round(avg(p_aug - fold), 9) AS v FROM sc GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y,
  rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0 AS u, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS v FROM a)
SELECT 'x' AS row, round(corr(x, u), 4) AS matched_rho, round(corr(x, v), 4) AS mean_other_rho, CASE WHEN corr(x, u) > corr(x, v) THEN 1 ELSE 2 END AS matched_rank FROM r
UNION ALL SELECT 'y', round(corr(y, v), 4), round(corr(y, u), 4), CASE WHEN corr(y, v) > corr(y, u) THEN 1 ELSE 2 END FROM r
""")
def cross_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I19."""
    a = X.scores(spark, sf_dir).groupBy("subject_id").agg(F.avg("p_base").alias("x"), F.avg("p_aug").alias("y"), F.avg(F.col("p_base") * 2 + F.col("fold")).alias("u"), F.avg(F.col("p_aug") - F.col("fold")).alias("v"))
    got = I.cross_construct(a.select(*[F.round(c, 9).alias(c) for c in ("x", "y", "u", "v")]), ["x", "y"], ["u", "v"])
    return got.select("row", F.round("matched_rho", 4).alias("matched_rho"), F.round("mean_other_rho", 4).alias("mean_other_rho"), "matched_rank")


QUERIES, ORACLE_SQL = R.queries, R.sql
