"""Queries of selections, sinks and sources, sensitivity re-derivations and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.functions import scalars as S
from clinflow.operators import cohort as C
from clinflow.operators import features as H
from clinflow.operators import boosting as B
from clinflow.operators import models as M
from clinflow.operators import ordering as E
from clinflow.operators import resampling as Z
from clinflow.operators import selection as Q
from clinflow.operators import stats as I
from clinflow.operators import text as T
from clinflow.plans import fixtures as X
from clinflow.plans.register import Register
from clinflow.shared import new_path
from clinflow.sources import files
from clinflow.sources import generator as G

R = Register()


@R.add("SELECT note_id, stay_id FROM nt WHERE store_time IS NOT NULL AND text IS NOT NULL")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B10."""
    return Q.required(X.notes(spark, sf_dir), ["store_time", "text"]).select("note_id", "stay_id")


ALLOWED = {"carevue": {"gas": {"a": [1, 2], "b": [5]}, "device": [8]}, "metavision": {"gas": [3, 7]}}


@R.add("SELECT stay_id, itemid, count(*) AS n FROM me JOIN st USING (stay_id) WHERE (dbsource = 'carevue' AND itemid IN (1, 2, 5, 8)) OR (dbsource = 'metavision' AND itemid IN (3, 7)) GROUP BY 1, 2")
def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item counts only in the source system that lists it."""
    m = X.measures(spark, sf_dir).join(X.stays(spark, sf_dir).select("stay_id", "dbsource"), "stay_id")
    return Q.gated(m, ALLOWED).groupBy("stay_id", "itemid").agg(F.count("*").alias("n"))


@R.add("SELECT k AS itemid, CASE WHEN k IN (1, 4) THEN 'first' WHEN k IN (2, 6, 9) THEN 'second' END AS name, count(*) AS n FROM ev WHERE k IN (1, 4, 2, 6, 9) GROUP BY 1, 2")
def inverted_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names to ids as a table of ids."""
    names = Q.id_map(spark, {"first": [1, 4], "second": [2, 6, 9]})
    return X.events(spark, sf_dir).select(F.col("k").alias("itemid")).join(F.broadcast(names), "itemid").groupBy("itemid", "name").agg(F.count("*").alias("n"))


@R.add("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '(?i)brass$|^promo|polished')", fixtures=False)
def discovered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B25."""
    return Q.discovered(X.table(spark, sf_dir, "part"), "p_type", ["brass$", "^promo", "polished"]).select("p_partkey")


@R.add("""
r AS (
  SELECT DISTINCT f.feature, p_partkey AS itemid, p_type = 'PROMO' AS best
  FROM part, (VALUES ('metal', 'brand#11'), ('metal', 'brand#12'), ('wood', 'brand#13'), ('none', 'no such brand')) f(feature, alias) WHERE trim(regexp_replace(lower(p_brand), '\\s+', ' ', 'g')) = alias
)
SELECT feature, itemid FROM (SELECT *, bool_or(best) OVER (PARTITION BY feature) AS any_best FROM r) WHERE best OR NOT any_best
""".replace("\\\\", "\\"), fixtures=True)
def alias_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of normalised labels, rows of the preferred kind where a feature has any."""
    p = X.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "itemid")
    return Q.by_alias(p, "p_brand", "itemid", {"metal": ["Brand#11", " brand#12"], "wood": ["BRAND#13"], "none": ["no such brand"]}, ("p_type", "promo"))


@R.add("""
SELECT p_partkey, 'bolts' AS "group" FROM part WHERE p_type = 'PROMO' AND p_name IN ('large bolt', 'small bolt')
UNION ALL SELECT p_partkey, 'widgets' FROM part WHERE p_type = 'ECONOMY' AND p_name IN ('cold widget', 'small widget')
""", fixtures=False)
def exact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and table must both be the curated ones."""
    curated = {"bolts": ("promo", ["large bolt", "small bolt"]), "widgets": ("economy", ["cold widget", "small widget"])}
    return Q.by_exact_label(X.table(spark, sf_dir, "part"), "p_name", "p_type", "p_partkey", curated)


PRODUCTS = ["Norepinephrine 4 mg IV SOLN", "EPINEPHRINE 1 mg/10 mL SYRG IV SOLN", "epinephrine 4 mg in 250 mL iv soln", "Phenylephrine 10 mg IV SOLN 5 mL", "NEOSYNEPHRINE iv soln 500ML", "vasopressin 20 units 50 mL IV SOLN", "vasopressin 1500 mL IV SOLN", "Lidocaine-Epinephrine IV SOLN 100 mL", "dopamine oral", "Dopamine IV SOLN"]
_PRODUCT = "([" + ", ".join(f"'{p}'" for p in PRODUCTS) + "])[CAST(event_id % 10 + 1 AS INT)]"


@R.add(f"""
p AS (SELECT event_id, {_PRODUCT} AS t FROM ev)
SELECT event_id, CASE t WHEN '{PRODUCTS[0]}' THEN 'norepinephrine' WHEN '{PRODUCTS[2]}' THEN 'epinephrine' WHEN '{PRODUCTS[4]}' THEN 'phenylephrine' WHEN '{PRODUCTS[5]}' THEN 'vasopressin' WHEN '{PRODUCTS[9]}' THEN 'dopamine' END AS agent FROM p
""")
def product_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL states each product's agent."""
    t = F.element_at(F.array(*[F.lit(p) for p in PRODUCTS]), (F.pmod("event_id", F.lit(10)) + 1).cast("int"))
    return X.events(spark, sf_dir).select("event_id", Q.product_agent(t).alias("agent"))


MENTIONS = ["deoxyepinephrine", "Norepinephrine", "an EPINEPHRINE drip", "noradrenaline", "adrenaline", "xdopamine", "dopamine", "nothing"]


@R.add("SELECT event_id, event_id % 8 NOT IN (0, 5, 7) AS named FROM ev")
def look_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the SQL states which of the texts name an agent."""
    t = F.element_at(F.array(*[F.lit(p) for p in MENTIONS]), (F.pmod("event_id", F.lit(8)) + 1).cast("int"))
    return X.events(spark, sf_dir).select("event_id", t.rlike(Q.PRESSOR).alias("named"))


@R.add("""
t AS (SELECT event_id, CASE k % 6 WHEN 0 THEN '  NaN ' WHEN 1 THEN 'n/a' WHEN 2 THEN ' two  spaces ' WHEN 3 THEN 'was Intubated' WHEN 4 THEN '' END AS t FROM ev)
SELECT event_id, CASE WHEN lower(trim(t)) IN ('', 'nan', 'none', 'null') OR t LIKE '%Intubated%' THEN NULL ELSE trim(t) END AS text FROM t
""")
def note_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    m = F.col("k") % 6
    t = F.when(m == 0, "  NaN ").when(m == 1, "n/a").when(m == 2, " two  spaces ").when(m == 3, "was Intubated").when(m == 4, "")
    return X.events(spark, sf_dir).select("event_id", T.cleaned(t, ["intubat"]).alias("text"))


@R.add("SELECT note_id FROM nt JOIN st USING (stay_id) WHERE store_time <= landmark_time")
def store_time_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes stored by the landmark."""
    n = X.notes(spark, sf_dir).join(X.stays(spark, sf_dir).select("stay_id", "landmark_time"), "stay_id")
    return Q.stored_by(n, "store_time", "landmark_time").select("note_id")


@R.add("""
SELECT stay_id, lag AS lag_hours, count(*) AS n, round(max(value), 6) AS highest FROM me JOIN st USING (stay_id), (VALUES (0), (1), (2)) l(lag)
WHERE charttime <= landmark_time AND charttime >= landmark_time - INTERVAL 6 HOUR AND charttime + to_hours(lag) <= landmark_time GROUP BY 1, 2
""")
def result_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features under results that come 0, 1 and 2 hours late, from one join."""
    got = Q.lagged_lookbacks(X.measures(spark, sf_dir), X.stays(spark, sf_dir).select("stay_id", "landmark_time"), "stay_id", "charttime", "landmark_time", 6, [0, 1, 2])
    return got.groupBy("stay_id", "lag_hours").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("highest"))


@R.add("SELECT c_custkey, CASE WHEN n > 3 THEN n END AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey", fixtures=False)
def aligned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17, C4: values brought to a cohort's rows, null where there are none."""
    n = X.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n > 3")
    return Q.aligned(X.table(spark, sf_dir, "customer").select("c_custkey"), n, "c_custkey", ["n"])


@R.add("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders", fixtures=False)
def bound_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two tables of the same keys."""
    o = X.table(spark, sf_dir, "orders")
    return Q.bound(o.select("o_orderkey", "o_custkey"), o.select("o_orderkey", F.round("o_totalprice", 2).alias("price")), "o_orderkey")


@R.add("SELECT subject_id::VARCHAR AS match_set, count(*) AS n, sum(y) AS cases FROM sc GROUP BY 1 HAVING count(*) <> 4 OR sum(y) <> 1")
def broken_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return C.bad_sets(X.scores(spark, sf_dir).select(F.col("subject_id").cast("string").alias("match_set"), F.col("y").alias("label")), 3)


@R.add("SELECT case_id FROM sc WHERE subject_id NOT IN (SELECT subject_id FROM sc WHERE p_base <= 0.2)")
def whole_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets all of whose rows meet the condition."""
    return C.whole_sets(X.scores(spark, sf_dir), F.col("p_base") > 0.2, "subject_id").select("case_id")


@R.add("SELECT stay_id, round(date_diff('day', intime - to_days(CAST(subject_id % 40000 AS INT)), intime) / 365.2425, 6) AS age FROM st")
def age_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B15."""
    s = X.stays(spark, sf_dir).withColumn("birth", F.timestamp_add("DAY", -(F.col("subject_id") % 40000).cast("int"), F.col("intime")))
    return s.select("stay_id", F.round(S.age_years(F.col("birth"), F.col("intime")), 6).alias("age"))


@R.add("""
x AS (SELECT event_id, value, CASE k % 4 WHEN 0 THEN ' m' WHEN 1 THEN 'F' WHEN 2 THEN 'M' ELSE 'f ' END AS sex, CASE k % 3 WHEN 0 THEN '1.0 ET/Trach' WHEN 1 THEN ' No Response-ETT' ELSE 'Oriented' END AS verbal, CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' END AS flag FROM ev)
SELECT event_id, round(CASE WHEN value > 70 AND value < 120 THEN (value - 32) / 1.8 END, 6) AS celsius, verbal <> 'Oriented' AS airway, CASE WHEN upper(trim(sex)) = 'M' THEN 1.0 ELSE 0.0 END AS male, coalesce(flag = 'Yes', false) AS yes,
  (trim(upper(sex)) = 'M')::INT::DOUBLE AS sex_M, (trim(upper(sex)) = 'F')::INT::DOUBLE AS sex_F FROM x
""")
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B17, B18, B23, B24, B30."""
    m, n = F.col("k") % 4, F.col("k") % 3
    e = X.events(spark, sf_dir).select(
        "event_id", "value", F.when(m == 0, " m").when(m == 1, "F").when(m == 2, "M").otherwise("f ").alias("sex"),
        F.when(n == 0, "1.0 ET/Trach").when(n == 1, " No Response-ETT").otherwise("Oriented").alias("verbal"), F.when(n == 0, "Yes").when(n == 1, "0").alias("flag"),
    )
    return e.select(
        "event_id", F.round(S.celsius(F.col("value")), 6).alias("celsius"), S.airway_coded(F.col("verbal")).alias("airway"), S.sex_code(F.col("sex")).alias("male"), S.truthy(F.col("flag")).alias("yes"),
        *S.one_hot(F.trim(F.upper("sex")), ["M", "F"], "sex_"),
    )


@R.add("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_time END AS moment FROM ev")
def tolerant_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that is no time gives null."""
    return X.events(spark, sf_dir).select("event_id", S.moment(F.when(F.col("event_id") % 3 > 0, F.col("event_time").cast("string")).otherwise("unknown")).alias("moment"))


@R.add("SELECT event_id::VARCHAR AS case_id, round(value / 1000, 6) AS noul FROM ev WHERE event_type = 'signup' AND k % 5 <> 0")
def answers_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as JSON lines and read back; those that failed are left out."""
    answer = F.struct(F.round(F.col("value") / 1000, 6).alias("noul"))
    rows = X.events(spark, sf_dir).where("event_type = 'signup'").select(
        F.col("event_id").cast("string").alias("case_id"), F.when(F.col("k") % 5 == 0, "failed").otherwise("ok").alias("status"), F.struct(F.create_map(F.lit("x"), answer).alias("answers")).alias("response")
    )
    files.write_json_lines(rows, path := new_path(spark))
    return files.read_answers(spark, path, strict=False).select("case_id", F.round(F.col("response.answers")["x"]["noul"], 6).alias("noul"))


@R.add("SELECT p_partkey, p_name, p_size::DOUBLE AS p_size, NULL::VARCHAR AS absent FROM part", fixtures=False)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guarded export and its projected scan; names are matched in any case, a column that is not there is null."""
    p = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("P_PARTKEY"), F.col("p_name").alias("P_Name"), "p_size", "p_type")
    files.write_aggregate(p, path := new_path(spark))
    return files.read_csv(spark, path, ["p_partkey", "p_name", "p_size", "absent"], {"p_partkey": "long", "p_size": "double"})


@R.add("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderstatus = 'F')", fixtures=False)
def remaining_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to do."""
    o = X.table(spark, sf_dir, "orders")
    done = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"))
    return files.remaining(o.select("o_orderkey"), done, "o_orderkey")


_TAILS, _term, _tail = [], 0.36787944117144233, 0.0
for _k in range(1, 12):
    _tail += _term
    _TAILS.append(_tail)
    _term /= _k


def drawn(cluster: str, seed: int = 1) -> str:
    """SQL of the number of times a cluster is drawn in the replicate `r`."""
    u = f"CAST(('0x' || substr(sha256('{seed}|' || r || '|' || {cluster}), 1, 13)) AS BIGINT) / 4503599627370496.0"
    return "(" + " + ".join(f"(({u}) >= {t!r})::INT" for t in _TAILS) + ")"


def _areas(cluster: str, rows: str = "sc") -> str:
    one = lambda s, n: f"""
g{n} AS (SELECT r, {s} AS s, sum(CASE WHEN y = 1 THEN m ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN m ELSE 0 END) AS n FROM x GROUP BY 1, 2),
a{n} AS (SELECT r, sum(n * (cp - p / 2.0)) / (sum(p) * sum(n)) AS a FROM (SELECT *, sum(p) OVER (PARTITION BY r ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp FROM g{n}) GROUP BY 1)"""  # noqa: E731
    return f"""
w AS (SELECT k, r, {drawn("k")} AS m FROM (SELECT DISTINCT {cluster} AS k FROM {rows}), (SELECT unnest(range(1, 501)) AS r)),
x AS (SELECT r, y, p_base, p_aug, m FROM {rows} JOIN w ON k = {cluster} WHERE m > 0),{one("p_base", 0)},{one("p_aug", 1)}
SELECT CAST(a0.r AS INT) AS replicate, round(a0.a, 6) AS auc_base, round(a1.a, 6) AS auc_other, round(a1.a - a0.a, 6) AS delta FROM a0 JOIN a1 USING (r)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("replicate", *[F.round(c, 6).alias(c) for c in ("auc_base", "auc_other", "delta")])


@R.add(_areas("subject_id"))
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences under common patient weights, 500 replicates."""
    return _rounded(Z.cluster_bootstrap(X.scores(spark, sf_dir), "subject_id", "y", "p_base", "p_aug", 500))


@R.add(_areas("(case_id % 500)"))
def matched_set_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched sets are drawn whole, 500 replicates."""
    return _rounded(Z.cluster_bootstrap(X.scores(spark, sf_dir).withColumn("match_set", F.col("case_id") % 500), "match_set", "y", "p_base", "p_aug", 500))


@R.add(f"""
x AS (SELECT source, r, sum(m * p_base) / sum(m) AS v FROM (SELECT source, r, p_base, {drawn("case_id")} AS m FROM sc, (SELECT unnest(range(1, 501)) AS r)) GROUP BY 1, 2)
SELECT source, n, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM x JOIN (SELECT source, count(*) AS n FROM sc GROUP BY 1) USING (source) GROUP BY 1, 2
""")
def mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of every source, 500 replicates."""
    got = Z.mean_bootstrap(X.scores(spark, sf_dir), ["source"], "case_id", "p_base", 500)
    return got.select("source", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@R.add("""
g AS (SELECT source, p_aug, sum(y) AS p, sum(1 - y) AS n FROM sc GROUP BY 1, 2)
SELECT source, sum(p)::DOUBLE AS n_cases, sum(n)::DOUBLE AS n_controls, round(sum(n * (cp - p / 2.0)) / (sum(p) * sum(n)), 6) AS auroc FROM (SELECT *, sum(p) OVER (PARTITION BY source ORDER BY p_aug DESC ROWS UNBOUNDED PRECEDING) AS cp FROM g) GROUP BY 1
""")
def subset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of every source's subset, without another fit."""
    return I.auroc(X.scores(spark, sf_dir), "y", "p_aug", ["source"]).select("source", "n_cases", "n_controls", F.round("auroc", 6).alias("auroc"))


@R.add()
def source_proxy_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the features tell the source system; tested on features that do and do not."""
    got = M.source_proxy(X.scores(spark, sf_dir), ["p_base", "p_aug"], "source", "1-URGENT", "fold", "case_id")
    return got.select("n_cases", "n_controls", F.round("auroc", 3).alias("auroc"))


_FOLD = lambda seed: f"(SELECT subject_id, CAST((row_number() OVER (PARTITION BY c, n ORDER BY sha256('{seed}|' || subject_id), subject_id) + CAST(floor(CAST(('0x' || substr(sha256('{seed}|' || c || '|' || n), 1, 13)) AS BIGINT) / 4503599627370496.0 * 5) AS INT)) % 5 + 1 AS INT) AS fold FROM per)"
SEEDS = [20260924, 20260925, 20260926, 20260927, 20260928]


@R.add(
    "per AS (SELECT subject_id, sum(y)::BIGINT AS c, count(*) AS n FROM sc GROUP BY 1) SELECT f1.subject_id, "
    + ", ".join(f"f{i}.fold AS repeat_{i}_fold" for i in range(1, 6))
    + f" FROM {_FOLD(SEEDS[0])} f1 "
    + " ".join(f"JOIN {_FOLD(s)} f{i} ON f{i}.subject_id = f1.subject_id" for i, s in enumerate(SEEDS[1:], 2))
)
def repeated_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five times five folds."""
    return M.repeated_folds(X.scores(spark, sf_dir), "subject_id", "y", SEEDS)


@R.add("""
k AS (SELECT source, max(c) AS shift, sum(c) AS total FROM (SELECT source, subject_id, count(*) AS c FROM sc GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT case_id, subject_id, source, p_aug, row_number() OVER (PARTITION BY source ORDER BY sha256('1|' || subject_id), subject_id, sha256('1|' || case_id), case_id) - 1 AS at FROM sc)
SELECT o.case_id, o.subject_id, o.source, CASE WHEN d.subject_id <> o.subject_id THEN d.subject_id END AS donor_subject, CASE WHEN d.subject_id <> o.subject_id THEN d.p_aug END AS p_aug
FROM o JOIN k USING (source) JOIN o d ON d.source = o.source AND d.at = (o.at + k.shift) % k.total
""")
def deranged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values from another subject of the stratum."""
    return E.deranged(X.scores(spark, sf_dir).select("case_id", "subject_id", "source", "p_aug"), "source", "subject_id", "case_id", ["p_aug"])


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores with a feature that is missing where it is small."""
    return X.scores(spark, sf_dir).withColumn("gap", F.when(F.col("p_base") > 0.1, F.col("p_base")))


@R.add()
def boosted_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 rounds of boosted trees with missing values, fitted on all sources but one and scored on that one. Tested against plain-Python boosting."""
    s = _gapped(spark, sf_dir).withColumn("site", (F.col("source") == "5-LOW").cast("int"))
    return B.crossfit_boosted(s, ["p_aug", "gap"], "y", "site", "case_id", [1]).select("case_id", F.round("probability", 6).alias("probability"))


@R.add()
def boosted_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of boosted trees, five folds side by side with a job a level, as for tables of any number of distinct rows; 3 rounds. Tested against plain-Python boosting."""
    got = B.crossfit_boosted(_gapped(spark, sf_dir), ["p_aug", "gap"], "y", "fold", "case_id", [1, 2, 3, 4, 5], B.Boosting(rounds=3), cells=0)
    return got.select("case_id", "fold", F.round("probability", 6).alias("probability"))


@R.add()
def lexical_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the texts beside a dense column; labelled documents outside fold 1 teach, those of fold 1 are scored."""
    d = X.table(spark, sf_dir, "documents").join(X.table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    d = d.withColumn("log_chars", F.log1p("n_chars")).select("doc_id", "text", "label", "log_chars")
    taught = d.where(F.pmod("doc_id", F.lit(5)) != 1)
    ready = M.stacked(["log_chars", "tfidf"]).transform(M.tfidf(taught, d, "text"))
    got = M.site_transfer(ready.where(F.pmod("doc_id", F.lit(5)) != 1), ready.where(F.pmod("doc_id", F.lit(5)) == 1), [M.logistic(1.0, taught.count())], "doc_id")
    return got.select("doc_id", F.round("probability", 4).alias("probability"))


def _draw(what: str) -> str:
    return f"CAST(('0x' || substr(sha256('1|' || subject_id || '|' || {what}), 1, 13)) AS BIGINT) / 4503599627370496.0"


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"('{r[0]}', {', '.join(f'CAST({x} AS DOUBLE)' for x in r[2:])})" for r in rows)


_SUBJECTS = f"""
WITH sub AS (
  SELECT subject_id, (['vasopressor', 'intubation', 'death', 'stable'])[CAST(floor({_draw("'course'")} * 4) AS INT) + 1] AS course,
         CASE WHEN {_draw("'discordant'")} < 0.25 THEN 3.0::DOUBLE ELSE 10.0::DOUBLE END AS onset, {_draw("'system'")} < 0.5 AS mv,
         CAST(floor({_draw("'event'")} * 36) AS INT) + 24 AS event_hour
  FROM (SELECT c_custkey AS subject_id FROM customer)
)"""


@R.add(f"""{_SUBJECTS},
v AS (
  SELECT course, feature, floor((middle + spread * (2 * {_draw("hour || '|' || feature")} - 1)
    + CASE course WHEN 'vasopressor' THEN a WHEN 'intubation' THEN b WHEN 'death' THEN c ELSE 0 END
    * CASE WHEN course <> 'stable' AND event_hour >= hour THEN greatest(0, (onset - (event_hour - hour)) / onset) ELSE 0 END) * 1000 + 0.5) AS milli
  FROM sub, (SELECT unnest(range(0, {G.STAY_HOURS}, {G.CHART_EVERY})) AS hour) h, (VALUES {_values(G.CHARTS)}) f(feature, middle, spread, a, b, c)
)
SELECT course, feature, count(*) AS n, CAST(sum(milli) AS BIGINT) AS total_milli, min(milli) / 1000 AS low, max(milli) / 1000 AS high FROM v GROUP BY 1, 2
""", fixtures=False)
def synthetic_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charts made for every customer, by course and feature. Charts are summed up by subject, where they are made, before they meet the courses: Spark takes the made table for as small as its subjects and would broadcast it."""
    made = G.related_tables(X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id")))
    own = made["chartevents"].groupBy("subject_id", "feature").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("total_milli"), F.min("value").alias("low"), F.max("value").alias("high"))
    got = own.join(made["truth"].select("subject_id", "course").hint("merge"), "subject_id").groupBy("course", "feature")
    return got.agg(F.sum("n").alias("n"), F.sum("total_milli").alias("total_milli"), F.min("low").alias("low"), F.max("high").alias("high"))


@R.add(f"""{_SUBJECTS}
SELECT 'admissions' AS name, count(*) AS n, count(*) FILTER (course = 'death') AS special FROM sub
UNION ALL SELECT 'icustays', count(*), count(*) FILTER (mv) FROM sub
UNION ALL SELECT 'labevents', count(*) * {len(G.LABS) * G.STAY_HOURS // G.LAB_EVERY}, count(*) * {G.STAY_HOURS // G.LAB_EVERY} FROM sub
UNION ALL SELECT 'noteevents', count(*), count(*) FILTER (course <> 'stable' AND event_hour - hour BETWEEN 0 AND 10) FROM sub, (SELECT unnest({list(G.NOTE_HOURS)}) AS hour) h
UNION ALL SELECT 'inputevents_mv', count(*) FILTER (mv), 0 FROM sub WHERE course = 'vasopressor'
UNION ALL SELECT 'inputevents_cv', count(*) FILTER (NOT mv), 0 FROM sub WHERE course = 'vasopressor'
UNION ALL SELECT 'procedureevents_mv', count(*) FILTER (mv), 0 FROM sub WHERE course = 'intubation'
UNION ALL SELECT 'd_items', {len(G.CHARTS) + 2}, 0 UNION ALL SELECT 'd_labitems', {len(G.LABS)}, 0
""", fixtures=False)
def synthetic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the other tables made for every customer; special: deaths, one source system, one laboratory value, worsening notes."""
    made = G.related_tables(X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id")))
    special = {"admissions": "deathtime is not null", "icustays": "dbsource = 'metavision'", "labevents": "feature = 'wbc'", "noteevents": f"text = '{G.WORSE}'"}
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_if(F.expr(special.get(name, "false"))).alias("special")) for name, t in made.items() if name not in ("truth", "chartevents")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@R.add("""
p AS (SELECT stay_id, feature, charttime, avg(value) AS v FROM me WHERE (feature = 'hr' AND value > 0 AND value < 300) OR (feature = 'lactate' AND value > 0 AND value < 50) GROUP BY 1, 2, 3),
q AS (
  SELECT note_id, feature, arg_max(v, charttime) AS l, CASE WHEN count(*) >= 2 THEN arg_max(v, charttime) - arg_min(v, charttime) END AS d
  FROM nt JOIN p USING (stay_id) WHERE charttime BETWEEN chart_time - INTERVAL 24 HOUR AND chart_time GROUP BY 1, 2)
SELECT nt.note_id, round(max(CASE WHEN feature = 'hr' THEN l END), 6) AS hr_last, round(max(CASE WHEN feature = 'hr' THEN d END), 6) AS hr_delta,
  round(max(CASE WHEN feature = 'lactate' THEN l END), 6) AS lactate_last, round(max(CASE WHEN feature = 'lactate' THEN d END), 6) AS lactate_delta
FROM nt LEFT JOIN q ON q.note_id = nt.note_id GROUP BY 1
""")
def snapshot_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value and change before every note, within its stay."""
    got = H.per_snapshot(X.measures(spark, sf_dir), X.notes(spark, sf_dir).select("note_id", "stay_id", "chart_time"), ["hr", "lactate"], 24)
    return got.select("note_id", *[F.round(c, 6).alias(c) for c in got.columns if c != "note_id"])


@R.add()
def snapshot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes within 12 hours of an event and three notes of others each, by source, category and clock, all in one order. Tested against a brute-force version."""
    s = X.stays(spark, sf_dir).select("stay_id", "subject_id", "intime", "outtime", "dbsource")
    event = X.evidence(spark, sf_dir).groupBy("stay_id").agg(F.min("event_time").alias("event_time"))
    n = X.notes(spark, sf_dir).join(s, "stay_id").join(event, "stay_id", "left")
    n = n.select(F.col("note_id").alias("id"), "stay_id", "subject_id", "dbsource", F.lower(F.trim("category")).alias("category"), "chart_time", "outtime", S.hours(F.col("chart_time"), F.col("intime")).alias("clock"), S.hours(F.col("event_time"), F.col("chart_time")).alias("ahead"))
    cases = E.earliest(n.where("ahead > 0 and ahead <= 12"), ["subject_id"], "ahead", "id")
    later = S.hours(F.col("outtime"), F.col("chart_time")) >= 12
    controls = n.join(cases.select("subject_id"), "subject_id", "left_anti").where(later & (F.col("ahead").isNull() | (F.col("ahead") > 12))).withColumn("bin", F.floor(F.col("clock") / 6))
    controls = E.earliest(controls, ["subject_id", "stay_id", "bin", "category"], "chart_time", "id")
    keep = lambda d: d.select("id", "subject_id", "dbsource", "category", "clock", F.lit(1).alias("block"))
    return C.match(keep(cases), keep(controls), "block", "clock", k=3, category="category", exact="dbsource")


@R.add()
def balanced_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of each kind of evidence that share a subject go to one part, by squared deviation from 70, 15 and 15 per cent. Tested against a brute-force version."""
    sets = X.evidence(spark, sf_dir).select(F.concat_ws(":", "evidence", "stay_id").alias("match_set"), "evidence", "subject_id").distinct()
    labels = C.set_components(sets)
    rows = X.evidence(spark, sf_dir).groupBy(F.concat_ws(":", "evidence", "stay_id").alias("match_set"), "evidence").agg(F.count("*").alias("rows"))
    sizes = labels.join(rows, "match_set").groupBy("component", "evidence").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    return labels.join(C.allocate_balanced(sizes, "component", "evidence", "n", rows="rows"), "component").select("match_set", "component", "part")


QUERIES, ORACLE_SQL = R.queries, R.sql
