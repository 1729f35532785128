"""Queries of comparator matrices, note windows with pseudo-anchors, scripts and forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.operators import cohort as C
from clinflow.operators import features as H
from clinflow.operators import forest as W
from clinflow.operators import models as M
from clinflow.operators import text as T
from clinflow.plans import cohort_queries as Q
from clinflow.plans import fixtures as X
from clinflow.plans.register import Register

R = Register()

#: Features of the nested levels, each with the block it comes from.
LEVELS = {
    "A": ["hr_last", "hr_delta", "sbp_last", "sbp_delta", "rr_last", "rr_delta", "lactate_last", "net_volume"],
    "B": ["percent_last", "low_item", "high_value", "active_any", "active_agents", "recent_any", "recent_agents"],
    "C": ["n_notes", "n_categories", "total_chars", "latest_chars", "mean_chars", "hours_since_latest"],
    "D": ["has_note", *[f"note_category_{g}" for g in ("nursing", "physician", "respiratory", "other", "no_note")]],
}
_BLOCKS = ["vitals_block", "labs_block", "net_volume", "context_block", "infusion_context", "note_behaviour"]
ALL = [f for own in LEVELS.values() for f in own]

_LATEST_SQL = """(SELECT stay_id, CASE WHEN note_id IS NULL THEN 'no_note' WHEN lower(trim(category)) LIKE 'nursing%' THEN 'nursing' WHEN lower(trim(category)) LIKE 'physician%' THEN 'physician' WHEN lower(trim(category)) LIKE 'respiratory%' THEN 'respiratory' ELSE 'other' END AS g
FROM (SELECT st.stay_id, nt.note_id, nt.category, row_number() OVER (PARTITION BY st.stay_id ORDER BY chart_time DESC, note_id DESC) AS rn FROM st LEFT JOIN nt ON nt.stay_id = st.stay_id AND chart_time BETWEEN landmark_time - INTERVAL 12 HOUR AND landmark_time) WHERE rn = 1)"""
_MATRIX_SQL = (
    "mx AS (SELECT * EXCLUDE (g), CASE WHEN g <> 'no_note' THEN 1.0 ELSE 0.0 END::DOUBLE AS has_note, "
    + ", ".join(f"CASE WHEN g = '{g.removeprefix('note_category_')}' THEN 1.0 ELSE 0.0 END::DOUBLE AS {g}" for g in LEVELS["D"][1:])
    + f" FROM {_LATEST_SQL} "
    + " ".join(f"JOIN ({Q.ORACLE_SQL[b]}) USING (stay_id)" for b in _BLOCKS)
    + ") "
)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id and the features of all levels."""
    stays = X.stays(spark, sf_dir)
    near = X.notes(spark, sf_dir).join(stays.select("stay_id", "landmark_time"), "stay_id").where("chart_time <= landmark_time and chart_time >= landmark_time - interval 12 hours")
    group = F.lower(F.trim("category"))
    known = F.when(group.startswith("nursing"), "nursing").when(group.startswith("physician"), "physician").when(group.startswith("respiratory"), "respiratory").otherwise("other")
    latest = near.groupBy("stay_id").agg(F.max_by(known, F.struct("chart_time", "note_id")).alias("g"))
    notes = stays.select("stay_id").join(latest, "stay_id", "left").withColumn("g", F.coalesce("g", F.lit("no_note")))
    notes = notes.select("stay_id", (F.col("g") != "no_note").cast("double").alias("has_note"), *[(F.col("g") == c.removeprefix("note_category_")).cast("double").alias(c) for c in LEVELS["D"][1:]])
    return H.matrix(stays.select("stay_id"), [*[Q.QUERIES[b](spark, sf_dir) for b in _BLOCKS], notes], len(ALL)).select("stay_id", *ALL)


@R.add(_MATRIX_SQL + f"SELECT stay_id, {', '.join(ALL)} FROM mx")
def comparator_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: all features of a stay, their number checked."""
    return _matrix(spark, sf_dir)


def _level_sql() -> str:
    out, so_far = [], []
    for name, own in LEVELS.items():
        so_far = so_far + own
        out.append(f"SELECT '{name}' AS level, {len(so_far)} AS n_features, round(avg(({' + '.join(f'({c} IS NOT NULL)::INT' for c in so_far)}) / {len(so_far)}.0), 6) AS known_share FROM mx")
    return " UNION ALL ".join(out)


@R.add(_MATRIX_SQL + _level_sql())
def comparator_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested levels, and the share of known values in each."""
    nested = H.levels(LEVELS, ALL)
    share = lambda names: F.avg(sum((F.col(c).isNotNull().cast("double") for c in names), F.lit(0.0)) / len(names))
    wide = _matrix(spark, sf_dir).agg(*[F.round(share(names), 6).alias(level) for level, names in nested.items()])
    rows = [F.struct(F.lit(level).alias("level"), F.lit(len(names)).alias("n_features"), F.col(level).alias("known_share")) for level, names in nested.items()]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _source_sql(name: str, condition: str) -> str:
    return f"""p{name} AS (SELECT me.stay_id, charttime, avg(value) AS v FROM me JOIN st USING (stay_id) WHERE feature = 'hr' AND value > 0 AND value < 300 AND charttime BETWEEN landmark_time - INTERVAL 24 HOUR AND landmark_time AND {condition} GROUP BY 1, 2),
q{name} AS (SELECT stay_id, arg_max(v, charttime) AS l, CASE WHEN count(*) >= 2 THEN arg_max(v, charttime) - arg_min(v, charttime) END AS d FROM p{name} GROUP BY 1)"""


@R.add(f"""{_source_sql("a", "itemid % 3 = 0")}, {_source_sql("b", "itemid % 3 <> 0")}
SELECT st.stay_id, round(coalesce(qa.l, qb.l), 6) AS hr_last, round(coalesce(qa.d, qb.d), 6) AS hr_delta FROM st LEFT JOIN qa ON qa.stay_id = st.stay_id LEFT JOIN qb ON qb.stay_id = st.stay_id
""")
def vitals_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source's values, and where it has none the other's."""
    m, stays = X.measures(spark, sf_dir), X.stays(spark, sf_dir)
    first, second = (H.block(m.where(c), stays, ["hr"], 24, delta=True) for c in ("itemid % 3 = 0", "itemid % 3 <> 0"))
    both = first.alias("a").join(second.alias("b"), "stay_id")
    return both.select("stay_id", *[F.round(H.fallback(F.col(f"a.{c}"), F.col(f"b.{c}")), 6).alias(c) for c in ("hr_last", "hr_delta")])


@R.add("""
w AS (SELECT me.stay_id, feature, charttime, itemid, round(value) AS v FROM me JOIN st USING (stay_id) WHERE charttime BETWEEN landmark_time - INTERVAL 24 HOUR AND landmark_time),
l AS (SELECT stay_id, feature, arg_max(v, (charttime, itemid, v)) AS v FROM w WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT st.stay_id, max(CASE WHEN feature = 'hr' THEN v END) AS hr_last, max(CASE WHEN feature = 'rr' THEN v END) AS rr_last, max(CASE WHEN feature = 'sbp' THEN v END) AS sbp_last FROM st LEFT JOIN l ON l.stay_id = st.stay_id GROUP BY 1
""")
def last_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: the last value of three scores each, taken as it stands and not averaged."""
    m = X.measures(spark, sf_dir).withColumn("value", F.round("value"))
    return H.last_values(m, X.stays(spark, sf_dir), ["hr", "rr", "sbp"], 24, tie="itemid")


_ANCHORS = """
f AS (SELECT stay_id, min(event_time) AS event_time FROM evi WHERE evidence = 'error' GROUP BY 1),
l AS (SELECT stay_id, max(chart_time) AS t FROM nt GROUP BY 1),
an AS (SELECT l.stay_id, CASE WHEN f.stay_id IS NULL THEN 'stable_control' ELSE 'event' END AS anchor_type, coalesce(f.event_time, l.t + INTERVAL 3 HOUR) AS event_time FROM l LEFT JOIN f ON f.stay_id = l.stay_id),
x AS (SELECT an.stay_id, anchor_type, note_id, lower(trim(category)) AS category, date_diff('microsecond', chart_time, event_time) / 3.6e9 AS h FROM nt JOIN an USING (stay_id)),
y AS (SELECT *, CASE WHEN h > 0 AND h <= 24 THEN '0-24' WHEN h > 24 AND h <= 72 THEN '24-72' END AS time_bin FROM x)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = X.notes(spark, sf_dir).withColumn("category", F.lower(F.trim("category")))
    anchors = C.anchors(X.evidence(spark, sf_dir).where("evidence = 'error'"), notes, "stay_id", 3)
    return C.binned_notes(anchors, notes, "stay_id", WINDOWS)


WINDOWS = [(0.0, 24.0, "0-24"), (24.0, 72.0, "24-72")]
PREFERENCE = ["nursing", "nursing/other", "physician", "general", "respiratory"]


@R.add(f"{_ANCHORS.strip()}, z AS (SELECT *, row_number() OVER (PARTITION BY stay_id, time_bin ORDER BY h, note_id) AS rn FROM y WHERE time_bin IS NOT NULL) SELECT stay_id, anchor_type, time_bin, note_id FROM z WHERE rn = 1")
def pseudo_anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest note of each window before the event or, for stays without one, before three hours after their last note."""
    return C.closest_of_bins(_windows(spark, sf_dir), ["stay_id", "anchor_type"]).select("stay_id", "anchor_type", "time_bin", "note_id")


@R.add(f"""{_ANCHORS.strip()},
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stay_id, time_bin, category ORDER BY h, note_id) AS rn FROM y WHERE time_bin IS NOT NULL) WHERE rn = 1),
g AS (SELECT stay_id, category, coalesce(list_position(['nursing', 'nursing/other', 'physician', 'general', 'respiratory'], category), 99) AS p FROM c GROUP BY 1, 2 HAVING count(DISTINCT time_bin) = 2),
b AS (SELECT stay_id, category FROM (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY p, category) AS rn FROM g) WHERE rn = 1),
s AS (SELECT stay_id, anchor_type, row_number() OVER (PARTITION BY anchor_type ORDER BY sha256('9|' || stay_id), stay_id) AS rn FROM (SELECT DISTINCT b.stay_id, anchor_type FROM b JOIN an USING (stay_id)))
SELECT c.stay_id, c.anchor_type, c.time_bin, c.category, c.note_id FROM c JOIN b ON b.stay_id = c.stay_id AND b.category = c.category JOIN s ON s.stay_id = c.stay_id WHERE s.rn <= 40
""")
def preferred_category_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays with a note of one category in every window, the category by a fixed preference; of each kind of anchor a seeded sample of 40 stays."""
    got = C.one_category(_windows(spark, sf_dir), ["stay_id", "anchor_type"], [w[2] for w in WINDOWS], PREFERENCE)
    return C.sampled_sets(got, "anchor_type", "stay_id", 40, seed=9).select("stay_id", "anchor_type", "time_bin", "category", "note_id")


@R.add(r"SELECT count(*) AS n_sampled, round(avg(regexp_matches(text, '[äöüß]')::INT), 6) AS share FROM (SELECT text FROM documents WHERE text IS NOT NULL ORDER BY sha256('20260920|' || doc_id), doc_id LIMIT 5000)", fixtures=False)
def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts with letters of a class (here four of German; the operator's default is CJK), in a seeded sample of 5,000."""
    got = T.script_share(X.table(spark, sf_dir, "documents"), "text", "doc_id", "[äöüß]")
    return got.select("n_sampled", F.round("share", 6).alias("share"))


@R.add()
def forest_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of a forest of 100 trees; columns are told apart by their role."""
    s = X.scores(spark, sf_dir).withColumn("label", F.col("y").cast("double")).withColumn("has_note", (F.col("fold") % 2).cast("double"))
    s = s.withColumn("note_category_nursing", (F.col("source") == "2-HIGH").cast("double")).withColumn("p_gap", F.when(F.col("p_base") > 0.1, F.col("p_base")))
    role = M.roles(["p_aug", "p_gap", "has_note", "note_category_nursing"])
    got = W.crossfit_forest(s, role["continuous"], role["binary"], "label", "fold", "case_id")
    return got.select("case_id", "fold", F.round("probability", 4).alias("probability"))


QUERIES, ORACLE_SQL = R.queries, R.sql
