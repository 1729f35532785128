"""Queries over the plain tables: casts, masks, joins, histograms, checks and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinflow.functions import scalars as S
from clinflow.operators import aggregates as A
from clinflow.operators import joins as J
from clinflow.operators import ordering as E
from clinflow.operators import text as T
from clinflow.plans import fixtures as X
from clinflow.plans.register import Register

R = Register()
WORDS = ["token", "password", "secret"]


def r6(c, name):
    return F.round(c, 6).alias(name)


@R.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_returnflag = 'A'", fixtures=False)
def projected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns and two predicates reach the scan."""
    return X.table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'2000-01-01' and l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_quantity")


@R.add("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events", fixtures=False)
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    parts = [X.table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("orders", "lineitem", "events")]
    return parts[0].union(parts[1]).union(parts[2])


@R.add("""
SELECT o_orderkey, TRY_CAST(regexp_replace(o_orderpriority, '-.*', '') AS DOUBLE) AS level, CAST(TRY_CAST(regexp_replace(o_orderpriority, '-.*', '') AS DOUBLE) AS BIGINT) AS whole, TRY_CAST(o_orderstatus AS DOUBLE) AS none FROM orders
""", fixtures=False)
def tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2, T5."""
    head = F.regexp_replace("o_orderpriority", "-.*", "")
    return X.table(spark, sf_dir, "orders").select("o_orderkey", S.number(head).alias("level"), S.whole_number(head).alias("whole"), S.number(F.col("o_orderstatus")).alias("none"))


@R.add("""
e AS (SELECT event_id, CASE k % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '1.0' WHEN 3 THEN 'x' END AS e FROM ev)
SELECT event_id, coalesce(TRY_CAST(e AS DOUBLE), 0) = 0 AS zero_rule, coalesce(e, '0') <> '1' AS one_rule FROM e
""")
def error_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules for the error flag."""
    m = F.col("k") % 5
    e = X.events(spark, sf_dir).withColumn("e", F.when(m == 0, "0").when(m == 1, "1").when(m == 2, "1.0").when(m == 3, "x"))
    return e.select("event_id", S.error_is_zero(F.col("e")).alias("zero_rule"), S.error_not_one(F.col("e")).alias("one_rule"))


@R.add("""
SELECT event_id, event_type, value FROM ev WHERE NOT regexp_matches(lower(CASE WHEN k % 3 = 0 THEN 'Rewritten order' WHEN k % 3 = 1 THEN 'done' ELSE '' END), 'rewritten|cancelled') AND trim(event_type) IN ('view', 'click')
""")
def status_and_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6, B9, B11."""
    m = F.col("k") % 3
    e = X.events(spark, sf_dir).withColumn("status", F.when(m == 0, "Rewritten order").when(m == 1, "done"))
    return e.where(S.not_cancelled(F.col("status")) & S.not_blank(F.col("event_type")) & S.strip(F.col("event_type")).isin("view", "click")).select("event_id", "event_type", "value")


@R.add("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", fixtures=False)
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7."""
    poor = X.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return X.table(spark, sf_dir, "orders").join(poor, "o_custkey", "left_semi").select("o_orderkey")


@R.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", fixtures=False)
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8."""
    return X.table(spark, sf_dir, "customer").join(X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@R.add("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(upper(p), 'UNKNOWN') AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderstatus) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey", fixtures=False)
def left_join_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, B12, C5."""
    c = X.table(spark, sf_dir, "customer").select("c_custkey")
    per = X.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.min("o_orderstatus").alias("p"))
    return J.checked_join(c, per, ["c_custkey"]).select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.upper("p"), F.lit("UNKNOWN")).alias("status"))


@R.add("SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", fixtures=False)
def inner_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C6."""
    o, c, n = (X.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_mktsegment", "n_name")


@R.add("""
SELECT coalesce(a.k, b.k, c.k) AS k, a.n AS n_orders, b.n AS n_suppliers, c.n AS n_customers FROM (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 15 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON coalesce(a.k, b.k) = c.k
""", fixtures=False)
def full_outer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3."""
    c = X.table(spark, sf_dir, "customer")
    a = X.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_orders"))
    b = X.table(spark, sf_dir, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    d = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    return a.join(b, "k", "full").join(d, "k", "full")


@R.add("""
a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_either,
  (SELECT count(*) FROM a JOIN b USING (k)) / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b))::DOUBLE AS jaccard
""")
def id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16."""
    li = X.table(spark, sf_dir, "lineitem")
    return J.overlap(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "l_orderkey")


@R.add("SELECT count(*) FILTER (o_custkey IS NULL) AS n_missing, 0::BIGINT AS n_extra FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey", fixtures=False)
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18."""
    return J.set_differences(X.table(spark, sf_dir, "customer"), X.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@R.add("SELECT 'p_size' AS column_name, count(*) FILTER (p_partkey % 10 = 0) AS n_changed FROM part UNION ALL SELECT 'p_retailprice', count(*) FILTER (p_partkey % 7 = 0) FROM part UNION ALL SELECT 'p_brand', 0 FROM part GROUP BY 1", fixtures=False)
def reconstruction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20."""
    p = X.table(spark, sf_dir, "part")
    changed = p.withColumn("p_size", F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_retailprice", F.col("p_retailprice") + F.when(F.col("p_partkey") % 7 == 0, 0.01).otherwise(1e-11))
    return J.changed_columns(p, changed, "p_partkey", ["p_size", "p_retailprice", "p_brand"])


@R.add("SELECT event_type, CASE WHEN value >= 100 THEN NULL ELSE CAST(floor(value / 10) AS BIGINT) END AS bin, count(*) AS n FROM ev GROUP BY 1, 2")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null is a value of its own."""
    e = X.events(spark, sf_dir).withColumn("bin", F.when(F.col("value") < 100, S.floor_bin(F.col("value"), 10)))
    return A.histogram(e, ["event_type", "bin"])


@R.add("""
c AS (SELECT CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM ev GROUP BY 1)
SELECT CASE WHEN n < 5 THEN '(suppressed)' ELSE CAST(bin AS VARCHAR) END AS bin, sum(n)::BIGINT AS n FROM c GROUP BY 1
""")
def small_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5."""
    counts = A.histogram(X.events(spark, sf_dir).withColumn("bin", S.floor_bin(F.col("value"), 5)), ["bin"])
    return A.small_cells(counts, "bin")


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, round(sum(l_quantity), 6) AS sum_quantity, round(avg(l_extendedprice), 4) AS mean_price, round(100 * avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS percent_discounted FROM lineitem GROUP BY 1, 2", fixtures=False)
def named_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2, D6, D10, D12."""
    li = X.table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"), r6(F.sum("l_quantity"), "sum_quantity"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), r6(A.percent_where(F.col("l_discount") >= 0.05), "percent_discounted"),
    )


@R.add("SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS first_ship, strftime(min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END), '%Y-%m-%d') AS first_return, max(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS large FROM lineitem GROUP BY 1", fixtures=False)
def one_pass_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13, D14, D16."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(day(F.min("l_shipdate")).alias("first_ship"), day(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))).alias("first_return"), F.max(F.when(F.col("l_quantity") > 40, 1).otherwise(0)).alias("large"))


@R.add("""
w AS (SELECT user_id AS s, user_id % 2 AS label, avg(CASE WHEN event_type = 'view' THEN value END) AS a, avg(CASE WHEN value > 200 THEN value END) AS b FROM events GROUP BY 1)
SELECT 'a' AS feature, avg((a IS NULL)::INT) AS missing_all, avg(CASE WHEN label = 1 THEN (a IS NULL)::INT END) AS missing_cases, avg(CASE WHEN label = 0 THEN (a IS NULL)::INT END) AS missing_controls FROM w
UNION ALL SELECT 'b', avg((b IS NULL)::INT), avg(CASE WHEN label = 1 THEN (b IS NULL)::INT END), avg(CASE WHEN label = 0 THEN (b IS NULL)::INT END) FROM w
""")
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D18, D19."""
    w = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("s")).agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.avg(F.when(F.col("value") > 200, F.col("value"))).alias("b"))
    return A.missingness(w.withColumn("label", F.col("s") % 2), ["a", "b"], "label")


@R.add("SELECT 'n_orders' AS name, 1::BIGINT AS expected, count(*) AS observed FROM orders UNION ALL SELECT 'n_nations', 24, count(*) FROM nation", fixtures=False)
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the counts that differ."""
    seen = X.table(spark, sf_dir, "orders").agg(F.count("*").alias("n_orders")).crossJoin(X.table(spark, sf_dir, "nation").agg(F.count("*").alias("n_nations"))).crossJoin(X.table(spark, sf_dir, "region").agg(F.count("*").alias("n_regions")))
    return A.contract(seen, {"n_orders": 1, "n_nations": 24, "n_regions": 5})


@R.add("SELECT l_orderkey, count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1", fixtures=False)
def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D31."""
    return A.inconsistent(X.table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


@R.add("""
x AS (SELECT user_id AS s, unnest(['event_type', 'value', 'props']) AS field, unnest([event_type, CAST(value AS VARCHAR), props]) AS v FROM events),
y AS (SELECT * FROM x WHERE coalesce(trim(v), '') <> ''), c AS (SELECT field, v, count(*) AS n FROM y GROUP BY 1, 2), d AS (SELECT field, count(*) AS n_values FROM c GROUP BY 1)
SELECT field, count(*) AS n_rows, count(DISTINCT s) AS n_entities, avg((TRY_CAST(v AS DOUBLE) IS NOT NULL)::INT) AS numeric_share, any_value(n_values) AS n_values FROM y JOIN d USING (field) GROUP BY 1
""")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D34."""
    return A.field_profile(X.table(spark, sf_dir, "events"), "user_id", ["event_type", "value", "props"]).drop("n_common_values")


@R.add("""
x AS (SELECT unnest(['event_type', 'supported', 'props']) AS field, trim(unnest([event_type, CASE WHEN event_type IN ('error', 'purchase') THEN 'yes' END, props])) AS v, event_type IN ('error', 'purchase') AS s FROM events),
c AS (SELECT field, v, count(*) AS n, count(*) FILTER (s) AS k FROM x WHERE v <> '' GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT field, rank::INT AS rank, v AS value, n, CASE WHEN field <> 'supported' THEN k END AS n_support FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, v) AS rank FROM c) WHERE rank <= 30
""")
def top_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent values of each field, and how often a support field is filled beside them."""
    e = X.table(spark, sf_dir, "events").withColumn("supported", F.when(F.col("event_type").isin("error", "purchase"), F.lit("yes")))
    return A.top_values(e, ["event_type", "props", "supported"], ["supported"])


@R.add("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1", fixtures=False)
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By (time, tie), without a sort."""
    return E.latest(X.table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@R.add("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rn FROM orders) WHERE rn <= 3", fixtures=False)
def head_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return X.table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@R.add("SELECT event_type, sha256(string_agg(r, chr(10) ORDER BY r)) AS sha256 FROM (SELECT event_type, event_id || '|' || user_id AS r FROM events) GROUP BY 1", fixtures=False)
def identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E17, F17."""
    return E.rows_hash(X.table(spark, sf_dir, "events"), ["event_id", "user_id"], keys=["event_type"])


@R.add("""
SELECT c_custkey, 'case_' || substr(sha256('v1|' || c_custkey || '|' || c_name), 1, 20) AS case_id, CAST(('0x' || substr(sha256('split|' || c_custkey), 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.7 AS train FROM customer
""", fixtures=False)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, F18, G12."""
    u = S.unit_interval(F.lit("split"), F.col("c_custkey"))
    return X.table(spark, sf_dir, "customer").select("c_custkey", S.stable_id("case_", F.lit("v1"), F.col("c_custkey"), F.col("c_name")).alias("case_id"), (S.split_name(u) == "train").alias("train"))


@R.add("SELECT doc_id, regexp_matches(text, '(?i)(?:token)|(?:password)|(?:secret)') AS hit, regexp_matches(text, '(?i)(?:token)') AS strict FROM documents", fixtures=False)
def language_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F4."""
    return X.table(spark, sf_dir, "documents").select("doc_id", T.mentions(F.col("text"), WORDS).alias("hit"), T.mentions(F.col("text"), WORDS[:1]).alias("strict"))


@R.add("SELECT doc_id, len(regexp_extract_all(text, '[0-9]{6,}')) AS n_matches, sha256(regexp_replace(text, '[0-9]{6,}', ' ', 'g')) AS sha256 FROM documents", fixtures=False)
def strip_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    out, n = T.stripped(F.col("text"), ["[0-9]{6,}"])
    return X.table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_matches"), F.sha2(out, 256).alias("sha256"))


@R.add("SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)token|password') THEN 'secret' END, CASE WHEN regexp_matches(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '[|]') THEN 'table' END], lambda x: x IS NOT NULL), ',') AS hits FROM documents", fixtures=False)
def group_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    hits = T.groups_hit(F.col("text"), {"secret": ["token", "password"], "mail": ["@"], "table": ["[|]"]})
    return X.table(spark, sf_dir, "documents").select("doc_id", F.array_join(hits, ",").alias("hits"))


@R.add("SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS name, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, length(p_name)::INT AS n_chars FROM part", fixtures=False)
def text_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F10."""
    return X.table(spark, sf_dir, "part").select("p_partkey", T.normal(F.col("p_name")).alias("name"), T.slug(F.col("p_type")).alias("slug"), F.length("p_name").alias("n_chars"))


@R.add("SELECT turn, role, contains(lower(coalesce(text, '')), 'the')::INT AS has_the, contains(lower(coalesce(text, '')), 'ing ')::INT AS has_ing, conv_id FROM conversations", fixtures=False)
def phrase_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    m = T.phrase_labels(F.col("text"), {"the": ["the"], "ing": ["ing "]})
    return X.table(spark, sf_dir, "conversations").select("turn", "role", m["the"].alias("has_the"), m["ing"].alias("has_ing"), "conv_id")


@R.add("""
p AS (SELECT event_id, CASE k % 3 WHEN 0 THEN '{"noul": 0.25}' WHEN 1 THEN '{"p": {"yes": 0.75}}' ELSE '{"noul": 7}' END AS j FROM ev)
SELECT event_id, coalesce(CASE WHEN TRY_CAST(json_extract_string(j, '$.noul') AS DOUBLE) BETWEEN 0 AND 1 THEN TRY_CAST(json_extract_string(j, '$.noul') AS DOUBLE) END, TRY_CAST(json_extract_string(j, '$.p.yes') AS DOUBLE)) AS probability FROM p
""")
def json_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    m = F.col("k") % 3
    e = X.events(spark, sf_dir).withColumn("j", F.when(m == 0, '{"noul": 0.25}').when(m == 1, '{"p": {"yes": 0.75}}').otherwise('{"noul": 7}'))
    return e.select("event_id", T.probability(F.col("j"), ["$.noul", "$.p.yes"]).alias("probability"))


@R.add("SELECT event_id, round((k % 10) / 10.0, 6)::DOUBLE AS a, 0.5::DOUBLE AS b FROM ev")
def last_valid_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last of several candidates that has every key; the SQL states its scores."""
    e = X.events(spark, sf_dir).withColumn("t", F.format_string('thinking {"a": 2} then {"a": 0.%d, "b": 0.5} and {"a": "x"}', F.col("k") % 10))
    s = T.last_scores(F.col("t"), ["a", "b"])
    return e.select("event_id", s["a"].alias("a"), s["b"].alias("b"))


@R.add("""
w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 ELSE least(8, greatest(1, CAST(ceil((len(w) - 20) / 200.0) AS BIGINT))) END AS c FROM w)
SELECT doc_id, c AS n_chunks, n > 220 + 7 * 200 AS truncated, CASE WHEN c > 0 THEN least(220, n - (c - 1) * 200) END AS last_size FROM n
""")
def chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    d = X.table(spark, sf_dir, "documents").withColumn("w", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    d = d.withColumn("c", T.chunks(F.col("w"), 220, 20, 8))
    return d.select("doc_id", F.size("c").cast("long").alias("n_chunks"), T.truncated(F.col("w"), 220, 20, 8).alias("truncated"), F.when(F.size("c") > 0, F.size(F.element_at("c", -1))).cast("long").alias("last_size"))


@R.add("""
c AS (SELECT stay_id, list(value ORDER BY value DESC) AS v FROM ev GROUP BY 1)
SELECT stay_id, v[1] AS max, v[-1] AS min, round(list_avg(v), 6) AS mean, round(list_avg(v[1:2]), 6) AS top2 FROM c
""")
def chunk_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15."""
    c = X.events(spark, sf_dir).groupBy("stay_id").agg(F.collect_list("value").alias("v"))
    return c.select("stay_id", T.pooled(F.col("v"), "max").alias("max"), T.pooled(F.col("v"), "min").alias("min"), r6(T.pooled(F.col("v"), "mean"), "mean"), r6(T.pooled(F.col("v"), "top2"), "top2"))


@R.add()
def question_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: greedy packs; tested against a loop."""
    d = X.table(spark, sf_dir, "benchmark").withColumn("lengths", F.transform(F.split("text", " "), lambda w: F.length(w)))
    return d.select("item_id", F.to_json(T.packs(F.col("lengths"), 10, 30, 4)).alias("packs"))


@R.add("SELECT 'note_' || substr(sha256(text), 1, 24) AS note_id, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT source)), ',') AS members FROM documents GROUP BY text", fixtures=False)
def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    got = T.distinct_texts(X.table(spark, sf_dir, "documents"), "text", "source")
    return got.select("note_id", "n_rows", F.array_join("members", ",").alias("members"))


@R.add("SELECT c_custkey, CASE WHEN regexp_matches(c_mktsegment, '(?i)auto') THEN 'vehicle' WHEN regexp_matches(c_mktsegment, '(?i)mach') THEN 'machine' WHEN regexp_matches(c_mktsegment, '(?i)hold') THEN 'home' END AS kind, (c_mktsegment = 'HOUSEHOLD')::INT::DOUBLE AS is_home FROM customer", fixtures=False)
def first_match_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B27."""
    rules = [("vehicle", "auto"), ("machine", "mach"), ("home", "hold")]
    return X.table(spark, sf_dir, "customer").select("c_custkey", S.first_match(F.col("c_mktsegment"), rules).alias("kind"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", 1.0).otherwise(0.0).alias("is_home"))


@R.add("""
SELECT note_id, CASE WHEN starts_with(lower(trim(category)), 'nursing') THEN 'nursing' WHEN starts_with(lower(trim(category)), 'physician') THEN 'physician' WHEN starts_with(lower(trim(category)), 'resp') THEN 'respiratory' ELSE 'other' END AS note_group FROM nt
""")
def note_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B22."""
    return X.notes(spark, sf_dir).select("note_id", S.note_group(F.col("category")).alias("note_group"))


@R.add("SELECT p_partkey, coalesce(p_size BETWEEN 10 AND 40 AND coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END, p_size * 10) BETWEEN 100 AND 1000, false) AS qualifies FROM part", fixtures=False)
def composite_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B29."""
    return X.table(spark, sf_dir, "part").select("p_partkey", S.qualifies(F.col("p_size"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")), F.col("p_size") * 10).alias("qualifies"))


QUERIES, ORACLE_SQL = R.queries, R.sql
