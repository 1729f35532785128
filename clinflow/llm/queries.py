"""The operators' registered queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from clinflow.llm import divergence, exact_dedup, lm_scoring, mixing, near_dedup, packing, phrases, quality_classifier, quality_rules, repeats, secrets, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _held(remainder: int) -> Column:
    """Whether the document is in the fold that nothing is learnt from; a document without an id is not."""
    return F.coalesce(_fold() == remainder, F.lit(False))


def tokenizer() -> str:
    """Path of the byte-level BPE file, which every machine has."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learnt from those whose crc32 is not 1 modulo 5. Null text: empty, one token. Null id: learnt from. Repeated rows: one result each. Empty table: empty result. Other columns are ignored."""
    return lm_scoring.score(_table(spark, sf_dir, "documents"), _held(1), tokenizer())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (poor), 1 (sound but toxic), 2 (sound); kept: sound is likelier than not. Null or empty text: the grade of no features. Null id: not held out, and taught by no label. Repeated rows: graded each. Empty table: empty result."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grades = labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    known = docs.select("doc_id", "text").where(~_held(0)).join(grades, "doc_id")
    got = quality_classifier.grade(docs, quality_classifier.learn(known, 3))
    return got.select("doc_id", _held(0).alias("held_out"), "expected_grade", F.col("tails")[0].alias("p_above_0"), F.col("tails")[1].alias("p_above_1"), (F.col("tails")[0] >= 0.5).alias("kept"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document appears when no source is repeated more than twice as often as another. Null text: no token. Null source: a source of its own. Repeated rows: planned each. Empty table: empty result."""
    plan = mixing.plan(_table(spark, sf_dir, "documents"), repetition=2.0, budget="cover")
    return plan.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), "tokens", "weight", "passes", "copies", "block", F.col("part").alias("rank"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document. Null or empty text: a class of its own. Null id: takes part, and its class has the least id there is. Empty table: empty result."""
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after all mail addresses and all runs of nine or more digits are redacted. Null text: empty, no token. Repeated rows: counted each. Empty table: empty result."""
    got = token_counts.count_found(_table(spark, sf_dir, "documents"), {"<mail>": MAIL, "<number>": DIGITS}, tokenizer())
    return got.select("doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_reencoded_chars", F.sha2("text_after", 256).alias("after_sha256"))


#: What the edits of op6 look for. A run of digits and an address cannot overlap: the run has no @ beside it.
#: Local parts are taken whole and from their beginning only, so that a run without @ is read once.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DIGITS = r"(?<![0-9A-Za-z._%+@-])[0-9]{9,}(?![0-9A-Za-z._%+@-])"


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of docs in windows, with a checksum for the ids."""
    got = packing.pack(docs, tokenizer())
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents. Null text: its end token alone. Repeated rows: packed each. Empty table: no piece."""
    return packed(_table(spark, sf_dir, "documents"))


def toxic_lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    """Learnt from the labelled documents outside fold 0."""
    known = docs.select("doc_id", "text").where(~_held(0)).join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    return toxicity.learn(known)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document. Null or empty text: the score of no match. Null id: not held out. Empty table: empty result."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    got = toxicity.score(docs, toxic_lexicon(docs, labels))
    return got.select("doc_id", _held(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document. Null text: none. Repeated rows: one result each. Empty table: empty result."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start_at"], s["end_at"])), ",")
    base = F.filter("found", lambda s: s["kind"] != "random")
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, the largest id stays. Null text: empty. Null id: stays only where its group has no other. Empty table: empty result."""
    return exact_dedup.classes(_table(spark, sf_dir, "documents"), keep="max")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document. Null text: no words, so it fails. Repeated rows: judged each. Empty table: empty result."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each pair of a language's sources, and each source's highest terms. Null text, lang, source: empty strings. Repeated rows: documents of their own. Empty table: empty result."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 highest collocations of each language. Null text: no words. Null lang: `und`. Repeated rows: counted each. Empty table: empty result."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 100 bytes that also start earlier. Null text: empty. Null id: earlier than all others. Repeated rows: the first in a fixed order stays. Empty table: empty result."""
    left = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_mixing": op3_mixing,
    "op4_near_dedup": op4_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scans": op7_secret_scans,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_phrases": op12_phrases,
    "op13_repeats": op13_repeats,
}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))

ORACLE_SQL: dict[str, str] = {
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM d
),
g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c
  FROM (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w))
),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY 1),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda s: lower(s) IN (STOP))) AS n_stop,
         len(regexp_extract_all(t, '\p{Lu}')) AS n_upper, len(l) AS n_lines
  FROM w LEFT JOIN r USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.25 AND n_stop / n_words >= 0.04
         AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AND (word_chars = 0 OR n_upper / word_chars <= 0.5) AS kept
FROM m
""".replace("STOP", _STOP),
    "op9_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY 1),
n AS (
  SELECT g.lang, g.source, coalesce(sum(c.c), 0)::BIGINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
),
p AS (
  SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (n.n + v.v) AS p
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term
),
q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(c.c)::BIGINT + 1)) // (any_value(t.n) + any_value(v.v)) AS q
  FROM c JOIN (SELECT lang, sum(n)::BIGINT AS n FROM n GROUP BY 1) t USING (lang) JOIN v USING (lang) GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM n a JOIN n b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL
),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 200
""",
    "op12_phrases": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS w FROM d),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p WHERE len(w) > 2
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, w FROM c),
s AS (
  SELECT u.lang, u.phrase, u.a, cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.k = cut AND x.phrase = array_to_string(u.w[1:cut], ' ')
  JOIN f y ON y.lang = u.lang AND y.k = len(u.w) - cut AND y.phrase = array_to_string(u.w[cut + 1:], ' ')
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE k = 3
  ) GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase)::INT AS rank
  FROM b LEFT JOIN h USING (lang, phrase) WHERE h.longer IS NULL OR 100 * h.longer < 50 * b.a
) JOIN n USING (lang) WHERE rank <= 2000
""",
}
