"""Queries that score detections against gold spans, over span tables derived from `customer`.

Gold: three spans of a document at places that the key gives. Predictions: some exact, some partial, some of a related type, some
wrong. The SQL works on the same rows in its own way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import metrics, policy, restore, sanitize
from spanloom.operators.detect import detect
from spanloom.operators.kernel import resolved
from spanloom.plans.notes import CARD, CHECK, digits, number
from spanloom.sources.scratch import materialize
from spanloom.sources.tables import table

GOLD = """
  select c_custkey as doc_id, 0 as `start`, 11 as `end`, 'PERSON' as entity_type, 'Anna Keller' as value from {c}
  union all select c_custkey, 20, 32, 'DOB', '1990-03-14 x' from {c} where c_custkey % 2 = 0
  union all select c_custkey, 40, 48, 'CASE_ID', '12345678' from {c} where c_custkey % 3 = 0
"""
PREDICTED = """
  select c_custkey as doc_id, case c_custkey % 4 when 0 then 0 when 1 then 5 else 0 end as `start`, case c_custkey % 4 when 2 then 4 else 11 end as `end`, 'PERSON' as entity_type from {c} where c_custkey % 5 != 4
  union all select c_custkey, 20, 30, 'DATE' from {c} where c_custkey % 7 != 0
  union all select c_custkey, 44, 60, case c_custkey % 2 when 0 then 'ACCOUNT_ID' else 'PHONE' end from {c} where c_custkey % 4 != 3
"""


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    return spark.sql(GOLD, c=c), spark.sql(PREDICTED, c=c)


def _sql(text: str) -> str:
    return text.replace("{c}", "customer").replace("`", '"')


BOTH = f'WITH g AS ({_sql(GOLD)}), p AS ({_sql(PREDICTED)}), t AS (SELECT g.*, EXISTS (SELECT 1 FROM p WHERE p.doc_id = g.doc_id AND p."start" < g."end" AND g."start" < p."end") AS hit FROM g)'


def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overlap_recall(*_spans(spark, sf_dir), by="entity_type")


RECALL_SQL = f"{BOTH} SELECT entity_type, count(*) AS n_gold, count(*) FILTER (hit) AS n_covered, round(count(*) FILTER (hit) / count(*), 6) AS recall FROM t GROUP BY GROUPING SETS ((entity_type), ())"


def eval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overlap_precision(*_spans(spark, sf_dir))


PRECISION_SQL = f"""
{BOTH}, r AS (SELECT EXISTS (SELECT 1 FROM g WHERE p.doc_id = g.doc_id AND p."start" < g."end" AND g."start" < p."end") AS ok FROM p)
SELECT count(*) AS n_predicted, count(*) FILTER (ok) AS n_right, round(count(*) FILTER (ok) / count(*), 6) AS precision FROM r
"""


def eval_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.typed_scores(*_spans(spark, sf_dir)).withColumns({"n_found": F.col("n_found").cast("long"), "n_typed": F.col("n_typed").cast("long")})


FAMILY = "CASE {} WHEN 'DOB' THEN 'DATE' WHEN 'PATIENT_ID' THEN 'GOV_ID' WHEN 'CASE_ID' THEN 'GOV_ID' WHEN 'ACCOUNT_ID' THEN 'GOV_ID' ELSE {} END"
TYPED_SQL = f"""
{BOTH}, e AS (SELECT t.*, EXISTS (SELECT 1 FROM p WHERE p.doc_id = t.doc_id AND p."start" < t."end" AND t."start" < p."end" AND {FAMILY.format('p.entity_type', 'p.entity_type')} = {FAMILY.format('t.entity_type', 't.entity_type')}) AS typed FROM t)
SELECT entity_type, count(*) AS n_gold, count(*) FILTER (hit) AS n_found, count(*) FILTER (typed) AS n_typed, round(count(*) FILTER (hit) / count(*), 6) AS recall,
  round(count(*) FILTER (typed) / count(*) FILTER (hit), 6) AS type_accuracy FROM e GROUP BY entity_type
"""


def eval_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.leakage(*_spans(spark, sf_dir))


# Every place of a gold value that holds a letter or digit, and whether a prediction covers it; words by counting blanks before.
LEAKAGE_SQL = f"""
{BOTH}, k AS (SELECT doc_id, "start", "end", value, unnest(range(1, length(value) + 1)) AS i FROM g),
c AS (SELECT *, substr(value, i, 1) AS ch, length(substr(value, 1, i)) - length(replace(substr(value, 1, i), ' ', '')) AS word FROM k),
o AS (SELECT c.*, EXISTS (SELECT 1 FROM p WHERE p.doc_id = c.doc_id AND p."start" < c."start" + i AND c."start" + i <= p."end") AS covered FROM c WHERE regexp_matches(ch, '[\\p{{L}}\\p{{N}}]')),
w AS (SELECT doc_id, "start", word, bool_and(covered) AS safe FROM o GROUP BY ALL),
s AS (SELECT doc_id, "start", count(*) AS n, count(*) FILTER (NOT safe) AS l FROM w GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(l) AS BIGINT) AS n_leaked, count(*) AS n_spans, count(*) FILTER (l = 0) AS n_full, round(sum(l) / sum(n), 6) AS leak_rate,
  round(count(*) FILTER (l = 0) / count(*), 6) AS full_recall FROM s
"""


def eval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint covered ranges of the predictions shifted so that some touch and some overlap."""
    _, p = _spans(spark, sf_dir)
    shifted = p.withColumns({"start": F.col("start") % 25, "end": F.col("start") % 25 + F.col("end") - F.col("start")})
    made = metrics.coverage(shifted).selectExpr("doc_id", "inline(covered)")
    return made.selectExpr("doc_id", "cast(start as bigint) as span_start", "cast(`end` as bigint) as span_end")


COVERAGE_SQL = f"""
{BOTH}, q AS (SELECT doc_id, "start" % 25 AS s, "start" % 25 + "end" - "start" AS e FROM p),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT doc_id, CAST(min(s) AS BIGINT) AS span_start, CAST(max(e) AS BIGINT) AS span_end FROM r GROUP BY doc_id, run
"""

# Detection on notes with several values of known places: recall, precision and leakage of the real detectors.

PARTS = (
    ("EMAIL", "Mail ", f"'user' || {number('c_custkey')} || '@mail.example.org'"),
    ("CREDIT_CARD", ", card ", f"{CARD} || {number(CHECK)}"),
    ("GOV_ID", ", ssn ", f"{digits('c_custkey', 3)} || '-12-' || {digits('c_custkey', 4)}"),
    ("MAC", ", mac ", f"'4e:b8:7f:00:11:' || {digits('c_custkey', 2)}"),
    ("ADDRESS", ", lives at ", f"{number('c_custkey % 900 + 1')} || ' Baker Street'"),
    ("DATE", ", born ", f"'14 March ' || {number('1950 + c_custkey % 50')}"),
)
NOTE = " || ".join(f"'{before}' || {value}" for _, before, value in PARTS) + " || ' end'"


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", f"{NOTE} as text", *[f"{value} as v{k}" for k, (_, _, value) in enumerate(PARTS)])
    spans, at = [], F.lit(0)
    for k, (kind, before, _) in enumerate(PARTS):
        at = at + len(before)
        spans.append(F.struct(at.alias("start"), (at + F.length(f"v{k}")).alias("end"), F.lit(kind).alias("entity_type"), F.col(f"v{k}").alias("value")))
        at = at + F.length(f"v{k}")
    return rows.select("doc_id", "text"), rows.select("doc_id", F.inline(F.array(*spans)))


def notes_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, gold = _gold(spark, sf_dir)
    found = materialize(resolved(detect(docs)).selectExpr("doc_id", "inline(resolved)"))
    return metrics.typed_scores(gold, found).withColumns({"n_found": F.col("n_found").cast("long"), "n_typed": F.col("n_typed").cast("long")})


NOTES_SQL = f"""
SELECT entity_type, count(*) AS n_gold, count(*) AS n_found, count(*) AS n_typed, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS type_accuracy
FROM customer, (VALUES {", ".join(f"('{k}')" for k, _, _ in PARTS)}) AS v(entity_type) GROUP BY entity_type
"""


def strong_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong identifiers that an edit doesn't wholly cover, by type: none, so the count of gold spans is what is left."""
    docs, gold = _gold(spark, sf_dir)
    made = materialize(sanitize.sanitize(docs, policy.get_policy("maximum"), run_leak_scan=False))
    edits = made.selectExpr("doc_id", "inline(edits)").select("doc_id", "start", "end")
    each = metrics.leaked_words(gold.where("entity_type != 'DATE'"), edits)
    return each.agg(F.count("*").alias("n_spans"), F.count_if(F.col("n_leaked") > 0).alias("n_leaking"))


STRONG_SQL = "SELECT CAST(5 * count(*) AS BIGINT) AS n_spans, CAST(0 AS BIGINT) AS n_leaking FROM customer"


def benchmark_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, gold = _gold(spark, sf_dir)
    made = materialize(sanitize.sanitize(docs, policy.get_policy("maximum")))
    back = restore.restore(made.select("doc_id", F.col("sanitized").alias("response")), sanitize.vault_of(made))
    fixtures = docs.join(gold.groupBy("doc_id").agg(F.collect_list("value").alias("must_remove")), "doc_id")
    return metrics.fixture_benchmark(made, fixtures, back)


BENCHMARK_SQL = "SELECT 6 * count(*) AS n_secrets, 6 * count(*) AS n_removed, count(*) AS n_docs, count(*) AS n_exact, CAST(0 AS BIGINT) AS n_blocked, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS round_trip FROM customer"

REPORT_VALUES = "case c_nationkey % 3 when 0 then 'Ann' when 1 then 'Bob' else cast(c_custkey % 20 as string) end"


def wild_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_mktsegment as category", "case when c_custkey % 2 = 0 then 'PERSON' else 'ORGANIZATION' end as entity_type", f"{REPORT_VALUES} as value")
    return metrics.wild_report(rows, "category").withColumn("place", F.col("place").cast("long"))


WILD_SQL = f"""
WITH r AS (SELECT c_mktsegment AS category, CASE WHEN c_custkey % 2 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END AS entity_type, {REPORT_VALUES} AS value FROM customer),
c AS (SELECT category, entity_type, value, count(*) AS n FROM r GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY category, entity_type ORDER BY n DESC, value) AS place FROM c QUALIFY place <= 6
"""

QUERIES = {
    "eval_overlap_recall": eval_recall,
    "eval_precision": eval_precision,
    "eval_by_type": eval_by_type,
    "eval_leakage": eval_leakage,
    "eval_coverage": eval_coverage,
    "notes_scored": notes_scored,
    "strong_identifier_gate": strong_leaks,
    "benchmark_fixtures": benchmark_fixtures,
    "wild_report_topk": wild_report,
}

ORACLES = {
    "eval_overlap_recall": RECALL_SQL,
    "eval_precision": PRECISION_SQL,
    "eval_by_type": TYPED_SQL,
    "eval_leakage": LEAKAGE_SQL,
    "eval_coverage": COVERAGE_SQL,
    "notes_scored": NOTES_SQL,
    "strong_identifier_gate": STRONG_SQL,
    "benchmark_fixtures": BENCHMARK_SQL,
    "wild_report_topk": WILD_SQL,
}
