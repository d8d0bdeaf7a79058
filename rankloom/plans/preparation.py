"""Queries of the general data-preparation operators: units, gaps and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import hotdeck, nested, units
from rankloom.runtime import table as t


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return units.not_percent(t(s, d, "score_records"), t(s, d, "benchmarks"))


def p2_converted(s: SparkSession, d: str) -> DataFrame:
    return units.to_percent(t(s, d, "score_records"), t(s, d, "benchmarks")).select("record_id", "score", F.round("score_percent", 6).alias("score_percent"), "full_scale", F.round("unit_probability", 6).alias("unit_probability"), "unit_status")


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return hotdeck.gaps_filled(t(s, d, "scores"), t(s, d, "score_records"), t(s, d, "benchmarks"))


def p4_filled(s: SparkSession, d: str) -> DataFrame:
    """Values as text; scores with six decimals."""
    number = F.col("value").cast("double").cast("decimal(20,6)").cast("string")
    return hotdeck.filled_scores(t(s, d, "scores"), t(s, d, "benchmarks")).withColumn("value", F.when(F.col("field_name") == "score", number).otherwise(F.col("value")))


def p4_filled_records(s: SparkSession, d: str) -> DataFrame:
    return hotdeck.filled_records(t(s, d, "score_records"))


def p6_unread(s: SparkSession, d: str) -> DataFrame:
    """Payloads without entries by the reason."""
    return nested.unread(t(s, d, "raw_drops")).groupBy("reason").agg(F.count("*").alias("n"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return nested.entries(t(s, d, "raw_drops"))


def p6_records(s: SparkSession, d: str) -> DataFrame:
    return nested.record_nodes(t(s, d, "score_records"))


def p6_record_tree(s: SparkSession, d: str) -> DataFrame:
    """The nodes of p6_records and those of ``extra``."""
    return nested.record_tree(t(s, d, "score_records"))


def p6_trials_in_records(s: SparkSession, d: str) -> DataFrame:
    tables = nested.tables(t(s, d, "raw_drops"))
    return nested.contained(tables["record"], tables["trial"])


QUERIES = {f.__name__: f for f in (p2_found, p2_converted, p4_found, p4_filled, p4_filled_records, p6_found, p6_records, p6_record_tree, p6_trials_in_records, p6_unread)}

_BLANK = "('', '-', '--', '?', '.', 'n/a', 'na', 'none', 'null', 'nil', 'nan', 'tbd', 'unknown', 'undefined')"

# the nearest usable value before or after in the order of the group: {0} the rows, {1} the group, {2} the order, {3} the donor's name
_DECK = """
placed AS (
  SELECT *, row_number() OVER w AS place, CASE WHEN value IS NOT NULL THEN {{'v': value, 'd': {3}, 'place': row_number() OVER w}} END AS here FROM {0} WINDOW w AS (PARTITION BY {1} ORDER BY {2})
), near AS (
  SELECT *, last_value(here IGNORE NULLS) OVER (PARTITION BY {1} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
    first_value(here IGNORE NULLS) OVER (PARTITION BY {1} ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM placed
), donor AS (
  SELECT *, CASE WHEN p IS NOT NULL AND (q IS NULL OR place - p.place <= q.place - place) THEN p ELSE q END AS x FROM near
)
"""

SQL = {
    "p4_filled": f"""
WITH good AS (
  SELECT run_id, benchmark, model, loaded_at, CASE WHEN NOT isnan(score) AND CASE WHEN b.scale = 'rating' THEN score > 0 AND score < 3000 ELSE score >= 0 AND score <= 1 END THEN score END AS score,
    CASE WHEN lower(trim(metric)) NOT IN {_BLANK} THEN metric END AS metric FROM scores s LEFT JOIN benchmarks b ON b.id = s.benchmark
), cells AS (
  SELECT run_id, benchmark, model, arg_max(score, [epoch_us(loaded_at)::DOUBLE, score]) FILTER (score IS NOT NULL) AS score,
    regexp_replace(lower(trim(arg_max(metric, [epoch_us(loaded_at)::VARCHAR, metric]) FILTER (metric IS NOT NULL))), '\\s+', '_', 'g') AS metric FROM good GROUP BY ALL
), axes AS (
  SELECT run_id, benchmark, model FROM (SELECT DISTINCT run_id, benchmark FROM scores) JOIN (SELECT DISTINCT run_id, model FROM scores) USING (run_id)
), deck AS (
  SELECT run_id, benchmark, model, 'score' AS field_name, score::DECIMAL(20,6)::VARCHAR AS value FROM axes LEFT JOIN cells USING (run_id, benchmark, model)
  UNION ALL SELECT run_id, benchmark, model, 'metric', metric FROM cells
), {_DECK.format("deck", "run_id, benchmark, field_name", "model", "model")}
SELECT run_id, benchmark, model, field_name, coalesce(value, x.v) AS value, value IS NULL AND x IS NOT NULL AS filled,
  CASE WHEN value IS NULL THEN x.d END AS donor, CASE WHEN value IS NULL THEN abs(place - x.place) END AS distance FROM donor
""",
    "p4_filled_records": f"""
WITH deck AS (
  SELECT record_id, run_id, benchmark_id, model_id, coalesce(lower(model_id), '') AS m, CASE WHEN score >= 0 AND NOT isnan(score) THEN score END AS value FROM score_records
), {_DECK.format("deck", "run_id, benchmark_id", "m, record_id", "m || '|' || record_id")}, told AS (
  SELECT *, value IS NULL AND x IS NOT NULL AND run_id IS NOT NULL AND benchmark_id IS NOT NULL AS filled FROM donor
)
SELECT record_id, run_id, benchmark_id, model_id, coalesce(value, CASE WHEN filled THEN x.v END) AS value, filled, CASE WHEN filled THEN x.d END AS donor, CASE WHEN filled THEN abs(place - x.place) END AS distance FROM told
""",
    "p4_found": f"""
WITH ok AS (
  SELECT s.*, CASE WHEN b.scale = 'rating' THEN score > 0 AND score < 3000 ELSE score >= 0 AND score <= 1 END AND NOT isnan(score) AS good, lower(trim(metric)) NOT IN {_BLANK} AS named
  FROM scores s LEFT JOIN benchmarks b ON b.id = s.benchmark
), cells AS (
  SELECT run_id, benchmark, model, coalesce(bool_or(good), false) AS good, coalesce(bool_or(named), false) AS named FROM ok GROUP BY ALL
), axes AS (
  SELECT run_id, benchmark, model FROM (SELECT DISTINCT run_id, benchmark FROM scores) JOIN (SELECT DISTINCT run_id, model FROM scores) USING (run_id)
), whole AS (
  SELECT a.*, coalesce(c.good, false) AS good, c.named FROM axes a LEFT JOIN cells c USING (run_id, benchmark, model)
), rec AS (
  SELECT record_id, run_id, benchmark_id, coalesce(score >= 0 AND NOT isnan(score), false) AS good FROM score_records WHERE run_id IS NOT NULL AND benchmark_id IS NOT NULL
)
SELECT 'scores' AS origin, run_id || '|' || benchmark || '|' || model AS row_key, 'score' AS field_name
FROM (SELECT *, bool_or(good) OVER (PARTITION BY run_id, benchmark) AS any_good FROM whole) WHERE NOT good AND any_good
UNION ALL
SELECT 'scores', run_id || '|' || benchmark || '|' || model, 'metric'
FROM (SELECT *, bool_or(named) OVER (PARTITION BY run_id, benchmark) AS any_named FROM whole) WHERE NOT named AND any_named
UNION ALL
SELECT 'score_records', record_id::VARCHAR, 'score'
FROM (SELECT *, bool_or(good) OVER (PARTITION BY run_id, benchmark_id) AS any_good FROM rec) WHERE NOT good AND any_good
""",
    "p6_records": """
WITH v AS (
  SELECT record_id, unnest(variants) AS v, generate_subscripts(variants, 1) - 1 AS i FROM score_records
)
SELECT record_id, 'record' AS type, 'r' AS path, '' AS parent_path, 1::BIGINT AS pre, (5 + 4 * coalesce(len(variants), 0))::BIGINT AS post, score, config, NULL::VARCHAR AS kind, NULL::VARCHAR AS url, NULL::VARCHAR AS ref, NULL::VARCHAR AS reported_by, NULL::VARCHAR AS published, NULL::VARCHAR AS fetched_at FROM score_records
UNION ALL SELECT record_id, 'source', 'r/o', 'r', 2, 3, NULL, NULL, source.kind, source.url, source.ref, source.reported_by, source.published, source.fetched_at FROM score_records WHERE source IS NOT NULL
UNION ALL SELECT record_id, 'variant', 'r/v' || i, 'r', 4 + 4 * i, 7 + 4 * i, v.score, v.config, NULL, NULL, NULL, NULL, NULL, NULL FROM v WHERE v IS NOT NULL
UNION ALL SELECT record_id, 'source', 'r/v' || i || '/o', 'r/v' || i, 5 + 4 * i, 6 + 4 * i, NULL, NULL, v.source.kind, v.source.url, v.source.ref, v.source.reported_by, v.source.published, v.source.fetched_at FROM v WHERE v.source IS NOT NULL
""",
}
