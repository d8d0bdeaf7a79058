"""Queries of the training-data operators, by name, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import canon, components, fusion, mixing, packing, spam
from rankloom.runtime import table as t

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return fusion.representatives(t(s, d, "score_records"), t(s, d, "source_kinds")).select("run_id", "model_id", "benchmark_id", "field_name", "record_id", "entry_no")


def p1_fused(s: SparkSession, d: str) -> DataFrame:
    return fusion.representatives(t(s, d, "score_records"), t(s, d, "source_kinds"), "votes").withColumn("posterior", F.round("posterior", 6))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return components.related_groups(t(s, d, "bench_split"), t(s, d, "model_split"))


def p3_split(s: SparkSession, d: str) -> DataFrame:
    return components.assigned(t(s, d, "bench_split"), t(s, d, "model_split"), t(s, d, "split_ratios"))


def p3_shares(s: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of the buckets, over all entries and over the runs."""
    out = components.split_shares(p3_split(s, d), t(s, d, "split_ratios"))
    return out.select("unit_kind", "bucket", "ratio", "entries", *[F.round(c, 6).alias(c) for c in ("actual", "least_run", "most_run")])


def p3_rules(s: SparkSession, d: str) -> DataFrame:
    """How many entries each kind has, and how many went without a bucket or into another one than their component."""
    c = p3_split(s, d)
    by = c.groupBy("unit_kind", "component").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("assigned_bucket", F.lit(""))).alias("k"))
    return by.groupBy("unit_kind").agg(F.sum("n").alias("entries"), F.count_if(F.col("k") > 1).alias("torn")).join(c.groupBy("unit_kind").agg(F.count_if(F.col("assigned_bucket").isNull()).alias("unplaced")), "unit_kind")


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return canon.mapped(t(s, d, "score_records"), t(s, d, "models"), t(s, d, "benchmarks")).select("record_id", "field_name", "canonical_id")


def p5_unmatched(s: SparkSession, d: str) -> DataFrame:
    """Typed values that fit no entry, with how often they occur."""
    m = canon.mapped(t(s, d, "score_records"), t(s, d, "models"), t(s, d, "benchmarks"))
    return m.where("canonical_id = ''").groupBy("field_name", "typed").agg(F.count("*").alias("n"))


def p5_candidates(s: SparkSession, d: str) -> DataFrame:
    return canon.candidates(t(s, d, "score_records"), t(s, d, "models"), t(s, d, "benchmarks"))


def p7_pack(s: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(t(s, d, "documents"), t(s, d, "pack_sizes"))


def p7_fill(s: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_pack(s, d), t(s, d, "pack_sizes"))


def p7_rules(s: SparkSession, d: str) -> DataFrame:
    """Documents placed by each job, containers over their capacity, and documents in pieces though they fit whole."""
    placed, jobs = p7_pack(s, d), t(s, d, "pack_sizes").select("job", "capacity_tokens")
    full = placed.groupBy("job", "container_no").agg(F.sum("n_tokens").alias("used")).join(jobs, "job").groupBy("job").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    docs = placed.groupBy("job", "doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("k")).join(jobs, "job").groupBy("job").agg(F.count("*").alias("docs"), F.count_if((F.col("k") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("torn"))
    return docs.join(full, "job")


def p8_mix(s: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(t(s, d, "documents"), t(s, d, "mix_targets"))


def p8_shares(s: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(s, d), t(s, d, "mix_targets"))


def p8_rules(s: SparkSession, d: str) -> DataFrame:
    """Of each wanted source: whether a document is used more often than allowed, and how many are used that another source is recorded for."""
    other = F.col("source").isNotNull() & (F.trim("source") != "") & (F.col("source") != F.col("domain"))
    mix = p8_mix(s, d).groupBy(F.col("domain").alias("source")).agg(F.max("copies").alias("most"), F.count_if(other).alias("strangers"))
    j = t(s, d, "mix_targets").join(mix, "source", "left")
    return j.select("source", F.coalesce(F.col("most") > F.col("max_repeats"), F.lit(False)).alias("over_cap"), F.coalesce("strangers", F.lit(0)).alias("strangers"))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(t(s, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_fused, p3_found, p3_split, p3_shares, p3_rules, p5_found, p5_candidates, p5_unmatched, p7_pack, p7_fill, p7_rules, p8_mix, p8_shares, p8_rules, p9_found)}


_BLANK = "('', '-', '--', '?', '.', 'n/a', 'na', 'none', 'null', 'nil', 'nan', 'tbd', 'unknown', 'undefined')"

_P1 = f"""
WITH rows AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY run_id, model_id, benchmark_id) AS n FROM score_records WHERE run_id <> '' AND model_id <> '' AND benchmark_id <> '') WHERE n >= 2
), entries AS (
  SELECT run_id, model_id, benchmark_id, record_id, 0::BIGINT AS entry_no, score, source.kind AS kind, source.url AS url, source.ref AS ref, source.reported_by AS reported_by, trim(source.published) AS pub, trim(source.fetched_at) AS got FROM rows
  UNION ALL
  SELECT run_id, model_id, benchmark_id, record_id, i::BIGINT, v.score, v.source.kind, v.source.url, v.source.ref, v.source.reported_by, trim(v.source.published), trim(v.source.fetched_at)
  FROM (SELECT run_id, model_id, benchmark_id, record_id, unnest(variants) AS v, generate_subscripts(variants, 1) AS i FROM rows)
), placed AS (
  SELECT e.*, coalesce(k.trust, 0) AS trust,
    coalesce(
      CASE WHEN regexp_full_match(pub, '\\d{{4}}-\\d{{2}}-\\d{{2}}(T.*)?') THEN try_cast(pub[:10] AS DATE) END,
      CASE WHEN regexp_full_match(pub, '\\d{{4}}-\\d{{2}}') THEN try_cast(pub || '-15' AS DATE) END,
      CASE WHEN regexp_full_match(pub, '\\d{{4}}/\\d{{2}}/\\d{{2}}') THEN try_cast(replace(pub, '/', '-') AS DATE) END,
      try_strptime(pub, ['%Y%m%d', '%d %b %Y', '%B %d, %Y'])::DATE,
      (try_strptime('15 ' || pub, '%d %B %Y'))::DATE) AS day,
    CASE WHEN regexp_full_match(got, '\\d{{13}}') THEN epoch_ms(got::BIGINT)::TIMESTAMP
         WHEN regexp_full_match(got, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN got::TIMESTAMP
         ELSE try_cast(got AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS instant
  FROM entries e LEFT JOIN source_kinds k ON k.kind = regexp_replace(lower(trim(e.kind)), '[ _-]+', '_', 'g')
), named AS (
  SELECT *, 'score' AS field_name, score >= 0 AND NOT isnan(score) AS ok FROM placed
  UNION ALL SELECT *, 'url', lower(trim(url)) NOT IN {_BLANK} FROM placed
  UNION ALL SELECT *, 'ref', lower(trim(ref)) NOT IN {_BLANK} FROM placed
  UNION ALL SELECT *, 'reported_by', lower(trim(reported_by)) NOT IN {_BLANK} FROM placed
)
SELECT run_id, model_id, benchmark_id, field_name, record_id, entry_no FROM named WHERE ok
QUALIFY row_number() OVER (PARTITION BY run_id, model_id, benchmark_id, field_name ORDER BY day DESC NULLS LAST, trust DESC, instant DESC NULLS LAST, record_id, entry_no) = 1
"""


_P3_RULES = """
SELECT unit_kind, count(*) AS entries, 0::BIGINT AS torn, 0::BIGINT AS unplaced FROM (
  SELECT entry_id, 'benchmark' AS unit_kind FROM bench_split UNION ALL SELECT entry_id, 'model' FROM model_split) WHERE entry_id IS NOT NULL GROUP BY 1
"""
_P7_RULES = "SELECT job, (SELECT count(DISTINCT doc_id) FROM documents) AS docs, 0::BIGINT AS overfull, 0::BIGINT AS torn FROM pack_sizes"
_P8_RULES = "SELECT source, false AS over_cap, 0::BIGINT AS strangers FROM mix_targets"


_SQUEEZE = "regexp_replace(lower({0}), '[^a-z0-9{1}]+', '', 'g')"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in sorted(xs)) + ")"
# the page of a link: no scheme, query, port or 'www.', no branch, index page or suffix of a repository
_PAGE = """
bare AS (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(u, '^\\s+|\\s+$', '', 'g')), '(?i)^(?:[a-z][a-z0-9+.\\-]*:)?//', ''), '[?#].*$', '') AS s FROM ent),
parted AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(s, '^([^/]*)', 1)), '^www\\d?\\.', ''), ':\\d+$', '') AS host, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(s, '^[^/]*(/.*)$', 1), '/{2,}', '/', 'g'), '/(?:tree|blob)/(?:main|master)/?$', ''), '/+$', ''), '(?i)(?:\\.git|/index\\.html?)$', '') AS path FROM bare)
"""
_P3_KEYS = f"""
ent AS (
  SELECT entry_id AS node, 'b' AS kind, coalesce('r' || run_id, '-') AS run, maintainer AS a, source_url AS u, benchmark AS n, derived_from AS o FROM bench_split WHERE entry_id IS NOT NULL
  UNION ALL SELECT entry_id, 'm', coalesce('r' || run_id, '-'), team, report_url, model, base_model FROM model_split WHERE entry_id IS NOT NULL
), {_PAGE.strip()}, keys AS (
  SELECT node, kind || run || '|author|' || v AS key FROM (SELECT node, kind, run, {_SQUEEZE.format("regexp_replace(x, '" + chr(92) + "bet al" + chr(92) + "b" + chr(92) + ".?', '', 'g')", "")} AS v FROM (SELECT *, unnest(string_split_regex(regexp_replace(lower(a), '\\s+and\\s+|\\s+et\\s+|\\s+with\\s+', ';', 'g'), '[;/&+,|]')) AS x FROM ent WHERE lower(trim(regexp_replace(a, '^\\s+|\\s+$', '', 'g'))) NOT IN {_BLANK})) WHERE v NOT IN {_LIST(components.NOBODY)}
  UNION ALL SELECT node, kind || run || '|source|' || host || path FROM parted WHERE contains(host, '.') AND length(path) > 1
  UNION ALL SELECT node, kind || run || '|entity|' || {_SQUEEZE.format('x', '.')} FROM (SELECT *, unnest([n, o]) AS x FROM ent) WHERE x IS NOT NULL AND {_SQUEEZE.format('x', '.')} NOT IN {_LIST(components.NO_ENTITY)} AND lower(trim(x)) NOT IN {_BLANK}
), low AS (SELECT key, min(node) AS lo FROM keys GROUP BY 1 HAVING min(node) < max(node)
), edges AS MATERIALIZED (SELECT DISTINCT node AS x, lo AS z FROM keys JOIN low USING (key) WHERE node <> lo UNION SELECT DISTINCT lo, node FROM keys JOIN low USING (key) WHERE node <> lo
), comp AS (SELECT node, min(seen) AS component FROM (WITH RECURSIVE w AS (SELECT x AS node, x AS seen FROM edges UNION SELECT e.z, w.seen FROM w JOIN edges e ON e.x = w.node) SELECT * FROM w) GROUP BY 1)
"""
_P3_FOUND = f"WITH {_P3_KEYS.strip()} SELECT component AS entry_a, node AS entry_b FROM comp WHERE node <> component"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p3_found": _P3_FOUND, "p3_rules": _P3_RULES, "p7_rules": _P7_RULES, "p8_rules": _P8_RULES}
