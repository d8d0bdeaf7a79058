"""Queries of the record merge and the leaderboard views."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.cleaning import usable_score
from rankloom.operators import board as B
from rankloom.operators import texts as X
from rankloom.operators import views as V
from rankloom.plans.alignment import BASE, matrix
from rankloom.runtime import small
from rankloom.runtime import table as t

#: Hosts of the test data that stand for those that repeat others, and benchmarks that stand for composites and excluded ones.
REPEATERS = ("flaibea.example", "cotra.example")
COMPOSITES, EXCLUDED = ["teadetaisk-bench"], ["BUCLOSKOUL-EVAL-LITE"]


def _variants_of(s, d):
    """(benchmark, canonical): a second version stands for the first one if the catalog has it."""
    b = t(s, d, "benchmarks").select("id")
    old = b.select(F.col("id").alias("canonical"))
    return b.where("id LIKE '%-v2'").select(F.col("id").alias("benchmark"), F.regexp_replace("id", "-v2$", "").alias("canonical")).join(old, "canonical", "left_semi")


def mg1_merged(s, d):
    return B.merged(t(s, d, "score_records"), t(s, d, "source_kinds"), REPEATERS)


def wn6_variants(s, d):
    return B.variants(t(s, d, "score_records"), t(s, d, "source_kinds"), REPEATERS)


def mg2_deduplicated(s, d):
    return B.deduplicated(t(s, d, "score_records"), t(s, d, "source_kinds"))


def mg3_canonicalised(s, d):
    """Representatives once benchmarks have their canonical ids, without those of the category 'other'."""
    blocked = t(s, d, "benchmarks").where("category = 'other'").select(F.col("id").alias("benchmark"))
    return B.merged(V.canonical_records(t(s, d, "score_records"), _variants_of(s, d), blocked), t(s, d, "source_kinds"), REPEATERS)


def mg4_metadata(s, d):
    return V.merged_metadata(t(s, d, "benchmarks"), _variants_of(s, d))


def mg5_category_view(s, d):
    """Cells of all tabs: the merged score of each model group on each benchmark shown; of several models of a group the best place counts."""
    cells = B.merged(t(s, d, "score_records").where("run_id is not null"), t(s, d, "source_kinds"), REPEATERS)
    groups = small(V.model_groups(t(s, d, "models")).select(F.col("model_id").alias("_m"), "group_id"))
    own = cells.join(groups, F.col("model_id") == F.col("_m"), "left").select(F.col("benchmark_id").alias("benchmark"), F.coalesce("group_id", "model_id").alias("model"), "score", "record_id")
    last = own.groupBy("benchmark", "model").agg(F.max_by("score", "record_id").alias("score"))
    shown = V.core_columns(V.tabs(t(s, d, "benchmarks")), _counts(s, d), _well_known(s, d)).where("shown")
    return last.join(small(shown.drop("shown")), "benchmark").select("tab", "benchmark", "model", "score")


def _counts(s, d):
    return t(s, d, "score_records").where("benchmark_id is not null and model_id is not null").groupBy(F.col("benchmark_id").alias("benchmark")).agg(F.count_distinct("model_id").alias("models"))


def _well_known(s, d):
    return t(s, d, "benchmarks").where("note is null and language = 'en'").select(F.col("id").alias("benchmark"))


def mg8_tag_rules(s, d):
    """Tags by rules over the text of a benchmark; deprecated splits have a tag of their own."""
    rules = [("code", "code|swe"), ("dialogue", "chat|arena"), ("images", "vqa|vision"), ("numbers", "math")]
    override = t(s, d, "benchmarks").where("note = 'deprecated split'").select("id", F.array(F.lit("old"), F.lit("unheard-of")).alias("tags"))
    return V.tagged(t(s, d, "benchmarks"), rules, ["code", "dialogue", "images", "numbers", "math", "coding", "old", "general", "vision"], "general", override)


def mg9_new_benchmarks(s, d):
    return V.new_benchmarks(t(s, d, "score_records"), t(s, d, "benchmarks"), X.category_of(F.col("name")), X.unsteady(F.col("name")), X.benchmark_slug(F.col("name")))


def sc2_leaderboard(s, d):
    rows = t(s, d, "score_records").where(usable_score(F.col("score"))).where("benchmark_id is not null and model_id is not null").select(F.col("benchmark_id").alias("benchmark"), F.col("model_id").alias("model"), "score", F.col("record_id").alias("place"))
    return V.leaderboard(rows, V.alias_table(t(s, d, "models")), COMPOSITES, EXCLUDED)


def pj3_aliases(s, d):
    names = t(s, d, "score_records").where("model_id is not null").groupBy(F.col("model_id").alias("typed")).agg(F.count("*").alias("n")).withColumn("model", F.col("typed"))
    return V.renamed(names, "model", V.alias_table(t(s, d, "models")))


def pj4_resolved(s, d):
    names = t(s, d, "score_records").where("model_id is not null").groupBy("model_id").agg(F.count("*").alias("n"))
    return V.resolved(names, "model_id", t(s, d, "models"))


def pj7_benchmark_name(s, d):
    """Base and config of benchmark names as typed, and the id of the base."""
    base, config = X.benchmark_name(F.col("benchmark_id"))
    n = t(s, d, "score_records").where("benchmark_id is not null").groupBy("benchmark_id").agg(F.count("*").alias("n"))
    return n.select("benchmark_id", "n", base.alias("base"), config.alias("config"), X.benchmark_slug(base).alias("slug"))


def pj9_model_config(s, d):
    """Models named with the config of a record in brackets, split again, and the config merged with that of the score."""
    r = t(s, d, "score_records").where("model_id is not null and config is not null").groupBy("config").agg(F.min("model_id").alias("model_id"))
    base, config = V.model_config(F.concat("model_id", F.lit(" ("), "config", F.lit(")")))
    return r.select("config", base.alias("base"), config.alias("own"), V.joined_config(config, F.lit("High")).alias("both"))


def jn16_model_groups(s, d):
    """Groups of the catalog when every mini model bears its size as a config of the bare name."""
    m = t(s, d, "models").withColumn("name", F.when(F.col("id").endswith("-mini"), F.concat(F.regexp_replace("name", " Mini$", ""), F.lit(" (Low, 16K)"))).otherwise(F.col("name")))
    return V.model_groups(m)


def fl2_filtered(s, d):
    names = [r.name for r in t(s, d, "benchmarks").where("category = 'math'").select("name").orderBy("name").collect()]
    without = [r.name for r in t(s, d, "models").where("id LIKE '%-mini'").select("name").orderBy("name").collect()]
    return V.filtered(matrix(s, d), V.alias_table(t(s, d, "models")), names, [], without)


def fl3_subset(s, d):
    return V.subset(t(s, d, "benchmarks").select(F.col("id").alias("benchmark")), t(s, d, "bench_split").where("lower(trim(bucket)) = 'test'"), "not_in_subset")


def fl4_restricted(s, d):
    return V.restricted(matrix(s, d), t(s, d, "model_split").where("lower(trim(scope)) = 'seen'"))


def fl5_tabs(s, d):
    return V.tabs(t(s, d, "benchmarks"))


def fl6_core_columns(s, d):
    return V.core_columns(V.tabs(t(s, d, "benchmarks")), _counts(s, d), _well_known(s, d))


def fl8_table_search(s, d):
    """Rows of a table by text in the name, vendor, size and a set of models: which filters a model passes."""
    m = t(s, d, "models")
    some = small(t(s, d, "model_split").select(F.col("model").alias("id")).distinct().withColumn("_in", F.lit(True)))
    size = F.regexp_extract("id", r"-(\d+)b(?:-|$)", 1).try_cast("int")
    return m.join(some, "id", "left").select("id", F.contains(F.lower("name"), F.lit("70b")).alias("by_text"), F.coalesce(F.substring("vendor", 1, 1).isin("B", "D", "W"), F.lit(False)).alias("by_vendor"), F.coalesce(size <= 15, F.lit(False)).alias("by_size"), F.col("_in").isNotNull().alias("in_set"))


def _curated(s, d):
    r = t(s, d, "score_records")
    return r.select("record_id", F.col("benchmark_id").alias("benchmark"), F.col("model_id").alias("model"), F.when(F.col("score") <= 1, "0-1").alias("scale"), F.col("config").alias("metric"), "score", F.col("source.ref").alias("title"), F.col("source.url").alias("url"), F.col("source.published").alias("date"), F.col("source.fetched_at").alias("retrieved_at"))


def sc5_curated(s, d):
    """Faults of score records read as curated cells."""
    return V.provenance_faults(_curated(s, d)).select("record_id", F.array_join("faults", ",").alias("faults"))


def sc5_doubled(s, d):
    return V.doubled_cells(_curated(s, d).where("benchmark is not null and model is not null"), V.alias_table(t(s, d, "models")))


def sc19_score_files(s, d):
    """Dropped files that a union of folders takes: JSON, no draft, no leading '_'; by the first part of their names."""
    f = t(s, d, "raw_drops").select("file_name").where(F.endswith("file_name", F.lit(".json")) & ~F.endswith("file_name", F.lit(".draft.json")) & ~F.startswith("file_name", F.lit("_")))
    return f.groupBy(F.regexp_extract("file_name", r"^([a-z]+)-", 1).alias("stem")).agg(F.count("*").alias("files"), F.count_distinct("file_name").alias("names"))


_HELP = {"matrix", "small", "t", "usable_score"}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] != "_" and k not in _HELP}

_DAY = "coalesce(CASE WHEN regexp_full_match(x, '\\d{4}-\\d{2}-\\d{2}(T.*)?') THEN try_cast(x[:10] AS DATE) END, CASE WHEN regexp_full_match(x, '\\d{4}-\\d{2}') THEN try_cast(x || '-15' AS DATE) END, CASE WHEN regexp_full_match(x, '\\d{4}/\\d{2}/\\d{2}') THEN try_cast(replace(x, '/', '-') AS DATE) END, try_strptime(x, ['%Y%m%d', '%d %b %Y', '%B %d, %Y'])::DATE, try_strptime('15 ' || x, '%d %B %Y')::DATE)"
_INSTANT = "CASE WHEN regexp_full_match(got, '\\d{13}') THEN epoch_ms(got::BIGINT)::TIMESTAMP WHEN regexp_full_match(got, '\\d{4}-\\d{2}-\\d{2}') THEN got::TIMESTAMP ELSE try_cast(got AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END"
_ORDER = "CASE WHEN dated THEN day END DESC NULLS LAST, rel DESC, fetched DESC NULLS LAST, score DESC, day DESC NULLS LAST, record_id, entry_no"
_G = "run_id, model_id, benchmark_id"


def _entries(records: str, repeaters: tuple[str, ...]) -> str:
    """CTEs that end in ``placed``: usable entries, each once, with their place in the order of their group."""
    hosts = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in repeaters) or "false"
    return f"""
ent AS (
  SELECT {_G}, record_id, 0::BIGINT AS entry_no, score, config, source, CASE WHEN json_valid(extra) THEN json_extract_string(extra, '$.user_correction') END AS fixed FROM {records}
  UNION ALL SELECT {_G}, record_id, i, v.score, v.config, v.source, NULL FROM (SELECT *, unnest(variants) AS v, generate_subscripts(variants, 1)::BIGINT AS i FROM {records})
), raw AS (
  SELECT e.*, lower(trim(coalesce(config, ''))) AS cfg, coalesce(source.url, '') AS url, coalesce(source.ref, '') AS ref, coalesce(source.reported_by, '') AS reporter, trim(source.published) AS x, trim(source.fetched_at) AS got,
    regexp_extract(lower(coalesce(source.url, '')), '^https?://(?:www\\.)?([^/:?#]+)', 1) AS host, coalesce(k.trust, 0) AS trust
  FROM ent e LEFT JOIN source_kinds k ON k.kind = regexp_replace(lower(trim(source.kind)), '[ _-]+', '_', 'g') WHERE score >= 0 AND NOT isnan(score) AND model_id IS NOT NULL AND benchmark_id IS NOT NULL
), told AS (
  SELECT *, {_DAY} AS day, {_INSTANT} AS fetched, CASE WHEN fixed = 'true' THEN 6 WHEN {hosts} THEN 2 ELSE trust END AS rel FROM raw
), once AS (
  SELECT * FROM (SELECT *, bool_and(day IS NOT NULL) OVER (PARTITION BY {_G}) AS dated FROM told) QUALIFY row_number() OVER (PARTITION BY {_G}, cfg, score, url, ref, reporter ORDER BY {_ORDER}) = 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY {_ORDER}) - 1 AS place, count(*) OVER (PARTITION BY {_G}) AS n FROM once
)"""


_TOP = f"SELECT {_G}, score, cfg AS config, record_id, entry_no, n - 1 AS variants FROM placed WHERE place = 0"
_ALIAS = "alias AS (SELECT trim(a) AS alias, min(id) AS model FROM (SELECT id, unnest(list_append(coalesce(aliases, []), name)) AS a FROM models) WHERE a IS NOT NULL GROUP BY 1)"
_V2 = "v2 AS (SELECT id AS benchmark, regexp_replace(id, '-v2$', '') AS canonical FROM benchmarks WHERE id LIKE '%-v2' AND regexp_replace(id, '-v2$', '') IN (SELECT id FROM benchmarks))"
_DEC = "(CASE WHEN abs(score - round(score)) < 1e-6 THEN 0 WHEN abs(score * 10 - round(score * 10)) < 1e-6 THEN 1 WHEN abs(score * 100 - round(score * 100)) < 1e-5 THEN 2 WHEN abs(score * 1000 - round(score * 1000)) < 1e-4 THEN 3 ELSE 4 END)"
_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_FLAT = "regexp_replace(lower({0}), '[\\s_./\\\\\\-()\\[\\]]+', '', 'g')"
_TABS = """tabs AS (
  SELECT unnest(list_distinct(list_filter(['all', type, CASE WHEN type = 'non_deterministic' AND category IN ('preference', 'agent', 'safety', 'korean', 'multilinguality') THEN 'nd_' || category END,
    CASE WHEN type = 'deterministic' THEN category END, CASE WHEN type = 'deterministic' AND category IN ('multimodal', 'vision', 'video') THEN 'multimodal' END], lambda x: x IS NOT NULL))) AS tab, id AS benchmark FROM benchmarks
), core AS (
  SELECT tab, t.benchmark, tab IN ('all', 'deterministic', 'non_deterministic') OR coalesce(models, 0) >= 6 OR t.benchmark IN (SELECT id FROM benchmarks WHERE note IS NULL AND language = 'en') AS shown FROM tabs t
  LEFT JOIN (SELECT benchmark_id, count(DISTINCT model_id) AS models FROM score_records GROUP BY 1) c ON c.benchmark_id = t.benchmark
)"""
_CAT = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{c}'" for c, p in X.CATEGORIES) + " ELSE 'other' END"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[()\\[\\]/]', ' ', 'g'), '\\s+', '-', 'g'), '[^a-z0-9.+''-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
_MODEL_BASE = "^(.*?)\\s*\\(([^()]*)\\)\\s*$"
_CONFIG_FITS = "(regexp_matches({0}, '" + _MODEL_BASE + "') AND len(list_filter(string_split(regexp_extract({0}, '" + _MODEL_BASE + "', 2), ','), lambda x: trim(x) <> '')) > 0 AND len(list_filter(string_split(regexp_extract({0}, '" + _MODEL_BASE + "', 2), ','), lambda x: trim(x) <> '' AND NOT (lower(trim(x)) IN ('high', 'medium', 'low', 'max', 'none') OR regexp_full_match(lower(trim(x)), '\\d+\\s*k') OR contains(lower(x), 'thinking') OR contains(lower(x), 'reasoning')))) = 0)"
_BLANKS = "coalesce(trim({0}), '') = ''"

SQL = {
    "mg1_merged": f"WITH {_entries('score_records', REPEATERS)} {_TOP}",
    "wn6_variants": f"WITH {_entries('score_records', REPEATERS)} SELECT {_G}, place, record_id, entry_no, score, cfg AS config FROM placed",
    "mg2_deduplicated": f"WITH {_entries('score_records', ())} SELECT {_G}, config, score, distinct_scores FROM (SELECT {_G}, cfg AS config, arg_max(score, [{_DEC}, -place]) AS score, count(DISTINCT score) AS distinct_scores, max(score) - min(score) AS gap FROM placed GROUP BY ALL) WHERE distinct_scores = 1 OR gap <= 0.5",
    "mg3_canonicalised": f"WITH {_V2}, canon AS (SELECT r.* REPLACE (coalesce(v2.canonical, benchmark_id) AS benchmark_id) FROM score_records r LEFT JOIN v2 ON v2.benchmark = r.benchmark_id), kept AS (SELECT * FROM canon WHERE benchmark_id IS NULL OR benchmark_id NOT IN (SELECT id FROM benchmarks WHERE category = 'other')), {_entries('kept', REPEATERS)} {_TOP}",
    "mg4_metadata": f"WITH {_V2} SELECT coalesce(canonical, id) AS id, count(*) AS entries, " + ", ".join(f"arg_min({c}, id) FILTER ({c} IS NOT NULL) AS {c}" for c in ("name", "source_url", "description", "note")) + ", " + ", ".join(f"arg_max({c}, id) FILTER ({c} IS NOT NULL) AS {c}" for c in ("category", "type", "language", "scale")) + " FROM benchmarks b LEFT JOIN v2 ON v2.benchmark = b.id GROUP BY 1",
    "mg5_category_view": f"WITH {_TABS}, {_entries('(SELECT * FROM score_records WHERE run_id IS NOT NULL)', REPEATERS)} SELECT tab, benchmark, model, score FROM (SELECT benchmark_id AS benchmark, model_id AS model, arg_max(score, record_id) AS score FROM placed WHERE place = 0 GROUP BY 1, 2) JOIN (SELECT tab, benchmark FROM core WHERE shown) USING (benchmark)",
    "mg8_tag_rules": "SELECT id, array_to_string(list_sort(list_distinct(list_filter(CASE WHEN note = 'deprecated split' THEN ['old'] ELSE CASE WHEN category IS NULL AND NOT regexp_matches(x, 'code|swe|chat|arena|vqa|vision|math') THEN ['general'] ELSE [category, CASE WHEN regexp_matches(x, 'code|swe') THEN 'code' END, CASE WHEN regexp_matches(x, 'chat|arena') THEN 'dialogue' END, CASE WHEN regexp_matches(x, 'vqa|vision') THEN 'images' END, CASE WHEN regexp_matches(x, 'math') THEN 'numbers' END] END END, lambda t: t IN ('code', 'dialogue', 'images', 'numbers', 'math', 'coding', 'old', 'general', 'vision')))), ',') AS tags FROM (SELECT *, lower(concat_ws(' ', id, name, description)) AS x FROM benchmarks)",
    "mg9_new_benchmarks": f"WITH n AS (SELECT DISTINCT trim(benchmark_id) AS name FROM score_records WHERE trim(benchmark_id) <> ''), k AS (SELECT {_KEY.format('id')} AS k FROM benchmarks UNION SELECT {_KEY.format('name')} FROM benchmarks WHERE name IS NOT NULL), f AS (SELECT {_SLUG.format('name')} AS id, name FROM n WHERE {_KEY.format('name')} NOT IN (SELECT k FROM k)) SELECT id, name, {_CAT.format('name')} AS category, CASE WHEN regexp_matches(lower(name), '{X.UNSTEADY}') THEN 'non_deterministic' ELSE 'deterministic' END AS type FROM (SELECT id, min(name) AS name FROM f WHERE id <> '' GROUP BY 1)",
    "sc2_leaderboard": f"WITH {_ALIAS} SELECT benchmark_id AS benchmark, coalesce(model, trim(model_id)) AS model, arg_min(score, record_id) AS score FROM score_records LEFT JOIN alias ON alias = trim(model_id) WHERE score >= 0 AND NOT isnan(score) AND benchmark_id IS NOT NULL AND model_id IS NOT NULL AND benchmark_id NOT LIKE '\\_%' ESCAPE '\\' AND model_id NOT LIKE '\\_%' ESCAPE '\\' AND benchmark_id <> 'teadetaisk-bench' AND lower(benchmark_id) <> 'bucloskoul-eval-lite' GROUP BY 1, 2",
    "pj3_aliases": f"WITH {_ALIAS} SELECT typed, n, coalesce(model, trim(typed)) AS model FROM (SELECT model_id AS typed, count(*) AS n FROM score_records WHERE model_id IS NOT NULL GROUP BY 1) LEFT JOIN alias ON alias = trim(typed)",
    "pj4_resolved": f"WITH f AS (SELECT {_FLAT.format('x')} AS flat, min(id) AS resolved FROM (SELECT id, unnest(list_concat([id, name], coalesce(aliases, []))) AS x FROM models) WHERE x IS NOT NULL GROUP BY 1) SELECT model_id, n, resolved FROM (SELECT model_id, count(*) AS n FROM score_records WHERE model_id IS NOT NULL GROUP BY 1) LEFT JOIN f ON model_id <> '' AND flat = {_FLAT.format('model_id')}",
    "pj7_benchmark_name": f"SELECT benchmark_id, n, base, config, {_SLUG.format('base')} AS slug FROM (SELECT benchmark_id, count(*) AS n, CASE WHEN regexp_matches(benchmark_id, '^([^(]+?)\\s*\\((.+)\\)\\s*$') THEN trim(regexp_extract(benchmark_id, '^([^(]+?)\\s*\\((.+)\\)\\s*$', 1)) ELSE trim(benchmark_id) END AS base, CASE WHEN regexp_matches(benchmark_id, '^([^(]+?)\\s*\\((.+)\\)\\s*$') THEN trim(regexp_replace(regexp_extract(benchmark_id, '^([^(]+?)\\s*\\((.+)\\)\\s*$', 2), '\\)\\s*\\(', ', ', 'g')) END AS config FROM score_records WHERE benchmark_id IS NOT NULL GROUP BY 1)",
    "pj9_model_config": f"SELECT config, base, own, CASE WHEN own IS NULL THEN 'High' WHEN contains('high', lower(own)) THEN 'High' ELSE own || '; High' END AS both FROM (SELECT config, CASE WHEN ok THEN trim(regexp_extract(x, '{_MODEL_BASE}', 1)) ELSE x END AS base, CASE WHEN ok THEN trim(regexp_extract(x, '{_MODEL_BASE}', 2)) END AS own FROM (SELECT config, x, {_CONFIG_FITS.format('x')} AS ok FROM (SELECT config, min(model_id) || ' (' || config || ')' AS x FROM score_records WHERE model_id IS NOT NULL AND config IS NOT NULL GROUP BY config)))",
    "jn16_model_groups": f"WITH m AS (SELECT id, vendor, CASE WHEN id LIKE '%-mini' THEN regexp_replace(name, ' Mini$', '') || ' (Low, 16K)' ELSE name END AS name FROM models), s AS (SELECT id, name, CASE WHEN ok THEN trim(regexp_extract(name, '{_MODEL_BASE}', 1)) ELSE name END AS base, CASE WHEN ok THEN trim(regexp_extract(name, '{_MODEL_BASE}', 2)) END AS config, vendor FROM (SELECT *, {_CONFIG_FITS.format('name')} AS ok FROM m)), k AS (SELECT *, lower(trim(coalesce(vendor, ''))) || '::' || regexp_replace(lower(trim(base)), '\\s+', ' ', 'g') AS key FROM s), g AS (SELECT *, bool_or(config IS NOT NULL) OVER w AS grouped, min(id) FILTER (lower(trim(name)) = lower(trim(base))) OVER w AS bare, min(id) OVER w AS first FROM k WINDOW w AS (PARTITION BY key)) SELECT id AS model_id, CASE WHEN grouped THEN coalesce(bare, first) ELSE id END AS group_id, CASE WHEN grouped THEN base ELSE name END AS group_name, config FROM g",
    "fl2_filtered": f"WITH {BASE}, {_ALIAS} SELECT benchmark, coalesce(alias.model, trim(y.model)) AS model, score FROM y LEFT JOIN alias ON alias = trim(y.model) WHERE {_KEY.format('benchmark')} IN (SELECT {_KEY.format('name')} FROM benchmarks WHERE category = 'math') AND coalesce(alias.model, trim(y.model)) NOT IN (SELECT coalesce(a.model, trim(name)) FROM models LEFT JOIN alias a ON a.alias = trim(name) WHERE id LIKE '%-mini')",
    "fl3_subset": "SELECT id AS benchmark, CASE WHEN id NOT IN (SELECT benchmark FROM bench_split WHERE lower(trim(bucket)) = 'test' AND benchmark IS NOT NULL) THEN 'not_in_subset' END AS reason FROM benchmarks",
    "fl4_restricted": f"WITH {BASE} SELECT benchmark, model, score FROM y WHERE model IN (SELECT model FROM model_split WHERE lower(trim(scope)) = 'seen')",
    "fl5_tabs": f"WITH {_TABS} SELECT tab, benchmark FROM tabs",
    "fl6_core_columns": f"WITH {_TABS} SELECT tab, benchmark, shown FROM core",
    "fl8_table_search": "SELECT id, contains(lower(name), '70b') AS by_text, coalesce(vendor[1] IN ('B', 'D', 'W'), false) AS by_vendor, coalesce(try_cast(regexp_extract(id, '-(\\d+)b(?:-|$)', 1) AS INT) <= 15, false) AS by_size, id IN (SELECT model FROM model_split WHERE model IS NOT NULL) AS in_set FROM models",
    "sc5_curated": "SELECT record_id, concat_ws(',', CASE WHEN " + _BLANKS.format("benchmark_id") + " THEN 'no_benchmark' END, CASE WHEN " + _BLANKS.format("model_id") + " THEN 'no_model' END, CASE WHEN coalesce(score, 2) > 1 THEN 'wrong_scale' END, CASE WHEN " + _BLANKS.format("config") + " THEN 'no_metric' END, CASE WHEN regexp_matches(lower(config), 'todo|replace|placeholder') THEN 'metric_placeholder' END, CASE WHEN coalesce(isnan(score) OR score < 0 OR score > 1, true) THEN 'score_out_of_range' END, CASE WHEN " + _BLANKS.format("source.ref") + " THEN 'no_title' END, CASE WHEN regexp_matches(lower(source.ref), 'todo|replace|placeholder') THEN 'title_placeholder' END, CASE WHEN " + _BLANKS.format("source.url") + " THEN 'no_url' ELSE CASE WHEN host = '' THEN 'url_not_absolute' END END, CASE WHEN host IN ('localhost', '127.0.0.1', '0.0.0.0') OR ends_with(host, '.local') THEN 'url_local' END, CASE WHEN contains(host, 'example.com') OR ends_with(host, '.invalid') THEN 'url_placeholder' END, CASE WHEN coalesce(source.published, '') <> '' THEN CASE WHEN NOT coalesce(regexp_full_match(trim(source.published), '\\d{4}-\\d{2}-\\d{2}') AND try_cast(trim(source.published) AS DATE) IS NOT NULL, false) THEN 'date_not_iso' END WHEN coalesce(source.fetched_at, '') <> '' THEN CASE WHEN NOT coalesce(regexp_full_match(trim(source.fetched_at), '\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?)?') AND try_cast(trim(source.fetched_at)[:10] AS DATE) IS NOT NULL, false) THEN 'instant_not_iso' END ELSE 'no_date' END) AS faults FROM (SELECT *, regexp_extract(lower(trim(source.url)), '^https?://(?:www\\.)?([^/:?#]+)', 1) AS host FROM score_records)",
    "sc5_doubled": f"WITH {_ALIAS} SELECT {_KEY.format('benchmark_id')} AS key, coalesce(model, trim(model_id)) AS model, count(*) AS n FROM score_records LEFT JOIN alias ON alias = trim(model_id) WHERE benchmark_id IS NOT NULL AND model_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "sc19_score_files": "SELECT regexp_extract(file_name, '^([a-z]+)-', 1) AS stem, count(*) AS files, count(DISTINCT file_name) AS names FROM raw_drops WHERE ends_with(file_name, '.json') AND NOT ends_with(file_name, '.draft.json') AND NOT starts_with(file_name, '_') GROUP BY 1",
}
