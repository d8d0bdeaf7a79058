"""Queries of the readers, text operators, graphs and validators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.cleaning import usable_score, usable_text
from rankloom.functions.semantics import reasons
from rankloom.operators import texts as X
from rankloom.plans.alignment import BASE, matrix, pair_table
from rankloom.runtime import table as t
from rankloom.sources import readers as R


def sc1_score_map(s, d):
    """The matrix written as JSON maps and read back."""
    y = matrix(s, d).groupBy("benchmark").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "score")))).alias("cells"))
    return R.score_map(y.select(F.to_json(F.map_from_arrays(F.array("benchmark"), F.array("cells"))).alias("value")))


def sc4_scaled(s, d):
    return t(s, d, "score_records").select("record_id", R.scaled_fraction(F.col("score")).alias("fraction")).where("fraction IS NOT NULL AND NOT isnan(fraction)")


def sc12_last_per_key(s, d):
    """The last record of a model and benchmark over all runs."""
    r = t(s, d, "score_records").where("model_id <> '' AND benchmark_id IS NOT NULL")
    return r.groupBy("model_id", "benchmark_id").agg(F.max(F.struct("ingested_at", "record_id")).alias("x")).select("model_id", "benchmark_id", F.col("x.record_id").alias("record_id"))


def sc22_latest_file(s, d):
    return R.latest(t(s, d, "raw_drops").select(F.col("file_name").alias("path")), F.regexp_extract("path", r"^([a-z]+)-", 1))


def pj2_slug(s, d):
    """Three ways to make an id of a benchmark's name: for benchmarks, of plain words, and with blanks joined only."""
    return t(s, d, "benchmarks").select("id", X.benchmark_slug(F.col("name")).alias("slug"), X.plain_slug(F.col("name")).alias("plain"), F.regexp_replace(F.lower(F.trim("name")), " ", "-").alias("joined"))


def pj5_split_name(s, d):
    base, tag = X.split_name(F.col("model_id"))
    return t(s, d, "score_records").where("model_id IS NOT NULL").select("record_id", base.alias("base"), tag.alias("tag"))


def pj8_config_tokens(s, d):
    """Configs with their tokens in one spelling, and merged with 'No Tool'."""
    c = F.col("config")
    r = t(s, d, "score_records").groupBy("config").agg(F.count(F.lit(1)).alias("n"))
    return r.select("config", "n", X.config_tokens(c).alias("tokens"), X.merged_config(c, F.lit("No Tool")).alias("merged"))


def pj23_family(s, d):
    """Models by family and benchmarks by stratum."""
    m = t(s, d, "models").groupBy(F.lit("model").alias("kind"), X.model_family(F.col("id")).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return m.unionByName(t(s, d, "benchmarks").groupBy(F.lit("benchmark").alias("kind"), X.stratum(F.col("name")).alias("family")).agg(F.count(F.lit(1)).alias("n")))


def pj24_category(s, d):
    return t(s, d, "benchmarks").select("id", X.category_of(F.col("name")).alias("guess"), X.unsteady(F.col("name")).alias("unsteady"))


def pj25_vendor(s, d):
    """Vendor of a record's model by the first word of its id, from the catalog."""
    v = t(s, d, "models").groupBy(X.family(F.col("id")).alias("family")).agg(F.min("vendor").alias("vendor"))
    r = t(s, d, "score_records").groupBy(X.family(F.col("model_id")).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return r.join(v, "family").groupBy("vendor").agg(F.sum("n").alias("n"))


def fl7_any_all(s, d):
    """Models by what their aliases have: a short form, a code name, or both."""
    a = F.coalesce("aliases", F.array().cast("array<string>"))
    return t(s, d, "models").select("id", F.exists(a, lambda x: x.rlike("^[a-z0-9.-]+$")).alias("has_short"), F.exists(a, lambda x: x.rlike("^[A-Z]")).alias("has_code"), F.size(a).alias("n"))


def gr1_components(s, d):
    """Components of the benchmarks over pairs with rank similarity of 0.9 or more, with their sizes; the greatest is place 1."""
    c = X.min_label(pair_table(s, d).where("r >= 0.9"))
    w = W.partitionBy(F.lit(1)).orderBy(F.desc("size"), "component")  # a catalog
    return c.select("name", "component", "size", F.dense_rank().over(w).alias("place"))


def _tree(s, d):
    """(parent, child) of regions, their nations and the suppliers of those."""
    r, n, u = t(s, d, "region"), t(s, d, "nation"), t(s, d, "supplier")
    up = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.concat(F.lit("n:"), "n_name").alias("child"))
    return up.unionByName(n.join(u, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("n:"), "n_name").alias("parent"), F.col("s_name").alias("child")))


def gr2_descendants(s, d):
    return X.closure(_tree(s, d))


def gr2_leaves(s, d):
    """Leaves under each node that has any."""
    e = _tree(s, d)
    leaves = e.select(F.col("child").alias("node")).join(e.select(F.col("parent").alias("node")), "node", "left_anti").distinct()
    return X.closure(e).where("distance > 0").join(leaves, "node", "left_semi").groupBy("ancestor").agg(F.count(F.lit(1)).alias("leaves"), F.min("node").alias("first"))


def _responses(s, d):
    """Answers and golds made of the texts of score records: labels, numbers, boxes and plain words."""
    r, k = t(s, d, "score_records"), F.col("record_id") % 4
    own = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = F.coalesce(F.when(usable_score(F.col("score")), F.round("score", 1)).cast("decimal(12,1)").cast("string"), F.lit(""))
    last = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("answer - "), own("benchmark_id"))).when(F.col("record_id") % 3 == 1, F.concat(F.lit("The Answer: \\boxed{"), number, F.lit("}. two tasks "), number)).otherwise(own("model_id"))
    gold = F.when(k == 0, F.upper(F.substring("benchmark_id", 1, 1))).when(k == 1, F.concat(F.lit("("), F.upper(F.substring("model_id", 1, 1)), F.lit(")"))).when(k == 2, number).otherwise(F.col("benchmark_id"))
    return r.select("record_id", F.concat(own("config"), F.lit("\n"), last).alias("text"), F.coalesce(gold, F.lit("")).alias("gold"))


def gd1_grades(s, d):
    """The text graders over the same answers."""
    x, g = F.col("text"), F.col("gold")
    return _responses(s, d).select("record_id", X.grade_letter(x, g).alias("letter"), X.grade_short(x, g).alias("short"), F.round(X.grade_spans(x, F.array(g, F.lit("two"))), 6).alias("spans"), X.grade_boxed(x, g).alias("boxed"), X.grade_last_number(x, g).alias("number"))


def gd1_token_f1(s, d):
    """Word F1 of each benchmark's name with its description."""
    return t(s, d, "benchmarks").select("id", F.round(X.token_f1(F.col("name"), F.col("description")), 6).alias("f1"))


def gd1_last_number(s, d):
    return t(s, d, "documents").select("doc_id", X.last_number(F.col("text")).alias("number")).where("number <> ''")


def ag11_item_profiles(s, d):
    """Level weights of the lines of orders as items: priority as benchmark, return flag as tag."""
    i = t(s, d, "lineitem").join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    rows = i.select(F.col("o_orderpriority").alias("benchmark"), F.col("l_returnflag").alias("tag"), (F.floor(F.col("l_quantity") / 13) / 4).cast("double").alias("weight"), (F.col("l_linestatus") == "F").alias("valid"))
    return X.item_profiles(rows).select("benchmark", "tag", F.round("weight", 6).alias("weight"))


def tk15_best_iteration(s, d):
    """The run with the greatest mean score of each metric."""
    g = t(s, d, "scores").where("score BETWEEN 0 AND 1 AND NOT isnan(score) AND metric IS NOT NULL").groupBy(F.lower(F.trim("metric")).alias("metric"), "run_id").agg(F.round(F.avg("score"), 8).alias("mean"))
    return g.groupBy("metric").agg(F.max_by("run_id", F.struct("mean", "run_id")).alias("run_id"))


_HELP = {"usable_score", "usable_text", "reasons", "matrix", "pair_table", "t"}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] != "_" and k not in _HELP | {"W", "F", "X", "R"}}

_BLANK = "('', '-', '--', '?', '.', 'n/a', 'na', 'none', 'null', 'nil', 'nan', 'tbd', 'unknown', 'undefined')"
_SELECTS = {
    "sc1_score_map": "SELECT benchmark, model, score FROM y",
    "sc4_scaled": "SELECT record_id, fraction FROM (SELECT record_id, CASE WHEN score > 1 AND score <= 100 THEN score / 100 ELSE score END AS fraction FROM score_records WHERE NOT isnan(score)) WHERE fraction BETWEEN 0 AND 1",
    "sc12_last_per_key": "SELECT model_id, benchmark_id, record_id FROM score_records WHERE model_id <> '' AND benchmark_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model_id, benchmark_id ORDER BY ingested_at DESC, record_id DESC) = 1",
    "sc22_latest_file": "SELECT regexp_extract(file_name, '^([a-z]+)-', 1) AS stem, max(file_name) AS path FROM raw_drops GROUP BY 1",
    "pj25_vendor": "SELECT vendor, sum(n)::BIGINT AS n FROM (SELECT regexp_extract(lower(model_id), '^([a-z]+)', 1) AS family, count(*) AS n FROM score_records GROUP BY 1) JOIN (SELECT regexp_extract(lower(id), '^([a-z]+)', 1) AS family, min(vendor) AS vendor FROM models GROUP BY 1) USING (family) GROUP BY 1",
    "fl7_any_all": "SELECT id, len(list_filter(coalesce(aliases, []), lambda x: regexp_matches(x, '^[a-z0-9.-]+$'))) > 0 AS has_short, len(list_filter(coalesce(aliases, []), lambda x: regexp_matches(x, '^[A-Z]'))) > 0 AS has_code, len(coalesce(aliases, [])) AS n FROM models",
    "ag11_item_profiles": "SELECT o_orderpriority AS benchmark, l_returnflag AS tag, round(coalesce(avg(floor(l_quantity / 13) / 4) FILTER (l_linestatus = 'F'), 0), 6)::DOUBLE AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "tk15_best_iteration": "SELECT metric, arg_max(run_id, [m::VARCHAR, run_id]) AS run_id FROM (SELECT lower(trim(metric)) AS metric, run_id, round(avg(score), 8) AS m FROM scores WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) AND metric IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
}
_CASE = lambda rules, x, how, rest: "CASE " + " ".join(f"WHEN {how.format(x, p)} THEN '{v}'" for v, p in rules) + f" ELSE {rest} END"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[()\\[\\]/]', ' ', 'g'), '\\s+', '-', 'g'), '[^a-z0-9.+''-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
_BRACKET = "'^(.*?)\\s*\\(([^)]*)\\)\\s*$'"
_TOKEN = "CASE lower(trim(x)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.TOKENS.items()) + " ELSE CASE WHEN regexp_matches(lower(trim(x)), '^pass@\\d+$') THEN lower(trim(x)) ELSE trim(x) END END"
_DEDUPE = "array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda z: lower(z)), lower(x)) = i), ', ')"
_WORDS = "x"
for _n, _w in enumerate(X.NUMBER_WORDS):
    _WORDS = f"regexp_replace({_WORDS}, '(?i)\\b{_w}\\b', '{_n}', 'g')"
_NUM = "regexp_extract(replace({0}, ',', ''), '-?\\d+(?:\\.\\d+)?')"
_LAST = "coalesce(list_extract(regexp_extract_all(replace({0}, ',', ''), '-?\\d+(?:\\.\\d+)?'), -1), '')"
_TOKS = "list_filter(string_split_regex(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\\b(a|an|the)\\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '')"
_F1 = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE 2 * coalesce(list_sum(list_transform(list_distinct({0}), lambda w: least(len(list_filter({0}, lambda x: x = w)), len(list_filter({1}, lambda x: x = w))))), 0) / (len({0}) + len({1})) END"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_CANON = "lower(regexp_replace(regexp_replace(regexp_replace({0}, '\\\\left|\\\\right|\\\\!|\\\\,|\\$| ', '', 'g'), '\\\\dfrac', '\\\\\\\\frac', 'g'), '\\.+$', ''))"
_SELECTS |= {
    "pj2_slug": f"SELECT id, {_SLUG} AS slug, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS plain, replace(lower(trim(name)), ' ', '-') AS joined FROM benchmarks",
    "pj5_split_name": f"SELECT record_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(s, '{X.PEELED}', '')), '{X.SNAPSHOT}', ''), '{X.QUALIFIED}', '')) AS base, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') END AS tag FROM (SELECT *, list_concat(list_transform(list_filter(string_split_regex(lower(regexp_extract(s, '{X.PEELED}', 1)), '[_ \\-]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^\\d+k$') THEN upper(x) ELSE x END), CASE WHEN b IS NULL THEN [] ELSE [b] END) AS tags FROM (SELECT record_id, CASE WHEN regexp_matches(p, {_BRACKET}) THEN trim(regexp_extract(p, {_BRACKET}, 1)) ELSE p END AS s, CASE WHEN regexp_matches(p, {_BRACKET}) THEN trim(regexp_extract(p, {_BRACKET}, 2)) END AS b FROM (SELECT record_id, regexp_replace(regexp_replace(model_id, '^\\s+|\\s+$', '', 'g'), '^[A-Za-z0-9._-]+/', '') AS p FROM score_records WHERE model_id IS NOT NULL)))",
    "pj8_config_tokens": f"SELECT config, n, CASE WHEN coalesce(config, '') = '' THEN 'default' WHEN config = 'default' THEN config ELSE {_DEDUPE} END AS tokens, CASE WHEN coalesce(nullif(config, ''), 'default') = 'default' THEN 'No Tool' ELSE {_DEDUPE.replace('list_filter(l,', 'list_filter(list_append(l, ' + chr(39) + 'no tools' + chr(39) + '),').replace('list_transform(l,', 'list_transform(list_append(l, ' + chr(39) + 'no tools' + chr(39) + '),')} END AS merged FROM (SELECT config, count(*) AS n, list_transform(string_split_regex(config, '\\s*,\\s*'), lambda x: {_TOKEN}) AS l FROM score_records GROUP BY ALL)",
    "pj23_family": "SELECT 'model' AS kind, " + _CASE([(v, p) for p, v in X.FAMILIES], "lower(trim(id))", "starts_with({0}, '{1}')", "coalesce(nullif(string_split(lower(trim(id)), '-')[1], ''), lower(trim(id)))") + " AS family, count(*) AS n FROM models GROUP BY 2 UNION ALL SELECT 'benchmark', " + _CASE([(v, "|".join(p)) for v, p in X.STRATA], "upper(name)", "regexp_matches({0}, '{1}')", "'reasoning'") + ", count(*) FROM benchmarks GROUP BY 2",
    "pj24_category": "SELECT id, " + _CASE(X.CATEGORIES, "lower(name)", "regexp_matches({0}, '{1}')", "'other'") + f" AS guess, regexp_matches(lower(name), '{X.UNSTEADY}') AS unsteady FROM benchmarks",
    "gr1_components": ", e AS MATERIALIZED (SELECT p AS a, q AS b FROM pt WHERE r >= 0.9 UNION ALL SELECT q, p FROM pt WHERE r >= 0.9), c AS (WITH RECURSIVE walk AS (SELECT a AS name, a AS seen FROM e UNION SELECT e.b, w.seen FROM walk w JOIN e ON e.a = w.name) SELECT name, min(seen) AS component FROM walk GROUP BY 1) SELECT name, component, size, dense_rank() OVER (ORDER BY size DESC, component) AS place FROM (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM c)",
    "gr2_descendants": ", e AS (SELECT r_name AS parent, 'n:' || n_name AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n:' || n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey) SELECT ancestor, node, distance FROM (WITH RECURSIVE w AS (SELECT x AS ancestor, x AS node, 0 AS distance FROM (SELECT parent AS x FROM e UNION SELECT child FROM e) UNION ALL SELECT w.ancestor, e.child, w.distance + 1 FROM w JOIN e ON e.parent = w.node) SELECT * FROM w)",
    "gr2_leaves": "SELECT r_name AS ancestor, count(*) AS leaves, min(s_name) AS first FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'n:' || n_name, count(*), min(s_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    "gd1_token_f1": f"SELECT id, round({_F1.format('a', 'b')}, 6)::DOUBLE AS f1 FROM (SELECT id, {_TOKS.format('name')} AS a, {_TOKS.format('description')} AS b FROM benchmarks)",
    "gd1_last_number": f"SELECT doc_id, {_LAST.format('text')} AS number FROM documents WHERE text IS NOT NULL AND {_LAST.format('text')} <> ''",
    "gd1_grades": f"""
, made AS (SELECT *, coalesce(CASE WHEN score >= 0 AND NOT isnan(score) THEN round(score, 1)::DECIMAL(12,1)::VARCHAR END, '') AS num FROM score_records
), resp AS (SELECT record_id, coalesce(config, '') || chr(10) || CASE record_id % 3 WHEN 0 THEN 'answer - ' || coalesce(benchmark_id, '') WHEN 1 THEN 'The Answer: \\boxed{{' || num || '}}. two tasks ' || num ELSE coalesce(model_id, '') END AS text,
  coalesce(CASE record_id % 4 WHEN 0 THEN upper(benchmark_id[1]) WHEN 1 THEN '(' || upper(model_id[1]) || ')' WHEN 2 THEN num ELSE benchmark_id END, '') AS gold FROM made
), fin AS (SELECT *, CASE WHEN len(h) > 0 THEN {_STRIP.format('h[-1]')} ELSE {_STRIP.format("regexp_extract(" + _STRIP.format('text') + ", '([^" + chr(92) + "n]*)$', 1)")} END AS pred FROM (SELECT *, regexp_extract_all(text, '(?i)answer\\s*[:\\-]\\s*([^\\n]+)', 1) AS h, regexp_extract_all(text, '\\\\boxed\\{{([^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*)\\}}', 1) AS boxes FROM resp)
), norm AS (SELECT *, regexp_replace(lower({_STRIP.format("regexp_replace(pred, '[.]+$', '')")}), '\\s+', ' ', 'g') AS a, regexp_replace(lower({_STRIP.format('gold')}), '\\s+', ' ', 'g') AS b, regexp_extract({_STRIP.format('gold')}, '^\\(([A-Z])\\)$', 1) AS label, coalesce({_STRIP.format('boxes[-1]')}, pred) AS box, {_TOKS.format('pred')} AS tp, {_TOKS.format('gold')} AS tg, ['two'] AS tw, {_NUM.format(_WORDS.replace('x', 'pred', 1) if False else '(' + 'W' + ')')} AS pn FROM fin
)
SELECT record_id, (regexp_extract(upper(pred), '[A-Z1-9]') = upper({_STRIP.format('gold')}))::INT::DOUBLE AS letter,
  (CASE WHEN label <> '' THEN regexp_extract(upper(pred), '[A-Z]') = label ELSE a = b OR (len(string_split(b, ' ')) <= 2 AND starts_with(a, b) AND regexp_matches(right(b, 1), '^[A-Za-z0-9_]$') <> regexp_matches(substr(a, length(b) + 1, 1), '^[A-Za-z0-9_]$')) OR (regexp_matches(b, '[\\[\\](){{}}<>]') AND regexp_replace(a, '\\s+', '', 'g') = regexp_replace(b, '\\s+', '', 'g')) END)::INT::DOUBLE AS short,
  round(greatest(CASE WHEN regexp_matches({_STRIP.format('gold')}, '^-?\\d+(?:\\.\\d+)?$') AND pn = {_STRIP.format('gold')} THEN 1.0 ELSE {_F1.format('tp', 'tg')} END, {_F1.format('tp', 'tw')}), 6)::DOUBLE AS spans,
  ({_CANON.format('box')} = {_CANON.format('gold')} OR coalesce(abs(try_cast({_NUM.format('box')} AS DOUBLE) - try_cast({_NUM.format('gold')} AS DOUBLE)) < 1e-6, false))::INT::DOUBLE AS boxed,
  ({_LAST.format('pred')} <> '' AND {_LAST.format('pred')} = {_LAST.format('gold')})::INT::DOUBLE AS number FROM norm
""".replace("(W)", "(" + _WORDS.replace("(x,", "(pred,", 1) + ")"),
}
SQL = {k: f"WITH {BASE} {v}" for k, v in _SELECTS.items()}
