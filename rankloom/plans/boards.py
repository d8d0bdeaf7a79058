"""Queries of the leaderboard, ranking, split and resampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.cleaning import kind_key, name_key, publication_day, usable_score
from rankloom.functions.semantics import half_up_tenth, level_weight, reasons, weight_level
from rankloom.operators import align as A
from rankloom.operators import board as B
from rankloom.plans.alignment import BASE, matrix, pair_table, tag_weights
from rankloom.runtime import small, stash
from rankloom.runtime import table as t
from rankloom.sources.readers import scaled_fraction

_RHO = "CASE WHEN stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"


def mg6_trend_series(s, d):
    """Dated models of benchmarks that have at least five of them; a month stands for its 15th."""
    m = t(s, d, "models").select(F.col("id").alias("model"), publication_day(F.col("release_date")).alias("day")).where("day IS NOT NULL")
    j = matrix(s, d).join(small(m), "model")
    n = j.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("benchmark")
    return j.join(n, "benchmark").select("benchmark", "model", F.col("day").cast("string").alias("day"), "score")


def mg7_model_scores(s, d):
    """Per model and category: how many benchmarks it has, and the mean of its scores."""
    b = t(s, d, "benchmarks").select(F.col("id").alias("benchmark"), "category")
    return matrix(s, d).join(small(b), "benchmark").groupBy("model", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 8).alias("mean"))


def jn9_merged_sources(s, d):
    """Matrix cells with records (percent above 1 to 100, else fractions) standing in for cells that the matrix lacks; names meet by key."""
    y = matrix(s, d).select(name_key(F.col("benchmark")).alias("bk"), name_key(F.col("model")).alias("mk"), F.lit(1).alias("place"), "score")
    r = t(s, d, "score_records").where(usable_score(F.col("score"))).select(name_key(F.col("benchmark_id")).alias("bk"), name_key(F.col("model_id")).alias("mk"), F.lit(2).alias("place"), scaled_fraction(F.col("score")).alias("score")).where("bk <> '' AND mk <> '' AND score IS NOT NULL")
    r = r.groupBy("bk", "mk", "place").agg(F.max("score").alias("score"))
    return y.unionByName(r).groupBy("bk", "mk").agg(F.min(F.struct("place", "score")).alias("x")).select("bk", "mk", F.col("x.place").alias("place"), F.round("x.score", 5).alias("score"))


def jn10_exact_then_fuzzy(s, d):
    """Benchmark of a record by id, else by key of its name."""
    names = t(s, d, "score_records").where("benchmark_id IS NOT NULL").groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n"))
    b = small(t(s, d, "benchmarks").select("id"))
    keys = small(t(s, d, "benchmarks").groupBy(name_key(F.col("id")).alias("key")).agg(F.min("id").alias("fuzzy")))
    j = names.join(b, F.col("id") == F.col("benchmark_id"), "left").join(keys, F.col("key") == name_key(F.col("benchmark_id")), "left")
    return j.select("benchmark_id", "n", F.coalesce("id", "fuzzy").alias("matched"))


def jn11_corrections(s, d):
    """Overlay of corrected cells (a tenth by hash gets +0.01), all or nothing.

    The matrix is written once: a mean near the middle of two roundings hangs on the order in which its scores are added, so
    that old values from a second reading would not be those of the cells. Scores are rounded as the SQL does it: the millionfold
    to a whole number.
    """
    y = stash(matrix(s, d), "matrix")
    fix = y.where(F.substring(F.md5(F.concat("benchmark", "model")), 1, 1) == "0").select("benchmark", "model", F.col("score").alias("old"), (F.col("score") + 0.01).alias("new"))
    return B.all_corrected(y, fix).withColumn("score", F.round(F.col("score") * 1e6) / 1e6)


def jn11_mismatches(s, d):
    """What keeps corrections from being applied: old values that differ, and cells that aren't there. The matrix is written once, as above."""
    y = stash(matrix(s, d), "matrix")
    h = F.substring(F.md5(F.concat("benchmark", "model")), 1, 1)
    fix = y.where(h < "2").select("benchmark", F.when(h == "0", F.col("model")).otherwise(F.concat("model", F.lit("?"))).alias("model"), (F.col("score") + F.when(F.col("model") < "m", 0.01).otherwise(0.0)).alias("old"), F.lit(0.0).alias("new"))
    return B.corrected(y, fix)[1]


def jn14_variant_gap(s, d):
    """Score gap of the lite variant to its benchmark over at least three shared models."""
    y = matrix(s, d)
    lite = y.where("benchmark LIKE '%-lite'").select(F.regexp_replace("benchmark", "-lite$", "").alias("stem"), "model", F.col("score").alias("ls"))
    rest = y.where("benchmark NOT LIKE '%-lite'").withColumn("stem", F.regexp_replace("benchmark", "-(v2|pro|500|redux|multi)$", ""))
    return rest.join(lite, ["stem", "model"]).groupBy("benchmark", "stem").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ls") - F.col("score")), 6).alias("gap")).where("n >= 3")


def jn17_vendor_default(s, d):
    m = small(t(s, d, "models").select("id", "vendor"))
    r = t(s, d, "score_records").join(m, F.col("id") == F.col("model_id"), "left")
    return r.groupBy(F.coalesce("vendor", F.lit("Unknown")).alias("vendor")).agg(F.count(F.lit(1)).alias("n"))


def ag14_value_counts(s, d):
    return t(s, d, "score_records").groupBy(F.lower(F.trim("config")).alias("config")).agg(F.count(F.lit(1)).alias("n"))


def ag19_weighted_composite(s, d):
    """Composite of the four most scored benchmarks weighted by their number of cells, for models that have them all."""
    y = matrix(s, d)
    top = y.groupBy("benchmark").agg(F.count(F.lit(1)).alias("w")).orderBy(F.desc("w"), "benchmark").limit(4)
    g = y.join(F.broadcast(top), "benchmark").groupBy("model").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("composite"), F.count(F.lit(1)).alias("n"))
    return g.where("n = 4").select("model", F.round("composite", 4).alias("composite"))


def ag20_suite_score(s, d):
    y = matrix(s, d)
    top = y.groupBy("benchmark").agg(F.count(F.lit(1)).alias("w")).orderBy(F.desc("w"), "benchmark").limit(4).select("benchmark")
    return y.join(F.broadcast(top), "benchmark").groupBy("model").agg(F.avg("score").alias("x"), F.count(F.lit(1)).alias("n")).where("n = 4").select("model", F.round("x", 5).alias("expected"))


def ag22_coverage_by_category(s, d):
    b = t(s, d, "benchmarks").select(F.col("id").alias("benchmark"), "category")
    y = matrix(s, d).groupBy("benchmark").agg(F.count(F.lit(1)).alias("cells"))
    return b.join(y, "benchmark", "left").groupBy("category").agg(F.count(F.lit(1)).alias("benchmarks"), F.count_if(F.col("cells").isNull()).alias("orphans"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"))


def ag23_heat(s, d):
    return A.rounded(B.heat(matrix(s, d)), score=7, lo=7, hi=7, shade=7)


def ag24_contamination(s, d):
    """Scores in percent (ratings as they are); the pro edition of a benchmark is its hard variant."""
    b = t(s, d, "benchmarks").select(F.col("id").alias("benchmark"), "scale")
    y = matrix(s, d).join(small(b), "benchmark").select("benchmark", "model", F.when(F.col("scale") == "rating", F.col("score")).otherwise(F.round(F.col("score") * 100, 5)).alias("score"))
    hard = b.select("benchmark", F.concat("benchmark", F.lit("-pro")).alias("hard"))
    return A.rounded(B.contamination(y, hard), middle=6, top=6, hard_gap=6)


def ag25_tag_counts(s, d):
    return tag_weights(s, d).groupBy("tag").agg(F.count_distinct("benchmark").alias("benchmarks"))


def ag39_axis_means(s, d):
    return A.rounded(tag_weights(s, d).groupBy("tag").agg(F.avg("weight").alias("mean")), mean=6)


def ag42_progress(s, d):
    """Cells planned (those of model_split's models on benchmarks of bench_split, per run) that the run has a score for."""
    plan = t(s, d, "bench_split").select("run_id", "benchmark").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("b")).join(t(s, d, "model_split").select("run_id", "model").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("m")), "run_id")
    done = t(s, d, "scores").where(usable_score(F.col("score"))).select("run_id", "benchmark", "model").distinct()
    inside = done.join(t(s, d, "bench_split").select("run_id", "benchmark").distinct(), ["run_id", "benchmark"], "left_semi").join(t(s, d, "model_split").select("run_id", "model").distinct(), ["run_id", "model"], "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("done"))
    return plan.join(inside, "run_id", "left").select("run_id", (F.col("b") * F.col("m")).alias("planned"), F.coalesce("done", F.lit(0)).alias("done"))


def wn5_last_wins(s, d):
    return t(s, d, "scores").groupBy("run_id", "benchmark", "model").agg(F.max("loaded_at").alias("at"), F.count(F.lit(1)).alias("n")).select("run_id", "benchmark", "model", "n", F.unix_micros("at").alias("at"))


def wn7_chunks(s, d):
    """Greedy chunks of a source's documents in order: at most 8 documents and 10,000 characters, reset at each flush."""
    docs = t(s, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.coalesce(F.col("n_chars"), F.lit(0)).cast("bigint").alias("n"))
    return B.chunked(docs, "source", "doc_id", "n", 8, 10_000)


def wn9_item_index(s, d):
    from pyspark.sql import Window as W

    return t(s, d, "bench_split").select("run_id", "entry_id", (F.row_number().over(W.partitionBy("run_id").orderBy("entry_id")) - 1).alias("i"))


def tk7_relevance(s, d):
    return A.rounded(B.relevance(tag_weights(s, d), {"manual": 1.0, "tech_report": 0.5}), relevance=6)


def tk8_utility(s, d):
    return A.rounded(B.utility(tag_weights(s, d), ["manual", "github_repo"]), relevance=6, breadth=6, utility=6)


def tk10_model_fit(s, d):
    return A.rounded(B.model_fit(A.covered_profile(A.normalised(matrix(s, d)), tag_weights(s, d), "score_pct"), {"manual": 1.0, "tech_report": 0.5}, 10), fit=5)


def tk11_missing_last(s, d):
    """Places of each benchmark of the catalog by its best score, falling and rising; without a score last in both."""
    from pyspark.sql import Window as W

    y = matrix(s, d).groupBy(F.col("benchmark").alias("id")).agg(F.max("score").alias("top"))
    return t(s, d, "benchmarks").select("id").join(y, "id", "left").select("id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("top"), "id")).alias("place"), F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("top"), "id")).alias("rising"))


def tk16_surrogate(s, d):
    """Score of a model on a benchmark predicted from the three benchmarks nearest by tags, weighted by similarity."""
    y, near = matrix(s, d), A.top_neighbours(A.rounded(A.tag_similarity(tag_weights(s, d)).withColumnRenamed("s", "sim"), sim=8), "sim", 3)
    j = near.join(y.select(F.col("benchmark").alias("b"), "model", "score"), "b")
    p = j.groupBy(F.col("a").alias("benchmark"), "model").agg((F.sum(F.col("sim") * F.col("score")) / F.sum("sim")).alias("predicted"))
    return y.join(p, ["benchmark", "model"]).select("benchmark", "model", F.round("predicted", 5).alias("predicted"))


def tk17_related(s, d):
    """Tags by their strength: a weight as a share of the greatest that the tag has."""
    w = tag_weights(s, d)
    top = w.groupBy("tag").agg(F.max("weight").alias("top"))
    return B.related(w.join(small(top), "tag").select("benchmark", "tag", F.round(F.col("weight") / F.col("top"), 6).alias("weight")))


def st1_union(s, d):
    a = t(s, d, "bench_split").select("run_id", F.col("benchmark").alias("name"), F.lit("benchmark").alias("kind"))
    return a.unionByName(t(s, d, "model_split").select("run_id", F.col("model").alias("name"), F.lit("model").alias("kind"))).groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


def st2_intersection(s, d):
    return t(s, d, "scores").select("model").intersect(t(s, d, "model_split").select("model"))


def st3_difference(s, d):
    return t(s, d, "benchmarks").select("id").subtract(t(s, d, "bench_split").select(F.col("benchmark").alias("id")))


def st4_distinct(s, d):
    return t(s, d, "bench_split").select("run_id", "benchmark").distinct()


def st6_disjoint(s, d):
    """Benchmarks of a run that several entries put into different buckets."""
    return t(s, d, "bench_split").groupBy("run_id", "benchmark").agg(F.count_distinct(F.lower(F.trim("bucket"))).alias("buckets")).where("buckets > 1")


def st7_alias_union(s, d):
    m = t(s, d, "models").select("id", F.size(F.array_distinct(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name")))).alias("names"))
    return m


def sp1_ratio_split(s, d):
    return B.ratio_split(t(s, d, "benchmarks"), "id", {"train": 0.6, "dev": 0.2, "test": 0.2}, 7)


def sp3_stratified_folds(s, d):
    return B.folds(t(s, d, "benchmarks"), "id", "category", 5, 7)


def sp7_sampled_items(s, d):
    return B.sampled(t(s, d, "score_records").where("benchmark_id IS NOT NULL").select("benchmark_id", "record_id"), "benchmark_id", "record_id", 5, 3)


def cl1_tag_cover(s, d):
    return s.createDataFrame([(i, b) for i, b in enumerate(B.greedy_cover(tag_weights(s, d), 5), 1)], "place int, benchmark string")


def cl2_k_medoids(s, d):
    return s.createDataFrame([(b,) for b in B.k_medoids(tag_weights(s, d), 5)], "benchmark string")


def pj1_name_key(s, d):
    return t(s, d, "models").select("id", name_key(F.col("name")).alias("key"))


def pj10_percent(s, d):
    """Fractions as percent with one decimal, halves up."""
    return t(s, d, "score_records").where(usable_score(F.col("score"))).select("record_id", F.when((F.col("score") > 0) & (F.col("score") <= 1), half_up_tenth(F.round(F.col("score") * 100, 6))).otherwise(half_up_tenth(F.col("score"))).alias("percent"))


def pj11_published_day(s, d):
    return t(s, d, "score_records").select("record_id", publication_day(F.col("source.published")).cast("string").alias("day")).where("day IS NOT NULL")


def pj12_size_class(s, d):
    b = F.regexp_extract("id", r"-(\d+)b(?:-|$)", 1).try_cast("int")
    return t(s, d, "models").select("id", b.alias("params_b"), F.when(b <= 15, "small").when(b <= 72, "medium").when(b > 72, "large").otherwise("unknown").alias("size_class"))


def pj18_weight_level(s, d):
    return tag_weights(s, d).groupBy(weight_level(F.col("weight")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def pj21_unit_similarity(s, d):
    return pair_table(s, d).select("p", "q", F.round((F.col("r") + 1) / 2, 7).alias("r01"))


def pj32_source_host(s, d):
    host = F.regexp_replace(F.lower(F.regexp_extract("source.url", r"^[a-z]+://([^/]+)", 1)), r"^www\.", "")
    return t(s, d, "score_records").select(F.coalesce(F.nullif(host, F.lit("")), F.nullif(kind_key(F.col("source.kind")), F.lit("")), F.lit("none")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def pj34_display(s, d):
    c = F.col("score")
    return t(s, d, "score_records").where(usable_score(c)).select("record_id", F.when(c == F.floor(c), c.cast("bigint").cast("string")).when(c >= 100, F.format_string("%.1f", F.floor(c * 10 + 0.5 + 1e-9) / 10)).otherwise(F.format_string("%.2f", F.floor(c * 100 + 0.5 + 1e-9) / 100)).alias("shown"))


def fl1_filtered(s, d):
    """Benchmarks with at least ten models, and why the others fall out."""
    b = t(s, d, "benchmarks").select(F.col("id").alias("benchmark"), "note")
    n = matrix(s, d).groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"))
    why = reasons((F.coalesce("n", F.lit(0)) < 10, "few_models"), (F.coalesce(F.col("note").contains("deprecated"), F.lit(False)), "deprecated"))
    return b.join(n, "benchmark", "left").select("benchmark", F.coalesce("n", F.lit(0)).alias("n"), F.array_join(why, ",").alias("reasons"))


def fl18_provenance(s, d):
    """What is wrong with the source of a record."""
    src = F.col("source")
    why = reasons((src.isNull(), "no_source"), (src.isNotNull() & ~F.coalesce(src["url"].rlike(r"^https?://[^/\s]+\.[^/\s]+"), F.lit(False)), "bad_url"), (src.isNotNull() & publication_day(src["published"]).isNull(), "bad_date"))
    return t(s, d, "score_records").select(F.array_join(why, ",").alias("reasons")).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


def fl9_phrases(s, d):
    """Documents whose words contain a phrase, and how often without a negation in the four words before.

    Words stand with a blank on either side, so a phrase is a plain pattern and nothing is split.
    """
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "  "), F.lit(" "))
    w = t(s, d, "documents").select("doc_id", words.alias("w"))
    n, negated = F.regexp_count("w", F.lit(" on  the ")), F.regexp_count("w", F.lit(" (?:no|not|nobody|nothing) (?: [a-z0-9]+ ){0,3} on  the "))
    return w.select("doc_id", n.alias("n"), negated.alias("negated")).where("n > 0")


_HELP = {"scaled_fraction", "matrix", "pair_table", "tag_weights", "small", "stash", "t", "kind_key", "name_key", "publication_day", "usable_score", "half_up_tenth", "level_weight", "reasons", "weight_level"}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] != "_" and k not in _HELP}

_DAY = "coalesce(CASE WHEN regexp_full_match(x, '\\d{4}-\\d{2}-\\d{2}(T.*)?') THEN try_cast(x[:10] AS DATE) END, CASE WHEN regexp_full_match(x, '\\d{4}-\\d{2}') THEN try_cast(x || '-15' AS DATE) END, CASE WHEN regexp_full_match(x, '\\d{4}/\\d{2}/\\d{2}') THEN try_cast(replace(x, '/', '-') AS DATE) END, try_strptime(x, ['%Y%m%d', '%d %b %Y', '%B %d, %Y'])::DATE, try_strptime('15 ' || x, '%d %B %Y')::DATE)"
_OK = "score >= 0 AND NOT isnan(score)"
_TOP3 = "(SELECT benchmark FROM y GROUP BY 1 ORDER BY count(*) DESC, benchmark LIMIT 3)"

_SELECTS = {
    "mg6_trend_series": "SELECT benchmark, model, day::VARCHAR AS day, score FROM y JOIN (SELECT id, CASE WHEN length(release_date) = 7 THEN try_cast(release_date || '-15' AS DATE) ELSE try_cast(release_date AS DATE) END AS day FROM models) m ON m.id = model WHERE day IS NOT NULL QUALIFY count(*) OVER (PARTITION BY benchmark) >= 5",
    "mg7_model_scores": "SELECT model, category, count(*) AS n, round(avg(score), 8) AS mean FROM y JOIN benchmarks b ON b.id = benchmark GROUP BY 1, 2",
    "jn9_merged_sources": f"SELECT bk, mk, min(place) AS place, round(arg_min(score, place), 5) AS score FROM (SELECT regexp_replace(lower(benchmark), '[^a-z0-9]+', '', 'g') AS bk, regexp_replace(lower(model), '[^a-z0-9]+', '', 'g') AS mk, 1 AS place, score FROM y UNION ALL SELECT bk, mk, 2, max(score) FROM (SELECT regexp_replace(lower(benchmark_id), '[^a-z0-9]+', '', 'g') AS bk, regexp_replace(lower(model_id), '[^a-z0-9]+', '', 'g') AS mk, CASE WHEN score > 1 AND score <= 100 THEN score / 100 ELSE score END AS score FROM score_records WHERE {_OK}) WHERE bk <> '' AND mk <> '' AND score BETWEEN 0 AND 1 GROUP BY 1, 2) GROUP BY 1, 2",
    "jn10_exact_then_fuzzy": "SELECT benchmark_id, n, coalesce(b.id, k.id) AS matched FROM (SELECT benchmark_id, count(*) AS n FROM score_records WHERE benchmark_id IS NOT NULL GROUP BY 1) r LEFT JOIN benchmarks b ON b.id = benchmark_id LEFT JOIN (SELECT regexp_replace(lower(id), '[^a-z0-9]+', '', 'g') AS key, min(id) AS id FROM benchmarks GROUP BY 1) k ON k.key = regexp_replace(lower(benchmark_id), '[^a-z0-9]+', '', 'g')",
    "jn11_corrections": "SELECT benchmark, model, round(CASE WHEN md5(benchmark || model)[1] = '0' THEN score + 0.01 ELSE score END, 6) AS score, md5(benchmark || model)[1] = '0' AS corrected FROM y",
    "jn11_mismatches": "SELECT benchmark, CASE WHEN h = '0' THEN model ELSE model || '?' END AS model, CASE WHEN h = '1' THEN 'cell not found' ELSE 'another value' END AS reason FROM (SELECT *, md5(benchmark || model)[1] AS h FROM y) WHERE h = '1' OR (h = '0' AND model < 'm')",
    "jn14_variant_gap": "SELECT r.benchmark, r.stem, count(*) AS n, round(avg(l.score - r.score), 6) AS gap FROM (SELECT *, regexp_replace(benchmark, '-(v2|pro|500|redux|multi)$', '') AS stem FROM y WHERE benchmark NOT LIKE '%-lite') r JOIN (SELECT *, regexp_replace(benchmark, '-lite$', '') AS stem FROM y WHERE benchmark LIKE '%-lite') l ON l.stem = r.stem AND l.model = r.model GROUP BY 1, 2 HAVING count(*) >= 3",
    "jn17_vendor_default": "SELECT coalesce(vendor, 'Unknown') AS vendor, count(*) AS n FROM score_records LEFT JOIN models m ON m.id = model_id GROUP BY 1",
    "ag14_value_counts": "SELECT lower(trim(config)) AS config, count(*) AS n FROM score_records GROUP BY 1",
    "ag19_weighted_composite": "SELECT model, round(sum(score * w) / sum(w), 4) AS composite FROM y JOIN (SELECT benchmark, count(*) AS w FROM y GROUP BY 1 ORDER BY w DESC, benchmark LIMIT 4) t USING (benchmark) GROUP BY 1 HAVING count(*) = 4",
    "ag20_suite_score": "SELECT model, round(avg(score), 5) AS expected FROM y WHERE benchmark IN (FROM top4) GROUP BY 1 HAVING count(*) = 4",
    "ag22_coverage_by_category": "SELECT category, count(*) AS benchmarks, count(*) FILTER (cells IS NULL) AS orphans, coalesce(sum(cells), 0)::BIGINT AS cells FROM benchmarks b LEFT JOIN (SELECT benchmark, count(*) AS cells FROM y GROUP BY 1) c ON c.benchmark = b.id GROUP BY 1",
    "ag23_heat": "SELECT benchmark, model, round(score, 7) AS score, round(lo, 7) AS lo, round(hi, 7) AS hi, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END, 7) AS shade FROM (SELECT *, min(score) OVER (PARTITION BY benchmark) AS lo, max(score) OVER (PARTITION BY benchmark) AS hi FROM y)",
    "ag24_contamination": "SELECT p.benchmark, n, round(middle, 6) AS middle, round(top, 6) AS top, ceiling, n >= 5 AND ceiling >= 3 AND middle >= 0.85 * top AS saturated, h.hard, round(gap, 6) + 0.0 AS hard_gap, pairs AS hard_pairs, CASE WHEN (n >= 5 AND ceiling >= 3 AND middle >= 0.85 * top AND ceiling / n >= 0.3) OR coalesce(gap > 15, false) THEN 'high' WHEN ceiling >= 2 OR coalesce(gap > 8, false) THEN 'medium' ELSE 'low' END AS risk FROM (SELECT benchmark, count(*) AS n, median(score) AS middle, any_value(top) AS top, count(*) FILTER (top >= 50 AND score >= 0.95 * top) AS ceiling FROM (SELECT *, max(score) OVER (PARTITION BY benchmark) AS top FROM yp) GROUP BY 1 HAVING count(*) >= 3) p LEFT JOIN (SELECT a.benchmark, b.benchmark AS hard, avg(a.score - b.score) AS gap, count(*) AS pairs FROM yp a JOIN yp b ON b.benchmark = a.benchmark || '-pro' AND a.model = b.model GROUP BY 1, 2 HAVING count(*) >= 3) h ON h.benchmark = p.benchmark",
    "ag25_tag_counts": "SELECT tag, count(DISTINCT benchmark) AS benchmarks FROM tw GROUP BY 1",
    "ag39_axis_means": "SELECT tag, round(avg(weight), 6) AS mean FROM tw GROUP BY 1",
    "ag42_progress": f"SELECT run_id, b * m AS planned, coalesce(done, 0) AS done FROM (SELECT run_id, count(DISTINCT benchmark) AS b FROM bench_split GROUP BY 1) JOIN (SELECT run_id, count(DISTINCT model) AS m FROM model_split GROUP BY 1) USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS done FROM (SELECT DISTINCT run_id, benchmark, model FROM scores WHERE {_OK}) SEMI JOIN bench_split USING (run_id, benchmark) SEMI JOIN model_split USING (run_id, model) GROUP BY 1) USING (run_id)",
    "wn5_last_wins": "SELECT run_id, benchmark, model, count(*) AS n, epoch_us(max(loaded_at)) AS at FROM scores GROUP BY 1, 2, 3",
    "wn7_chunks": ", d AS MATERIALIZED (SELECT coalesce(source, '') AS source, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS i FROM documents) SELECT source, max(c)::BIGINT AS chunks, max(i)::BIGINT AS items FROM (WITH RECURSIVE w AS (SELECT source, i, 1 AS c, 1 AS k, n::BIGINT AS chars FROM d WHERE i = 1 UNION ALL SELECT w.source, d.i, CASE WHEN w.k >= 8 OR w.chars + d.n > 10000 THEN w.c + 1 ELSE w.c END, CASE WHEN w.k >= 8 OR w.chars + d.n > 10000 THEN 1 ELSE w.k + 1 END, CASE WHEN w.k >= 8 OR w.chars + d.n > 10000 THEN d.n ELSE w.chars + d.n END FROM w JOIN d ON d.source = w.source AND d.i = w.i + 1) SELECT * FROM w) GROUP BY 1",
    "wn9_item_index": "SELECT run_id, entry_id, row_number() OVER (PARTITION BY run_id ORDER BY entry_id) - 1 AS i FROM bench_split",
    "tk7_relevance": "SELECT benchmark, round(coalesce(dot / nullif(n * sqrt(1.25), 0), 0), 6) AS relevance FROM (SELECT benchmark, sum(weight * CASE tag WHEN 'manual' THEN 1 WHEN 'tech_report' THEN 0.5 ELSE 0 END) AS dot, sqrt(sum(weight * weight)) AS n FROM tw GROUP BY 1)",
    "tk8_utility": "SELECT benchmark, round(relevance, 6) AS relevance, round(breadth, 6) AS breadth, round(0.72 * relevance + 0.2 * breadth, 6) AS utility FROM (SELECT benchmark, coalesce(sum(weight) FILTER (tag IN ('manual', 'github_repo')), 0) / 2 AS relevance, count(*) FILTER (weight >= 0.5) / (SELECT count(DISTINCT tag) FROM tw) AS breadth FROM tw GROUP BY 1) WHERE 0.72 * relevance + 0.2 * breadth > 0.05",
    "tk10_model_fit": "SELECT model, round(fit, 5) AS fit FROM (SELECT model, sum(w * weight) / 1.5 AS fit FROM (SELECT model, tag, sum(score_pct * weight) / sum(weight) AS weight, CASE tag WHEN 'manual' THEN 1 WHEN 'tech_report' THEN 0.5 END AS w FROM ns JOIN tw USING (benchmark) WHERE weight <> 0 GROUP BY 1, 2) WHERE w IS NOT NULL GROUP BY 1) ORDER BY fit DESC, model LIMIT 10",
    "tk11_missing_last": "SELECT id, row_number() OVER (ORDER BY top DESC NULLS LAST, id) AS place, row_number() OVER (ORDER BY top NULLS LAST, id) AS rising FROM benchmarks LEFT JOIN (SELECT benchmark, max(score) AS top FROM y GROUP BY 1) t ON t.benchmark = id",
    "tk16_surrogate": "SELECT benchmark, model, round(predicted, 5) AS predicted FROM y JOIN (SELECT a AS benchmark, model, sum(sim * score) / sum(sim) AS predicted FROM (SELECT a, b, sim FROM (SELECT p AS a, q AS b, round(s, 8) AS sim FROM ts UNION ALL SELECT q, p, round(s, 8) FROM ts) QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 3) n JOIN y ON y.benchmark = n.b GROUP BY 1, 2) z USING (benchmark, model)",
    "tk17_related": "SELECT tag, benchmark, row_number() OVER (PARTITION BY tag ORDER BY weight DESC, benchmark) AS place FROM (SELECT tag, benchmark, round(weight / max(weight) OVER (PARTITION BY tag), 6) AS weight FROM tw) WHERE weight >= 0.75 QUALIFY place <= 6",
    "st1_union": "SELECT run_id, kind, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT run_id, benchmark AS name, 'benchmark' AS kind FROM bench_split UNION ALL SELECT run_id, model, 'model' FROM model_split) GROUP BY 1, 2",
    "st2_intersection": "SELECT model FROM scores INTERSECT SELECT model FROM model_split",
    "st3_difference": "SELECT id FROM benchmarks EXCEPT SELECT benchmark FROM bench_split",
    "st4_distinct": "SELECT DISTINCT run_id, benchmark FROM bench_split",
    "st6_disjoint": "SELECT run_id, benchmark, count(DISTINCT lower(trim(bucket))) AS buckets FROM bench_split GROUP BY 1, 2 HAVING buckets > 1",
    "st7_alias_union": "SELECT id, len(list_distinct(list_append(coalesce(aliases, []), name))) AS names FROM models",
    "sp1_ratio_split": "SELECT id, CASE WHEN i <= round(n * 0.6) THEN 'train' WHEN i <= round(n * 0.8) THEN 'dev' ELSE 'test' END AS bucket FROM (SELECT id, row_number() OVER (ORDER BY md5('7|' || id), id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM benchmarks))",
    "sp3_stratified_folds": "SELECT id, category, ((row_number() OVER (PARTITION BY category ORDER BY md5('7|' || id), id) - 1 + ('0x' || md5('7|' || coalesce(category, ''))[:4])::INT) % 5)::INT AS fold FROM benchmarks",
    "sp7_sampled_items": "SELECT benchmark_id, record_id FROM score_records WHERE benchmark_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY benchmark_id ORDER BY md5('3|' || record_id), record_id) <= 5",
    "pj1_name_key": "SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key FROM models",
    "pj10_percent": f"SELECT record_id, CASE WHEN score > 0 AND score <= 1 THEN floor(round(score * 100, 6) * 10 + 0.5) / 10 ELSE floor(score * 10 + 0.5) / 10 END AS percent FROM score_records WHERE {_OK}",
    "pj11_published_day": f"SELECT record_id, day::VARCHAR AS day FROM (SELECT record_id, {_DAY} AS day FROM (SELECT record_id, trim(source.published) AS x FROM score_records)) WHERE day IS NOT NULL",
    "pj12_size_class": "SELECT id, b AS params_b, CASE WHEN b <= 15 THEN 'small' WHEN b <= 72 THEN 'medium' WHEN b > 72 THEN 'large' ELSE 'unknown' END AS size_class FROM (SELECT id, try_cast(regexp_extract(id, '-(\\d+)b(?:-|$)', 1) AS INT) AS b FROM models)",
    "pj18_weight_level": "SELECT CASE WHEN weight >= 0.875 THEN 'dominant' WHEN weight >= 0.625 THEN 'strong' WHEN weight >= 0.375 THEN 'medium' WHEN weight >= 0.125 THEN 'weak' ELSE 'absent' END AS level, count(*) AS n FROM tw GROUP BY 1",
    "pj21_unit_similarity": "SELECT p, q, round((r + 1) / 2, 7) AS r01 FROM pt",
    "pj32_source_host": "SELECT coalesce(nullif(regexp_replace(lower(regexp_extract(source.url, '^[a-z]+://([^/]+)', 1)), '^www\\.', ''), ''), nullif(regexp_replace(lower(trim(source.kind)), '[ _-]+', '_', 'g'), ''), 'none') AS label, count(*) AS n FROM score_records GROUP BY 1",
    "pj34_display": f"SELECT record_id, CASE WHEN score = floor(score) THEN score::BIGINT::VARCHAR WHEN score >= 100 THEN printf('%.1f', floor(score * 10 + 0.5 + 1e-9) / 10) ELSE printf('%.2f', floor(score * 100 + 0.5 + 1e-9) / 100) END AS shown FROM score_records WHERE {_OK}",
    "fl1_filtered": "SELECT b.id AS benchmark, coalesce(n, 0) AS n, concat_ws(',', CASE WHEN coalesce(n, 0) < 10 THEN 'few_models' END, CASE WHEN contains(note, 'deprecated') THEN 'deprecated' END) AS reasons FROM benchmarks b LEFT JOIN (SELECT benchmark, count(*) AS n FROM y GROUP BY 1) c ON c.benchmark = b.id",
    "fl9_phrases": "SELECT doc_id, len(regexp_extract_all(w, ' on  the ')) AS n, len(regexp_extract_all(w, ' (?:no|not|nobody|nothing) (?: [a-z0-9]+ ){0,3} on  the ')) AS negated FROM (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', '  ', 'g') || ' ' AS w FROM documents) WHERE contains(w, ' on  the ')",
    "fl18_provenance": f"SELECT concat_ws(',', CASE WHEN source IS NULL THEN 'no_source' END, CASE WHEN source IS NOT NULL AND NOT coalesce(regexp_matches(source.url, '^https?://[^/\\s]+\\.[^/\\s]+'), false) THEN 'bad_url' END, CASE WHEN source IS NOT NULL AND day IS NULL THEN 'bad_date' END) AS reasons, count(*) AS n FROM (SELECT source, {_DAY} AS day FROM (SELECT source, trim(source.published) AS x FROM score_records)) GROUP BY 1",
}
_PERCENT = "yp AS (SELECT benchmark, model, CASE WHEN scale = 'rating' THEN score ELSE round(score * 100, 5) END AS score FROM y JOIN benchmarks b ON b.id = benchmark)"
SQL = {k: f"WITH {BASE}, {_PERCENT} {v}" for k, v in _SELECTS.items()}
