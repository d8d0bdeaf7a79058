"""Queries of the alignment operators over the score matrix of ``scores`` and tag weights from ``score_records``.

The matrix Y is the mean usable score of each benchmark and model over the runs; the weight of a tag (a kind of source)
is its share among the records of a benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.cleaning import kind_key
from rankloom.functions.semantics import reasons, vector_cosine
from rankloom.operators import align as A
from rankloom.operators.hotdeck import usable_matrix_score
from rankloom.runtime import small, stash
from rankloom.runtime import table as t


def matrix(s: SparkSession, d: str) -> DataFrame:
    b = t(s, d, "benchmarks").select(F.col("id").alias("benchmark"), "scale")
    ok = usable_matrix_score(F.col("score"), F.coalesce(F.col("scale") == "rating", F.lit(False)))
    return t(s, d, "scores").join(small(b), "benchmark").where(ok).groupBy("benchmark", "model").agg(F.round(F.avg("score"), 7).alias("score"))


def tag_weights(s: SparkSession, d: str) -> DataFrame:
    b = t(s, d, "benchmarks").select(F.col("id").alias("benchmark_id"))
    r = t(s, d, "score_records").join(small(b), "benchmark_id").groupBy(F.col("benchmark_id").alias("benchmark"), F.coalesce(F.nullif(kind_key(F.col("source.kind")), F.lit("")), F.lit("none")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    whole = r.groupBy("benchmark").agg(F.sum("n").alias("all"))
    return r.join(whole, "benchmark").select("benchmark", "tag", F.round(F.col("n") / F.col("all"), 6).alias("weight"))


def pair_table(s: SparkSession, d: str) -> DataFrame:
    """Pairs with six decimals, so that thresholds and ties don't hang on the order of a sum.

    Written once, as most queries use the table several times; it is bounded by the benchmark catalog.
    """
    return stash(A.rounded(A.aligned(A.tag_similarity(tag_weights(s, d)), A.rank_similarity(matrix(s, d), 4)), s=6, r=6, r01=7), "pairs")


def buckets(s: SparkSession, d: str) -> DataFrame:
    """A split of the catalog by hash: the benchmarks' order by md5 is the same in every engine."""
    h = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 10
    return t(s, d, "benchmarks").select(F.col("id").alias("benchmark"), F.when(h < 6, "train").when(h < 8, "dev").otherwise("test").alias("bucket"))


def wn1_average_rank(s, d):
    return A.rounded(matrix(s, d).select("benchmark", "model", A.average_rank("score", "benchmark").alias("rank0")), rank0=6)


def wn2_normalised(s, d):
    return A.rounded(A.normalised(matrix(s, d)).select("benchmark", "model", "score_rank", "score_z"), score_rank=6, score_z=5)


def wn3_percentile(s, d):
    return A.rounded(A.normalised(matrix(s, d)).select("benchmark", "model", "score_pct"), score_pct=6)


def jn1_common_scores(s, d):
    return A.common_scores(matrix(s, d)).groupBy("p", "q").agg(F.count(F.lit(1)).alias("common_count"), F.sum(F.floor(F.col("x") * 10000 + 0.000001) * F.floor(F.col("y") * 10000 + 0.000001)).cast("bigint").alias("dot"))


def jn2_all_pairs(s, d):
    y = matrix(s, d)
    return A.rounded(A.all_pairs(y, A.rank_similarity(y, 6)), r=6)


def jn3_aligned(s, d):
    return pair_table(s, d).select("p", "q", "s", "r")


def jn4_pair_diagnostics(s, d):
    return pair_table(s, d).select("p", "q", "s", "r", "common_count", F.round(F.abs(F.col("s") - F.col("r")), 6).alias("residual"))


def jn5_profile(s, d):
    return A.rounded(A.profiles(matrix(s, d), tag_weights(s, d), "score"), weight=5)


def jn6_restricted(s, d):
    keep = pair_table(s, d).where("common_count >= 5").select("p", "q")
    return A.rounded(A.tag_similarity(tag_weights(s, d)).join(keep, ["p", "q"], "left_semi"), s=6)


def jn7_same_bucket(s, d):
    return A.within_buckets(pair_table(s, d), buckets(s, d)).select("p", "q", "bucket")


def jn8_involving(s, d):
    return A.involving(pair_table(s, d).select("p", "q"), buckets(s, d).where("bucket = 'test'"))


def jn13_full_coverage(s, d):
    """Models that every benchmark of the most scored four has."""
    y = matrix(s, d)
    top = y.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "benchmark").limit(4).select("benchmark")
    return y.join(F.broadcast(top), "benchmark").groupBy("model").agg(F.count_distinct("benchmark").alias("n")).where("n = 4").select("model")


def jn15_missing_cells(s, d):
    return A.missing_cells(matrix(s, d))


def ag1_rank_similarity(s, d):
    return A.rounded(A.rank_similarity(matrix(s, d), 4), r=6)


def ag2_dense_cosine(s, d):
    """Cosine of each label's mean vector with the next label's, from dense vectors."""
    e = t(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("v"))
    a, b = c.select(F.col("label").alias("la"), F.col("v").alias("va")), c.select(F.col("label").alias("lb"), F.col("v").alias("vb"))
    return a.join(b, F.col("lb") == F.col("la") + 1).select("la", "lb", F.round(vector_cosine(F.col("va"), F.col("vb")), 5).alias("s"))


def ag3_tag_similarity(s, d):
    return A.rounded(A.tag_similarity(tag_weights(s, d)), s=6)


def ag4_alignment_loss(s, d):
    return A.rounded(A.alignment_loss(pair_table(s, d)), l_align=6, l_align_01=6)


def ag5_alignment_correlation(s, d):
    return A.rounded(A.alignment_correlation(pair_table(s, d)), rho_p=6, rho_s=6)


def ag6_thresholds(s, d):
    return A.rounded(A.thresholds(pair_table(s, d)), theta_n=6, theta_p=6)


def ag7_intra_inter_gap(s, d):
    return A.rounded(A.tag_gap(pair_table(s, d)), intra=6, inter=6, delta_tag=6)


def ag8_point_metrics(s, d):
    p = pair_table(s, d)
    j = A.alignment_loss(p).join(F.broadcast(A.alignment_correlation(p).drop("n_pairs"))).join(F.broadcast(A.tag_gap(p).select("delta_tag")))
    return A.rounded(j, l_align=6, l_align_01=6, rho_p=6, rho_s=6, delta_tag=6)


def ag9_split_metrics(s, d):
    return A.rounded(A.bucket_metrics(pair_table(s, d), buckets(s, d)), l_align=6)


def ag10_held_models(s, d):
    """Metrics of the buckets from the models in the upper half of the hash order only, and why a bucket has none."""
    held = matrix(s, d).where(F.substring(F.md5("model"), 1, 1) >= "8")
    p = A.rounded(A.aligned(A.tag_similarity(tag_weights(s, d)), A.rank_similarity(held, 8)), s=6, r=6, r01=7)
    m = A.rounded(A.bucket_metrics(p, buckets(s, d)), l_align=6)
    return m.withColumn("skipped", F.when(F.col("benchmarks") < 2, "too_few_benchmarks").when(F.col("n_pairs") == 0, "no_valid_pairs"))


def ag16_relative_profile(s, d):
    return A.rounded(A.profiles(A.normalised(matrix(s, d)), tag_weights(s, d), "score_rank"), weight=5)


def ag17_covered_profile(s, d):
    return A.rounded(A.covered_profile(A.normalised(matrix(s, d)), tag_weights(s, d), "score_pct"), weight=4)


def ag18_min_max_ranking(s, d):
    y = matrix(s, d)
    top = y.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "benchmark").limit(4).select("benchmark")
    return A.rounded(A.min_max_ranking(y.join(F.broadcast(top), "benchmark")), score=6)


def ag21_coverage(s, d):
    return A.rounded(A.coverage(matrix(s, d)), density=6)


def ag26_models_per_benchmark(s, d):
    return t(s, d, "scores").groupBy("benchmark").agg(F.count_distinct("model").alias("models"))


def ag32_trend(s, d):
    o = t(s, d, "orders").select("o_orderpriority", F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("x"), F.col("o_totalprice").cast("double").alias("y"))
    return A.rounded(A.trend(o, "o_orderpriority", "x", "y"), slope=4, intercept=2)


def ag34_split_counts(s, d):
    """Of each bucket: pairs that have the models for a correlation, pairs that have one, benchmarks in them, and what falls short of 10 pairs and 6 benchmarks."""
    m = A.bucket_metrics(pair_table(s, d), buckets(s, d)).select("bucket", "n_pairs", "effective")
    c = A.within_buckets(A.common_counts(matrix(s, d)), buckets(s, d)).where("common_count >= 4").groupBy("bucket").agg(F.count(F.lit(1)).alias("coverage_pairs"))
    why = reasons((F.col("n_pairs") < 10, "pairs"), (F.col("effective") < 6, "benchmarks"))
    return m.join(c, "bucket", "left").select("bucket", F.coalesce("coverage_pairs", F.lit(0)).alias("coverage_pairs"), "n_pairs", "effective", F.array_join(why, ",").alias("failures"))


def ag41_error_modes(s, d):
    """How often each error occurs, and whether it is the one that dominates (neither does on a tie)."""
    g = A.flagged_pairs(pair_table(s, d)).agg(F.count_if(F.col("kind") == "false_sim").alias("false_sim"), F.count_if(F.col("kind") == "false_dis").alias("false_dis"))
    return g.withColumn("dominant", F.when(F.col("false_sim") > F.col("false_dis"), "false_sim").when(F.col("false_sim") < F.col("false_dis"), "false_dis").when(F.col("false_sim") == 0, "none").otherwise("mixed"))


def tk1_error_report(s, d):
    return A.rounded(A.error_report(pair_table(s, d), 20), gap=6)


def tk2_residual_report(s, d):
    return A.rounded(A.residual_report(pair_table(s, d), 20), residual=6)


def tk3_protected_pairs(s, d):
    return A.rounded(A.protected_pairs(pair_table(s, d), 0.5, 20), residual=6)


def tk4_positive_objective(s, d):
    return A.rounded(A.positive_objective(pair_table(s, d)), score=6, loss=6)


def tk5_recall_at_k(s, d):
    return A.rounded(A.recall_at_k(pair_table(s, d), 3), recall=6)


def tk6_retrieval_report(s, d):
    return A.rounded(A.retrieval_report(pair_table(s, d), 3), top_mean=5, all_mean=5)


def wn4_top_neighbours(s, d):
    return A.top_neighbours(pair_table(s, d), "s", 3).select("a", "b", "place")


_NOT = {"DataFrame", "matrix", "tag_weights", "pair_table", "buckets", "small", "stash", "t", "kind_key", "reasons", "vector_cosine", "usable_matrix_score", "SparkSession"}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] != "_" and k not in _NOT}

BASE = """
y AS (
  SELECT s.benchmark, s.model, round(avg(s.score), 7) AS score FROM scores s JOIN benchmarks b ON b.id = s.benchmark
  WHERE NOT isnan(s.score) AND CASE WHEN b.scale = 'rating' THEN s.score > 0 AND s.score < 3000 ELSE s.score >= 0 AND s.score <= 1 END GROUP BY 1, 2
), kinds AS (
  SELECT benchmark_id AS benchmark, coalesce(nullif(regexp_replace(lower(trim(source.kind)), '[ _-]+', '_', 'g'), ''), 'none') AS tag, count(*) AS n
  FROM score_records WHERE benchmark_id IN (SELECT id FROM benchmarks) GROUP BY 1, 2
), tw AS (
  SELECT benchmark, tag, round(n / sum(n) OVER (PARTITION BY benchmark), 6) AS weight FROM kinds
), cs AS (
  SELECT a.benchmark AS p, b.benchmark AS q, a.model, a.score AS x, b.score AS y FROM y a JOIN y b ON a.model = b.model AND a.benchmark < b.benchmark
), ranked AS (
  SELECT p, q, rank() OVER (PARTITION BY p, q ORDER BY x) - 1 + (count(*) OVER (PARTITION BY p, q, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY p, q ORDER BY y) - 1 + (count(*) OVER (PARTITION BY p, q, y) - 1) / 2.0 AS ry FROM cs
), rs AS (
  SELECT p, q, count(*) AS common_count, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS r FROM ranked GROUP BY 1, 2
), n2 AS (
  SELECT benchmark, sum(weight * weight) AS n2 FROM tw WHERE weight <> 0 GROUP BY 1
), ts AS (
  SELECT p, q, dot / (sqrt(a.n2) * sqrt(b.n2)) AS s FROM (
    SELECT a.benchmark AS p, b.benchmark AS q, sum(a.weight * b.weight) AS dot FROM tw a JOIN tw b ON a.tag = b.tag AND a.benchmark < b.benchmark GROUP BY 1, 2) z
  JOIN n2 a ON a.benchmark = p JOIN n2 b ON b.benchmark = q
), pt AS (
  SELECT p, q, round(s, 6) AS s, round(r, 6) + 0.0 AS r, round((r + 1) / 2, 7) AS r01, common_count FROM ts JOIN rs USING (p, q) WHERE common_count >= 4 AND r IS NOT NULL
), bk AS (
  SELECT id AS benchmark, CASE WHEN h < 6 THEN 'train' WHEN h < 8 THEN 'dev' ELSE 'test' END AS bucket FROM (SELECT id, ('0x' || md5(id)[:4])::INT % 10 AS h FROM benchmarks)
), nrm AS (
  SELECT benchmark, model, score, count(*) OVER (PARTITION BY benchmark) AS n, avg(score) OVER (PARTITION BY benchmark) AS m, stddev_pop(score) OVER (PARTITION BY benchmark) AS sd,
    rank() OVER (PARTITION BY benchmark ORDER BY score) - 1 + (count(*) OVER (PARTITION BY benchmark, score) - 1) / 2.0 AS rk FROM y
), ns AS (
  SELECT benchmark, model, score, rk, CASE WHEN n = 1 THEN 0.5 ELSE rk / (n - 1) END AS score_rank, rk / greatest(n - 1, 1) AS score_pct, CASE WHEN sd > 0 THEN (score - m) / sd ELSE 0 END AS score_z FROM nrm
), top4 AS (
  SELECT benchmark FROM y GROUP BY 1 ORDER BY count(*) DESC, benchmark LIMIT 4
), th AS (
  SELECT quantile_cont(s, 0.3) AS theta_n, quantile_cont(s, 0.7) AS theta_p FROM pt
), sym AS (
  SELECT p AS a, q AS b, s, r FROM pt UNION ALL SELECT q, p, s, r FROM pt
), er AS (
  SELECT p, q, abs(s - r01) AS gap, CASE WHEN s >= sh AND r01 <= rl THEN 'false_sim' WHEN s <= sl AND r01 >= rh THEN 'false_dis' END AS kind
  FROM pt, (SELECT quantile_cont(s, 0.2) AS sl, quantile_cont(s, 0.8) AS sh, quantile_cont(r01, 0.2) AS rl, quantile_cont(r01, 0.8) AS rh FROM pt)
)
"""

_RHO = "CASE WHEN stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"
_BUCKETS = """
SELECT k.bucket, coalesce(n_pairs, 0) AS n_pairs, round(l_align, 6) AS l_align, benchmarks, coalesce(effective, 0) AS effective, benchmarks - coalesce(effective, 0) AS isolated
FROM (SELECT bucket, count(*) AS benchmarks FROM bk GROUP BY 1) k
LEFT JOIN (SELECT a.bucket, count(*) AS n_pairs, avg((s - r) ** 2) AS l_align FROM {0} pt JOIN bk a ON a.benchmark = p JOIN bk b ON b.benchmark = q AND a.bucket = b.bucket GROUP BY 1) l ON l.bucket = k.bucket
LEFT JOIN (SELECT a.bucket, count(DISTINCT e) AS effective FROM (SELECT p, q, unnest([p, q]) AS e FROM {0}) pt JOIN bk a ON a.benchmark = p JOIN bk b ON b.benchmark = q AND a.bucket = b.bucket GROUP BY 1) f ON f.bucket = k.bucket
"""

_SELECTS = {
    "wn1_average_rank": "SELECT benchmark, model, round(rk, 6) AS rank0 FROM ns",
    "wn2_normalised": "SELECT benchmark, model, round(score_rank, 6) AS score_rank, round(score_z, 5) AS score_z FROM ns",
    "wn3_percentile": "SELECT benchmark, model, round(score_pct, 6) AS score_pct FROM ns",
    "jn1_common_scores": "SELECT p, q, count(*) AS common_count, sum(floor(x * 10000 + 0.000001)::BIGINT * floor(y * 10000 + 0.000001)::BIGINT)::BIGINT AS dot FROM cs GROUP BY 1, 2",
    "jn2_all_pairs": "SELECT a.benchmark AS p, b.benchmark AS q, coalesce(common_count, 0) AS common_count, CASE WHEN common_count >= 6 THEN round(r, 6) + 0.0 END AS r FROM (SELECT DISTINCT benchmark FROM y) a JOIN (SELECT DISTINCT benchmark FROM y) b ON a.benchmark < b.benchmark LEFT JOIN rs ON rs.p = a.benchmark AND rs.q = b.benchmark",
    "jn3_aligned": "SELECT p, q, s, r FROM pt",
    "jn4_pair_diagnostics": "SELECT p, q, s, r, common_count, round(abs(s - r), 6) AS residual FROM pt",
    "jn5_profile": "SELECT model, tag, round(sum(score * weight), 5) AS weight FROM y JOIN tw USING (benchmark) GROUP BY 1, 2",
    "jn6_restricted": "SELECT p, q, round(s, 6) AS s FROM ts SEMI JOIN (SELECT p, q FROM pt WHERE common_count >= 5) USING (p, q)",
    "jn7_same_bucket": "SELECT p, q, a.bucket FROM pt JOIN bk a ON a.benchmark = p JOIN bk b ON b.benchmark = q AND a.bucket = b.bucket",
    "jn8_involving": "SELECT p, q FROM pt WHERE p IN (SELECT benchmark FROM bk WHERE bucket = 'test') OR q IN (SELECT benchmark FROM bk WHERE bucket = 'test')",
    "jn13_full_coverage": "SELECT model FROM y WHERE benchmark IN (FROM top4) GROUP BY 1 HAVING count(*) = 4",
    "jn15_missing_cells": "SELECT benchmark, model FROM (SELECT DISTINCT benchmark FROM y), (SELECT DISTINCT model FROM y) EXCEPT SELECT benchmark, model FROM y",
    "ag1_rank_similarity": "SELECT p, q, common_count, CASE WHEN common_count >= 4 THEN round(r, 6) + 0.0 END AS r FROM rs",
    "ag3_tag_similarity": "SELECT p, q, round(s, 6) AS s FROM ts",
    "ag4_alignment_loss": "SELECT round(avg((s - r) ** 2), 6) AS l_align, round(avg((s - r01) ** 2), 6) AS l_align_01, count(*) AS n_pairs FROM pt",
    "ag5_alignment_correlation": f"SELECT count(*) AS n_pairs, round({_RHO.format('s', 'r')}, 6) AS rho_p, round({_RHO.format('a', 'b')}, 6) AS rho_s FROM (SELECT s, r, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS a, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS b FROM pt)",
    "ag6_thresholds": "SELECT round(theta_n, 6) AS theta_n, round(theta_p, 6) AS theta_p FROM th",
    "ag7_intra_inter_gap": "SELECT round(a, 6) AS intra, round(b, 6) AS inter, n_pos, n_neg, round(a - b, 6) AS delta_tag FROM (SELECT avg(r) FILTER (s >= theta_p) AS a, avg(r) FILTER (s <= theta_n) AS b, count(*) FILTER (s >= theta_p) AS n_pos, count(*) FILTER (s <= theta_n) AS n_neg FROM pt, th)",
    "ag8_point_metrics": f"SELECT l_align, l_align_01, n_pairs, rho_p, rho_s, delta_tag FROM (SELECT round(avg((s - r) ** 2), 6) AS l_align, round(avg((s - r01) ** 2), 6) AS l_align_01, count(*) AS n_pairs FROM pt), (SELECT round({_RHO.format('s', 'r')}, 6) AS rho_p, round({_RHO.format('a', 'b')}, 6) AS rho_s FROM (SELECT s, r, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS a, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS b FROM pt)), (SELECT round(avg(r) FILTER (s >= theta_p) - avg(r) FILTER (s <= theta_n), 6) AS delta_tag FROM pt, th)",
    "ag9_split_metrics": _BUCKETS.format("pt"),
    "ag16_relative_profile": "SELECT model, tag, round(sum(score_rank * weight), 5) AS weight FROM ns JOIN tw USING (benchmark) GROUP BY 1, 2",
    "ag17_covered_profile": "SELECT model, tag, round(sum(score_pct * weight) / sum(weight), 4) AS weight FROM ns JOIN tw USING (benchmark) WHERE weight <> 0 GROUP BY 1, 2",
    "ag18_min_max_ranking": "SELECT model, round(avg(v), 6) AS score FROM (SELECT model, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END AS v FROM y WHERE benchmark IN (FROM top4) WINDOW w AS (PARTITION BY benchmark)) GROUP BY 1 HAVING count(*) = 4",
    "ag21_coverage": "SELECT cells, benchmarks, models, round(cells / (benchmarks * models), 6) AS density, least, middle, most FROM (SELECT count(*) AS cells, count(DISTINCT benchmark) AS benchmarks, count(DISTINCT model) AS models FROM y), (SELECT min(k) AS least, median(k) AS middle, max(k) AS most FROM (SELECT count(*) AS k FROM y GROUP BY benchmark))",
    "ag26_models_per_benchmark": "SELECT benchmark, count(DISTINCT model) AS models FROM scores GROUP BY 1",
    "ag32_trend": "SELECT o_orderpriority, n, round(b, 4) AS slope, round(my - b * mx, 2) AS intercept, x0, x1 FROM (SELECT o_orderpriority, count(*) AS n, covar_pop(x, y) / var_pop(x) AS b, avg(x) AS mx, avg(y) AS my, min(x) AS x0, max(x) AS x1 FROM (SELECT o_orderpriority, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS x, o_totalprice::DOUBLE AS y FROM orders) GROUP BY 1)",
    "ag10_held_models": "SELECT *, CASE WHEN benchmarks < 2 THEN 'too_few_benchmarks' WHEN n_pairs = 0 THEN 'no_valid_pairs' END AS skipped FROM (" + _BUCKETS.format("(SELECT p, q, round(s, 6) AS s, round(r, 6) AS r FROM ts JOIN (SELECT p, q, count(*) AS common_count, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS r FROM (SELECT p, q, rank() OVER (PARTITION BY p, q ORDER BY x) + (count(*) OVER (PARTITION BY p, q, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY p, q ORDER BY y) + (count(*) OVER (PARTITION BY p, q, y) - 1) / 2.0 AS ry FROM cs WHERE md5(model)[1] >= '8') GROUP BY 1, 2) USING (p, q) WHERE common_count >= 8 AND r IS NOT NULL)") + ")",
    "ag34_split_counts": f"SELECT m.bucket, coalesce(coverage_pairs, 0) AS coverage_pairs, n_pairs, effective, concat_ws(',', CASE WHEN n_pairs < 10 THEN 'pairs' END, CASE WHEN effective < 6 THEN 'benchmarks' END) AS failures FROM ({_BUCKETS.format('pt')}) m LEFT JOIN (SELECT a.bucket, count(*) AS coverage_pairs FROM (SELECT p, q FROM cs GROUP BY 1, 2 HAVING count(*) >= 4) c JOIN bk a ON a.benchmark = p JOIN bk b ON b.benchmark = q AND a.bucket = b.bucket GROUP BY 1) c ON c.bucket = m.bucket",
    "ag41_error_modes": "SELECT s AS false_sim, d AS false_dis, CASE WHEN s > d THEN 'false_sim' WHEN s < d THEN 'false_dis' WHEN s = 0 THEN 'none' ELSE 'mixed' END AS dominant FROM (SELECT count(*) FILTER (kind = 'false_sim') AS s, count(*) FILTER (kind = 'false_dis') AS d FROM er)",
    "ag2_dense_cosine": "SELECT la, lb, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 5) AS s FROM (WITH c AS (SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) SELECT a.label AS la, b.label AS lb, a.x AS a, b.x AS b FROM c a JOIN c b ON b.label = a.label + 1 AND a.i = b.i) GROUP BY 1, 2",
    "tk1_error_report": "SELECT p, q, kind, round(gap, 6) AS gap FROM er WHERE kind IS NOT NULL ORDER BY er.gap DESC, p, q LIMIT 20",
    "tk2_residual_report": "SELECT p, q, round(abs(s - r), 6) AS residual, CASE WHEN s > r THEN 'over' WHEN s < r THEN 'under' ELSE 'even' END AS direction FROM pt ORDER BY abs(s - r) DESC, p, q LIMIT 20",
    "tk3_protected_pairs": "SELECT p, q, r, round(abs(s - r), 6) AS residual FROM pt WHERE r >= 0.5 ORDER BY r DESC, abs(s - r), p, q LIMIT 20",
    "tk4_positive_objective": "SELECT count(*) AS n_top, round(avg(r), 6) AS score, round(1 - (avg(r) + 1) / 2, 6) AS loss FROM (SELECT r, row_number() OVER (ORDER BY s DESC, p, q) AS i, count(*) OVER () AS n FROM pt) WHERE i <= greatest(1, ceil(n * 0.2))",
    "tk5_recall_at_k": "SELECT a, round(count(r.b) / 3, 6) AS recall FROM (SELECT a, b FROM sym QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 3) s LEFT JOIN (SELECT a, b FROM sym QUALIFY row_number() OVER (PARTITION BY a ORDER BY r DESC, b) <= 3) r USING (a, b) WHERE a IN (SELECT a FROM sym GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1",
    "tk6_retrieval_report": "SELECT a, round(avg(r) FILTER (i <= 3), 5) AS top_mean, round(avg(r), 5) AS all_mean FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b DESC) AS i FROM sym) GROUP BY 1",
    "wn4_top_neighbours": "SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM sym QUALIFY place <= 3",
}
SQL = {k: f"WITH {BASE} {v}" for k, v in _SELECTS.items()}
