"""Score matrix, pair tables and their alignment. Matrices are long tables, pairs have p < q.

Input shapes: scores (benchmark, model, score); tags (benchmark, tag, weight); pairs (p, q, s, r, common_count).
Pair tables are bounded by the benchmark catalog; scores and records of any size are aggregated before they are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.semantics import average_rank, cosine, pearson
from rankloom.runtime import catalog_rows


def normalised(scores: DataFrame) -> DataFrame:
    """score_rank: average rank over n-1 (0.5 alone); score_pct: the same, 0 alone; score_z: population z-score, 0 if constant."""
    n = F.count(F.lit(1)).over(W.partitionBy("benchmark"))
    mean, sd = F.avg("score").over(W.partitionBy("benchmark")), F.stddev_pop("score").over(W.partitionBy("benchmark"))
    rank = average_rank("score", "benchmark")
    return scores.withColumns({"score_rank": F.when(n == 1, 0.5).otherwise(F.try_divide(rank, n - 1)), "score_pct": rank / F.greatest(n - 1, F.lit(1)), "score_z": F.when(sd > 0, F.try_divide(F.col("score") - mean, sd)).otherwise(0.0)})


def common_scores(scores: DataFrame) -> DataFrame:
    """(p, q, model, x, y) of benchmark pairs p < q with a model in common: an equi-join on the model."""
    a = scores.select(F.col("benchmark").alias("p"), "model", F.col("score").alias("x"))
    b = scores.select(F.col("benchmark").alias("q"), "model", F.col("score").alias("y"))
    return a.join(b, "model").where("p < q")


def rank_similarity(scores: DataFrame, min_common: int = 6) -> DataFrame:
    """(p, q, common_count, r): Spearman over common models, ranked again within each pair; null below ``min_common``."""
    c = common_scores(scores)
    ranked = c.select("p", "q", average_rank("x", "p", "q").alias("rx"), average_rank("y", "p", "q").alias("ry"))
    out = ranked.groupBy("p", "q").agg(F.count(F.lit(1)).alias("common_count"), pearson("rx", "ry").alias("_r"))
    return out.select("p", "q", "common_count", F.when(F.col("common_count") >= min_common, F.col("_r")).alias("r"))


def common_counts(scores: DataFrame) -> DataFrame:
    """(p, q, common_count) of pairs with a model in common."""
    return common_scores(scores).groupBy("p", "q").agg(F.count(F.lit(1)).alias("common_count"))


def listed(names: DataFrame, column: str) -> Column:
    """The distinct values of a catalog's column as an array, in order; an error if they are too many for a catalog."""
    found = sorted(r[0] for r in catalog_rows(names.where(F.col(column).isNotNull()).select(column).distinct()))
    return F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")


def all_pairs(scores: DataFrame, similarity: DataFrame) -> DataFrame:
    """Every pair of the catalog's benchmarks, with count 0 and null where they have no model in common."""
    names = scores.select("benchmark").distinct()
    pairs = names.select(F.col("benchmark").alias("p"), F.explode(listed(names, "benchmark")).alias("q")).where("p < q")
    return pairs.join(similarity, ["p", "q"], "left").withColumn("common_count", F.coalesce("common_count", F.lit(0)))


def missing_cells(scores: DataFrame) -> DataFrame:
    """(benchmark, model) of the catalog's cells that have no score."""
    cells = scores.select("benchmark").distinct().select("benchmark", F.explode(listed(scores, "model")).alias("model"))
    return cells.join(scores.select("benchmark", "model"), ["benchmark", "model"], "left_anti")


def tag_similarity(tags: DataFrame) -> DataFrame:
    """(p, q, s): cosine of tag vectors of every pair that shares a tag with weight."""
    w = tags.where("weight <> 0")
    norms = w.groupBy("benchmark").agg(F.sum(F.col("weight") * F.col("weight")).alias("n2"))
    a = w.select(F.col("benchmark").alias("p"), "tag", F.col("weight").alias("wa"))
    b = w.select(F.col("benchmark").alias("q"), "tag", F.col("weight").alias("wb"))
    dots = a.join(b, "tag").where("p < q").groupBy("p", "q").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    j = dots.join(norms.select(F.col("benchmark").alias("p"), F.col("n2").alias("np")), "p").join(norms.select(F.col("benchmark").alias("q"), F.col("n2").alias("nq")), "q")
    return j.select("p", "q", cosine(F.col("dot"), F.col("np"), F.col("nq")).alias("s"))


def aligned(similarity: DataFrame, ranks: DataFrame) -> DataFrame:
    """Pairs with both values: (p, q, s, r, r01, common_count)."""
    return similarity.join(ranks.where("r IS NOT NULL"), ["p", "q"]).withColumn("r01", (F.col("r") + 1) / 2)


def alignment_loss(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(F.avg(F.pow(F.col("s") - F.col("r"), 2)).alias("l_align"), F.avg(F.pow(F.col("s") - F.col("r01"), 2)).alias("l_align_01"), F.count(F.lit(1)).alias("n_pairs"))


def alignment_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson and Spearman of s and r over the pairs."""
    one = pairs.withColumn("_g", F.lit(1))
    return one.select("s", "r", average_rank("s", "_g").alias("rs"), average_rank("r", "_g").alias("rr")).agg(F.count(F.lit(1)).alias("n_pairs"), pearson("s", "r").alias("rho_p"), pearson("rs", "rr").alias("rho_s"))


def thresholds(pairs: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """(theta_n, theta_p): interpolated quantiles of s."""
    q = F.percentile("s", F.array(F.lit(low), F.lit(high)))
    return pairs.agg(q.alias("_q")).select(F.get("_q", F.lit(0)).alias("theta_n"), F.get("_q", F.lit(1)).alias("theta_p"))


def tag_gap(pairs: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """delta_tag: mean r of the pairs with s at or above theta_p less that of those at or below theta_n; a pair may be both."""
    t = pairs.join(F.broadcast(thresholds(pairs, low, high)))
    up, down = F.col("s") >= F.col("theta_p"), F.col("s") <= F.col("theta_n")
    out = t.agg(F.avg(F.when(up, F.col("r"))).alias("intra"), F.avg(F.when(down, F.col("r"))).alias("inter"), F.count_if(up).alias("n_pos"), F.count_if(down).alias("n_neg"))
    return out.withColumn("delta_tag", F.col("intra") - F.col("inter"))


def within_buckets(pairs: DataFrame, split: DataFrame) -> DataFrame:
    """Pairs whose two ends lie in the same bucket, with the bucket."""
    a, b = split.select(F.col("benchmark").alias("p"), F.col("bucket").alias("bp")), split.select(F.col("benchmark").alias("q"), F.col("bucket").alias("bq"))
    return pairs.join(a, "p").join(b, "q").where("bp = bq").drop("bq").withColumnRenamed("bp", "bucket")


def bucket_metrics(pairs: DataFrame, split: DataFrame) -> DataFrame:
    """(bucket, n_pairs, l_align, benchmarks, effective, isolated): ends of valid pairs count as effective."""
    inside = within_buckets(pairs, split)
    loss = alignment_loss(inside, ["bucket"]).select("bucket", "n_pairs", "l_align")
    ends = inside.select("bucket", F.explode(F.array("p", "q")).alias("benchmark")).groupBy("bucket").agg(F.count_distinct("benchmark").alias("effective"))
    size = split.groupBy("bucket").agg(F.count_distinct("benchmark").alias("benchmarks"))
    j = size.join(loss, "bucket", "left").join(ends, "bucket", "left")
    return j.select("bucket", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "l_align", "benchmarks", F.coalesce("effective", F.lit(0)).alias("effective"), (F.col("benchmarks") - F.coalesce("effective", F.lit(0))).alias("isolated"))


def symmetric(pairs: DataFrame, *values: str) -> DataFrame:
    """(a, b, values) with every pair in both directions."""
    return pairs.select(F.col("p").alias("a"), F.col("q").alias("b"), *values).unionByName(pairs.select(F.col("q").alias("a"), F.col("p").alias("b"), *values))


def top_neighbours(pairs: DataFrame, value: str, k: int) -> DataFrame:
    """(a, b, place): the k neighbours of a with the highest value, ties by name."""
    w = W.partitionBy("a").orderBy(F.desc(value), "b")
    return symmetric(pairs, value).where(F.col(value).isNotNull()).select("a", "b", value, F.row_number().over(w).alias("place")).where(F.col("place") <= k)


def recall_at_k(pairs: DataFrame, k: int) -> DataFrame:
    """(a, recall): share of the k nearest by rank similarity among the k nearest by tags; needs k neighbours."""
    by_s, by_r = top_neighbours(pairs, "s", k).select("a", "b"), top_neighbours(pairs, "r", k).select("a", "b", F.lit(1).alias("hit"))
    full = by_r.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("a")
    return by_s.join(full, "a").join(by_r, ["a", "b"], "left").groupBy("a").agg((F.coalesce(F.sum("hit"), F.lit(0)) / k).alias("recall"))


def retrieval_report(pairs: DataFrame, k: int) -> DataFrame:
    """(a, top_mean, all_mean): mean rank similarity of the k nearest by tags (ties by name, last first) and of all."""
    both = symmetric(pairs, "s", "r").where("r IS NOT NULL")
    w = W.partitionBy("a").orderBy(F.desc("s"), F.desc("b"))
    ranked = both.withColumn("place", F.row_number().over(w))
    return ranked.groupBy("a").agg(F.avg(F.when(F.col("place") <= k, F.col("r"))).alias("top_mean"), F.avg("r").alias("all_mean"))


def flagged_pairs(pairs: DataFrame, q_low: float = 0.2, q_high: float = 0.8) -> DataFrame:
    """All pairs that tags call similar and ranks don't (false_sim), or the other way round (false_dis)."""
    q = lambda c: F.percentile(c, F.array(F.lit(q_low), F.lit(q_high)))
    t = pairs.join(F.broadcast(pairs.agg(q("s").alias("qs"), q("r01").alias("qr"))))
    lo, hi = F.lit(0), F.lit(1)
    kind = F.when((F.col("s") >= F.get("qs", hi)) & (F.col("r01") <= F.get("qr", lo)), "false_sim").when((F.col("s") <= F.get("qs", lo)) & (F.col("r01") >= F.get("qr", hi)), "false_dis")
    return t.select("p", "q", kind.alias("kind"), F.abs(F.col("s") - F.col("r01")).alias("gap")).where("kind IS NOT NULL")


def error_report(pairs: DataFrame, k: int, q_low: float = 0.2, q_high: float = 0.8) -> DataFrame:
    """The k worst of the flagged pairs."""
    return flagged_pairs(pairs, q_low, q_high).orderBy(F.desc("gap"), "p", "q").limit(k)


def residual_report(pairs: DataFrame, k: int) -> DataFrame:
    way = F.when(F.col("s") > F.col("r"), "over").when(F.col("s") < F.col("r"), "under").otherwise("even")
    return pairs.select("p", "q", F.abs(F.col("s") - F.col("r")).alias("residual"), way.alias("direction")).orderBy(F.desc("residual"), "p", "q").limit(k)


def protected_pairs(pairs: DataFrame, least: float, k: int) -> DataFrame:
    return pairs.where(F.col("r") >= least).select("p", "q", "r", F.abs(F.col("s") - F.col("r")).alias("residual")).orderBy(F.desc("r"), F.asc_nulls_last("residual"), "p", "q").limit(k)


def positive_objective(pairs: DataFrame, share: float = 0.2) -> DataFrame:
    """Mean rank similarity of the top share of pairs by tags, and the loss 1 - (score + 1) / 2. Pairs are bounded."""
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    ranked = pairs.withColumn("_i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("s"), "p", "q"))).withColumn("_n", n)
    top = ranked.where(F.col("_i") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share)))
    return top.agg(F.count(F.lit(1)).alias("n_top"), F.avg("r").alias("score")).withColumn("loss", 1 - (F.col("score") + 1) / 2)


def involving(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs with at least one end among ``names`` (benchmark)."""
    n = names.select("benchmark").distinct()
    a = pairs.join(n, pairs["p"] == n["benchmark"], "left_semi")
    return a.unionByName(pairs.join(n, pairs["q"] == n["benchmark"], "left_semi")).distinct()


def coverage(scores: DataFrame) -> DataFrame:
    """Cells, density and models per benchmark (least, median, most)."""
    per = scores.groupBy("benchmark").agg(F.count_distinct("model").alias("k"))
    size = scores.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("benchmark").alias("benchmarks"), F.count_distinct("model").alias("models"))
    stats = per.agg(F.min("k").alias("least"), F.median("k").alias("middle"), F.max("k").alias("most"))
    return size.join(F.broadcast(stats)).select("cells", "benchmarks", "models", (F.col("cells") / (F.col("benchmarks") * F.col("models"))).alias("density"), "least", "middle", "most")


def profiles(scores: DataFrame, tags: DataFrame, value: str) -> DataFrame:
    """(model, tag, weight): sparse product of a score column with the tag weights."""
    return scores.join(tags, "benchmark").groupBy("model", "tag").agg(F.sum(F.col(value) * F.col("weight")).alias("weight"))


def covered_profile(scores: DataFrame, tags: DataFrame, value: str) -> DataFrame:
    """(model, tag, weight): sum(value * w) / sum(w) over the benchmarks with w <> 0, four decimals; 0 if nothing covers it."""
    j = scores.join(tags.where("weight <> 0"), "benchmark").groupBy("model", "tag").agg(F.sum(F.col(value) * F.col("weight")).alias("a"), F.sum("weight").alias("b"))
    return j.select("model", "tag", F.coalesce(F.try_divide("a", "b"), F.lit(0.0)).alias("weight"))


def min_max_ranking(scores: DataFrame) -> DataFrame:
    """(model, score): mean of min-max normalised scores (constant: 0.5) of the models that every benchmark has."""
    w = W.partitionBy("benchmark")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    norm = scores.withColumn("_v", F.when(hi > lo, F.try_divide(F.col("score") - lo, hi - lo)).otherwise(0.5))
    k = scores.agg(F.count_distinct("benchmark").alias("_k"))
    return norm.groupBy("model").agg(F.count_distinct("benchmark").alias("_n"), F.avg("_v").alias("score")).join(F.broadcast(k)).where("_n = _k").select("model", "score")


def trend(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, slope, intercept, x0, x1): least squares line through the points of each group."""
    slope = F.try_divide(F.covar_pop(x, y), F.nullif(F.var_pop(x), F.lit(0.0)))
    out = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), slope.alias("slope"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.min(x).alias("x0"), F.max(x).alias("x1"))
    return out.select(by, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "x0", "x1")


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) + F.lit(0.0) for c, n in places.items()})  # + 0.0: no negative zero
