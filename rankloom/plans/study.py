"""Queries of the studies: resampling, taggers, stability, splits, selection among iterations and runs.

Items are the models of the catalog on the categories of benchmarks, tagged by the kinds of source: the weight of an axis is
the share of a kind's records that have it (a link, a reference, a reporter, a full day, variants). Runs are iterations: ten
runs form a fold, and an iteration's metrics compare its scores with the matrix, by the buckets of the benchmarks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.cleaning import kind_key, usable_score, usable_text
from rankloom.functions.semantics import average_rank, level_weight, pearson, reasons, weight_level
from rankloom.operators import align as A
from rankloom.operators import board as B
from rankloom.operators import selection as S
from rankloom.operators import study as U
from rankloom.operators import texts as X
from rankloom.operators.hotdeck import usable_matrix_score
from rankloom.plans import extras
from rankloom.plans.alignment import BASE, buckets, matrix, pair_table, tag_weights
from rankloom.runtime import small, stash
from rankloom.runtime import table as t

TEACHER, TEACHERS = "tech_report", ["manual", "tech_report"]
_AXES = ("dated", "linked", "referred", "reported", "varied")


def _tagged(s, d):
    """One row for each record on a known benchmark and model, with its axes as numbers."""
    b, m = small(t(s, d, "benchmarks").select(F.col("id").alias("benchmark_id"), "category")), small(t(s, d, "models").select(F.col("id").alias("model_id")))
    r = t(s, d, "score_records").where("run_id is not null").join(b, "benchmark_id").join(m, "model_id")
    src = F.col("source")
    has = (F.coalesce(F.trim(src["published"]).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), usable_text(src["url"]), usable_text(src["ref"]), usable_text(src["reported_by"]), F.coalesce(F.size("variants") > 0, F.lit(False)))
    tagger = F.coalesce(F.nullif(kind_key(src["kind"]), F.lit("")), F.lit("none"))
    return r.select(tagger.alias("tagger"), (F.substring("run_id", 5, 10).cast("int") % 2 + 1).alias("pass"), F.substring("run_id", 5, 10).cast("int").alias("run"), F.col("category").alias("benchmark"), F.col("model_id").alias("item"), "score", "config", "extra", *[c.cast("double").alias(a) for a, c in zip(_AXES, has)])


def _items(s, d):
    r = _tagged(s, d)
    g = r.groupBy("tagger", "pass", "benchmark", "item").agg(*[F.round(F.avg(a), 6).alias(a) for a in _AXES])
    return g.unpivot(["tagger", "pass", "benchmark", "item"], list(_AXES), "axis", "weight")


def _iterations(s, d):
    b = small(buckets(s, d).select(F.col("benchmark").alias("_b"), F.col("bucket").alias("scope")))
    scale = small(t(s, d, "benchmarks").select(F.col("id").alias("benchmark"), "scale"))
    raw = t(s, d, "scores").join(scale, "benchmark").where(usable_matrix_score(F.col("score"), F.coalesce(F.col("scale") == "rating", F.lit(False))) & (F.coalesce(F.col("scale"), F.lit("")) != "rating") & F.col("run_id").isNotNull())
    y = small(matrix(s, d).select("benchmark", "model", F.col("score").alias("y")))
    j = raw.join(y, ["benchmark", "model"]).join(b, F.col("benchmark") == F.col("_b"))
    metric = F.lower(F.trim("metric"))
    j = j.select("run_id", "scope", "benchmark", metric.alias("metric"), F.round("score", 6).alias("x"), "y")
    j = j.withColumns({"rx": average_rank("x", "run_id", "scope"), "ry": average_rank("y", "run_id", "scope")})
    g = j.groupBy("run_id", "scope").agg(F.count("*").alias("n_pairs"), F.count_distinct("benchmark").alias("effective"), F.avg(F.pow(F.col("x") - F.col("y"), 2)).alias("l_align"), pearson("x", "y").alias("rho_p"), pearson("rx", "ry").alias("rho_s"), (F.avg(F.when(metric == "accuracy", F.col("x"))) - F.avg(F.when(metric != "accuracy", F.col("x")))).alias("delta_tag"), F.max(F.abs(F.col("x") - F.col("y"))).alias("residual_max"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("residual_mean"), F.count_distinct("metric").alias("tag_count"))
    k = F.substring("run_id", 5, 10).cast("int")
    out = g.select(F.floor(k / 10).cast("int").alias("fold"), (k % 10).cast("int").alias("iter"), "scope", "n_pairs", "effective", "l_align", "rho_p", "rho_s", "delta_tag", "residual_max", "residual_mean", "tag_count")
    return stash(A.rounded(out, l_align=6, rho_p=6, rho_s=6, delta_tag=6, residual_max=6, residual_mean=6), "iterations")


def ag12_chunk_levels(s, d):
    """Runs as chunks of a category: levels of the axes, their example-weighted mean and how many examples have each level."""
    g = _tagged(s, d).groupBy("benchmark", "run").agg(F.count("*").alias("n"), *[F.round(F.avg(a), 6).alias(a) for a in _AXES]).unpivot(["benchmark", "run", "n"], list(_AXES), "axis", "w")
    c = g.withColumn("level", weight_level(F.col("w")))
    levels = [F.coalesce(F.sum(F.when(F.col("level") == x, F.col("n"))), F.lit(0)).alias(x) for x in ("absent", "weak", "medium", "strong", "dominant")]
    return c.groupBy("benchmark", "axis").agg(F.round(F.sum(F.col("n") * level_weight(F.col("level"))) / F.sum("n"), 6).alias("weight"), *levels)


def ag13_evidence(s, d):
    """Configs of each benchmark as evidence: distinct ones in the order of their first record, the first 60, each of up to 200 letters."""
    from pyspark.sql import Window as W

    r = t(s, d, "score_records").where("benchmark_id is not null and trim(config) <> ''").groupBy("benchmark_id", F.substring(F.trim("config"), 1, 200).alias("text")).agg(F.min("record_id").alias("first"), F.count("*").alias("n"))
    top = r.withColumn("i", F.row_number().over(W.partitionBy("benchmark_id").orderBy("first", "text"))).where("i <= 60")
    return top.groupBy("benchmark_id").agg(F.count("*").alias("k"), F.sum("n").alias("records"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " / ").alias("evidence"))


def ag15_documents(s, d):
    """A text for each benchmark of the catalog: its name and description, the most frequent configs and kinds of its records."""
    from pyspark.sql import Window as W

    r = t(s, d, "score_records").where("benchmark_id is not null")
    kind = F.coalesce(F.nullif(kind_key(F.col("source.kind")), F.lit("")), F.lit("none"))
    each = r.select("benchmark_id", F.explode(F.array(F.struct(F.lit("config").alias("f"), F.lower(F.trim("config")).alias("v")), F.struct(F.lit("kind").alias("f"), kind.alias("v")))).alias("x")).where("x.v <> ''")
    n = each.groupBy("benchmark_id", "x.f", "x.v").agg(F.count("*").alias("n"))
    top = n.withColumn("i", F.row_number().over(W.partitionBy("benchmark_id", "f").orderBy(F.desc("n"), "v"))).where("i <= 5")
    line = top.groupBy("benchmark_id", "f").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "v", "n"))), lambda x: F.concat(x["v"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("line"))
    doc = line.groupBy("benchmark_id").agg(F.max(F.when(F.col("f") == "config", F.col("line"))).alias("configs"), F.max(F.when(F.col("f") == "kind", F.col("line"))).alias("kinds"))
    b = t(s, d, "benchmarks").select(F.col("id").alias("benchmark_id"), "name", "description")
    return b.join(doc, "benchmark_id", "left").select("benchmark_id", F.concat_ws("\n", F.concat(F.lit("# "), "name"), "description", F.concat(F.lit("configs: "), "configs"), F.concat(F.lit("kinds: "), "kinds")).alias("document"))


def ag27_cell_means(s, d):
    """Grades of answers as cells: how many a benchmark and model have and their mean."""
    g = extras.gd1_grades(s, d).select("record_id", "spans")
    r = t(s, d, "score_records").select("record_id", "benchmark_id", "model_id").where("benchmark_id is not null and model_id is not null")
    return r.join(g, "record_id").groupBy("benchmark_id", "model_id").agg(F.count("*").alias("n"), F.round(F.avg("spans"), 6).alias("mean"))


def ag28_tagger_costs(s, d):
    """Usage of each tagger: valid share, cost by a price for letters read and written, and how many times cheaper it is than the teacher."""
    k = small(t(s, d, "source_kinds").select(F.col("kind").alias("_k"), "trust"))
    g = _tagged(s, d).groupBy("tagger").agg(F.count("*").alias("total"), F.count_if(usable_score(F.col("score"))).alias("valid"), F.sum(F.coalesce(F.length("config"), F.lit(0))).alias("read"), F.sum(F.coalesce(F.length("extra"), F.lit(0))).alias("written"))
    p = g.join(k, F.col("tagger") == F.col("_k"), "left").withColumn("cost", (F.col("read") * F.coalesce("trust", F.lit(1)) + F.col("written") * 2 * F.coalesce("trust", F.lit(1))) / 1000)
    own = F.col("cost") / F.greatest(F.col("total"), F.lit(1))
    t1 = p.where(F.col("tagger") == TEACHER).select(own.alias("_teacher"))
    j = p.join(F.broadcast(t1), how="left")  # one row
    return j.select("tagger", "total", F.round(F.col("valid") / F.col("total"), 6).alias("valid_rate"), F.round(own, 6).alias("cost_per_item"), F.round(F.try_divide(F.col("_teacher"), own), 6).alias("ratio"))


def ag29_calibration(s, d):
    return A.rounded(U.calibration(_items(s, d), TEACHER, 3), correlation=5, overlap=6)


def ag29_decoding(s, d):
    """How alike the profiles of a tagger's two passes are on the items of both."""
    i = _items(s, d)
    one, two = i.where("pass = 1").select("tagger", "benchmark", "item", "axis", F.col("weight").alias("a")), i.where("pass = 2").select("tagger", "benchmark", "item", "axis", F.col("weight").alias("b"))
    g = one.join(two, ["tagger", "benchmark", "item", "axis"]).groupBy("tagger", "benchmark", "axis").agg(F.round(F.avg("a"), 8).alias("a"), F.round(F.avg("b"), 8).alias("b"))
    return A.rounded(g.groupBy("tagger", "benchmark").agg(U.zero_pearson("a", "b").alias("correlation")), correlation=5)


def ag30_consensus(s, d):
    return A.rounded(U.consensus(U.item_profile(_items(s, d)), TEACHERS), consensus=6, minimum=6)


def ag31_partial_correlation(s, d):
    """Whether tags tell rank similarity beyond what the same category does."""
    c = small(t(s, d, "benchmarks").select("id", "category"))
    p = pair_table(s, d).join(c.select(F.col("id").alias("p"), F.col("category").alias("_a")), "p").join(c.select(F.col("id").alias("q"), F.col("category").alias("_b")), "q")
    out = U.partial_correlation(p.select("s", "r", (F.col("_a") == F.col("_b")).cast("double").alias("same")))
    return A.rounded(out, by_tag=6, by_domain=6, partial=6, same_mean=6, cross_mean=6)


def ag33_model_probe(s, d):
    """Least, mean and greatest alignment over the probes that leave out one model each, for all models."""
    y = matrix(s, d)
    p = U.probes(A.common_scores(y), A.tag_similarity(tag_weights(s, d)), 4)
    each = F.explode(F.array(F.struct(F.lit("l_align").alias("metric"), F.col("l_align").alias("v")), F.struct(F.lit("rho_p").alias("metric"), F.col("rho_p").alias("v")), F.struct(F.lit("n_pairs").alias("metric"), F.col("n_pairs").cast("double").alias("v")))).alias("x")
    out = p.select(each).groupBy("x.metric").agg(F.count("x.v").alias("probes"), F.avg("x.v").alias("mean"), F.min("x.v").alias("least"), F.max("x.v").alias("most"))
    return A.rounded(out, mean=5, least=5, most=5)


def ag35_fold_diagnostics(s, d):
    """Counts of valid pairs and benchmarks by fold for five seeds: the least and the sum over the folds."""
    p, b = pair_table(s, d), t(s, d, "benchmarks").select(F.col("id").alias("benchmark"))
    out = None
    for seed in range(5):
        c = U.fold_counts(p, U.plain_folds(b, "benchmark", 3, seed)).agg(F.min("pairs").alias("least_pairs"), F.sum("pairs").alias("pairs"), F.min("ends").alias("least_ends"), F.sum("ends").alias("ends")).select(F.lit(seed).alias("seed"), "*")
        out = c if out is None else out.unionByName(c)
    return out


def tk14_best_seed(s, d):
    """Seeds of the folds, best first: most pairs in the least fold, then benchmarks, then pairs in all."""
    from pyspark.sql import Window as W

    w = W.partitionBy(F.lit(1)).orderBy(F.desc("least_pairs"), F.desc("least_ends"), F.desc("pairs"), "seed")  # a few seeds
    return ag35_fold_diagnostics(s, d).select("seed", F.row_number().over(w).alias("place"))


def ag36_kfold_gate(s, d):
    """Means over the iterations of each fold, and what keeps its evidence from being research-grade."""
    g = _iterations(s, d).where("scope = 'test'").groupBy("fold").agg(F.count("*").alias("iterations"), F.min("n_pairs").alias("n_pairs"), F.min("effective").alias("effective"), F.avg("l_align").alias("l_align"), F.avg("rho_s").alias("rho_s"))
    why = reasons(*S.block_faults("test", F.col("n_pairs"), F.col("effective"), F.col("l_align"), F.col("rho_s")))
    return A.rounded(g.withColumn("faults", F.array_join(why, ",")), l_align=6, rho_s=6)


def ag37_best_run(s, d):
    """The five best folds by status, loss, correlation, gap, size and name."""
    g = _iterations(s, d).where("scope = 'dev'").groupBy("fold").agg(F.round(F.avg("l_align"), 6).alias("l_align"), F.round(F.avg("rho_s"), 6).alias("rho_s"), F.round(F.avg("delta_tag"), 6).alias("delta_tag"), F.count("*").alias("folds"))
    status = F.when(F.col("rho_s") >= 0.5, "pass").when(F.col("rho_s") < 0.2, "fail")
    return S.best_runs(g.select(F.format_string("fold-%04d", "fold").alias("run_id"), status.alias("status"), "l_align", "rho_s", "delta_tag", "folds"), 5)


def ag38_subset_ranking(s, d):
    """The eight best models by the percent benchmarks of one category, beside their place by all."""
    b = small(t(s, d, "benchmarks").where("scale = 'percent'").select(F.col("id").alias("benchmark")))
    y = matrix(s, d).join(b, "benchmark", "left_semi")
    subset = [r.id for r in t(s, d, "benchmarks").where("category = 'math'").select("id").orderBy("id").collect()]
    return A.rounded(B.subset_ranking(y, subset or [""], 8), subset_score=1, full_score=1, regret=3, reliability=3)


def ag40_suite_coverage(s, d):
    """Mean weight of every tag over the benchmarks of a suite (those of one category), missing ones as 0, and whether it is strong."""
    suite = t(s, d, "benchmarks").where("category = 'coding'").select(F.col("id").alias("benchmark"))
    w = tag_weights(s, d)
    n = suite.agg(F.count("*").alias("n"))
    g = w.join(small(suite), "benchmark", "left_semi").groupBy("tag").agg(F.sum("weight").alias("w"))
    every = w.select("tag").distinct()
    j = every.join(g, "tag", "left").join(F.broadcast(n))  # one row
    c = F.coalesce(F.try_divide("w", "n"), F.lit(0.0))
    return j.select("tag", F.round(c, 6).alias("coverage"), F.when(c >= 0.15, "strong").otherwise("weak").alias("rating"))


def ag43_projection(s, d):
    """Pairs that would have six models in common if the cells that are planned (present without a usable score) were filled."""
    have = matrix(s, d).select("benchmark", "model", F.lit(0.0).alias("score"))
    plan = t(s, d, "scores").where("benchmark is not null and model is not null").select("benchmark", "model").distinct().join(have, ["benchmark", "model"], "left_anti").withColumn("score", F.lit(0.5))
    b = buckets(s, d)
    count = lambda y, name: A.within_buckets(A.common_counts(y).where("common_count >= 6"), b).groupBy("bucket").agg(F.count("*").alias(name))
    now, then = count(have, "now"), count(have.unionByName(plan), "projected")
    every = b.select("bucket").distinct()
    return every.join(now, "bucket", "left").join(then, "bucket", "left").select("bucket", F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("projected", F.lit(0)).alias("projected"))


def ag44_iteration_decisions(s, d):
    """Runs in order as iterations: whether a run's mean beats the best so far, and whether the stored best (rounded) tells another story."""
    g = t(s, d, "scores").where(usable_score(F.col("score")) & (F.col("score") <= 1) & F.col("run_id").isNotNull()).groupBy("run_id").agg(F.round(F.avg("score"), 8).alias("mean"))
    best = F.col("before")
    out = S.running_best(g, "run_id", "mean")
    return out.select("run_id", F.round("mean", 6).alias("mean"), F.when(best.isNull() | (F.col("mean") > best + 1e-12), "accepted").otherwise("rejected").alias("decision"), (F.abs(F.round("mean", 4) - F.col("mean")) > 1e-9).alias("mismatch"))


def ag45_regraded(s, d):
    """Mean of the records that look like percentages against the matrix, where they lie further apart than two points."""
    r = t(s, d, "score_records").where(usable_score(F.col("score")) & F.col("score").between(1, 100)).groupBy(F.col("benchmark_id").alias("benchmark"), F.col("model_id").alias("model")).agg(F.avg("score").alias("x"), F.count("*").alias("n"))
    j = matrix(s, d).join(r, ["benchmark", "model"]).withColumn("delta", F.round(F.col("x") / 100 - F.col("score"), 6))
    return j.select("benchmark", "model", "n", (F.col("delta") + 0.0).alias("delta"), (F.abs("delta") <= 0.02).alias("within"))


def ag46_success(s, d):
    """Folds whose best iteration isn't the first and beats its loss; all of them: success."""
    c = S.candidates(_iterations(s, d))
    last = S.replay(c, -1.0).groupBy("fold").agg(F.max_by("best", "iter").alias("best"))
    base, top = c.groupBy("fold").agg(F.min_by("dev_l", "iter").alias("base_l"), F.min("iter").alias("first")), c.select("fold", F.col("iter").alias("best"), F.col("dev_l").alias("best_l"))
    j = last.join(base, "fold").join(top, ["fold", "best"], "left")
    return j.agg(F.count("*").alias("folds"), F.count_if(F.coalesce(F.col("best") != F.col("first"), F.lit(False))).alias("moved"), F.count_if(F.coalesce(F.col("best_l") < F.col("base_l"), F.lit(False))).alias("better")).withColumn("success", (F.col("moved") == F.col("folds")) & (F.col("better") == F.col("folds")))


def jn12_paired_items(s, d):
    return U.paired_items(_items(s, d), TEACHER).groupBy("tagger", "benchmark").agg(F.count_distinct("item").alias("items"), F.round(F.avg(F.abs(F.col("ours") - F.col("theirs"))), 6).alias("gap"))


def it1_replay(s, d):
    return S.replay(S.candidates(_iterations(s, d)), -0.05, floor=0.1, rise=0.05)


def it2_stability(s, d):
    return A.rounded(S.stability(S.candidates(_iterations(s, d)), 6, 0.01).select("fold", "iter", "l_max", "rho_min", "stability"), l_max=6, rho_min=6, stability=6)


def it3_adoption(s, d):
    """Each iteration's dev metrics against the fold's first ones: reasons not to adopt it, and whether it would trigger a refinement."""
    i = _iterations(s, d).where("scope = 'dev'")
    m = i.select("fold", "iter", "n_pairs", "residual_mean", F.struct("l_align", "rho_p", "delta_tag", "residual_max").alias("new"))
    first = m.groupBy("fold").agg(F.min_by("new", "iter").alias("fixed"))
    j = m.join(first, "fold")
    return j.select("fold", "iter", F.array_join(S.adoption("fixed", "new"), ",").alias("against"), F.array_join(S.trigger(F.col("n_pairs"), F.col("new.residual_max"), F.col("residual_mean"), F.col("new.l_align"), (0.5, 0.05, 0.01)), ",").alias("trigger"))


def it7_candidates(s, d):
    return S.candidates(_iterations(s, d))


def it8_guard(s, d):
    return S.candidates(_iterations(s, d)).select("fold", "iter", S.skip_reason(-0.05, 0.3, 0.4).alias("reason"))


def it9_schedule(s, d):
    """Wanted number of tags and the seeds of the roles by iteration."""
    i = S.candidates(_iterations(s, d)).select("fold", "iter")
    roles = F.explode(F.array(*[F.lit(x) for x in (*S.SEED_OFFSETS, "judge")])).alias("role")
    return i.select("fold", "iter", S.target_count([8, 12, 8, -1, 16], F.col("iter")).alias("target"), roles).select("fold", "iter", "target", "role", S.role_seed(7, F.col("role"), F.col("iter")).cast("int").alias("seed"))


def fl19_gate(s, d):
    """Whether the gap of each bucket passes gates at several thresholds, the gap itself among them."""
    p = A.within_buckets(pair_table(s, d), buckets(s, d))
    q = F.percentile("s", F.array(F.lit(0.3), F.lit(0.7)))
    th = p.groupBy("bucket").agg(q.alias("cut"))
    j = p.join(small(th), "bucket")
    g = j.groupBy("bucket").agg(F.round(F.avg(F.when(F.col("s") >= F.get("cut", F.lit(1)), F.col("r"))) - F.avg(F.when(F.col("s") <= F.get("cut", F.lit(0)), F.col("r"))), 6).alias("delta_tag"), F.count_distinct("p").alias("tag_count"))
    gates = [S.passes_delta(F.col("delta_tag"), x).alias(n) for n, x in (("at_zero", 0.0), ("at_minus", -0.05), ("at_half", 0.5))]
    return g.select("bucket", (F.col("delta_tag") + 0.0).alias("delta_tag"), *gates, S.passes_count(F.col("tag_count"), 5, 30).alias("by_count"))


def fl20_faults(s, d):
    """What the splits of each iteration lack, all of them in one list; and the pooled faults of a fold."""
    i = _iterations(s, d)
    of = lambda scope, c: F.max(F.when(F.col("scope") == scope, F.col(c)))
    g = i.groupBy("fold", "iter").agg(*[of(x, c).alias(f"{x}_{c}") for x in ("dev", "test") for c in ("n_pairs", "effective", "l_align", "rho_s")])
    rules = [r for x in ("dev", "test") for r in S.block_faults(x, *[F.col(f"{x}_{c}") for c in ("n_pairs", "effective", "l_align", "rho_s")])]
    return g.select("fold", "iter", F.array_join(F.concat(reasons(*rules), S.pooled_faults(F.col("dev_rho_s"), F.col("dev_l_align"), F.col("test_n_pairs"))), ",").alias("faults"))


def cl3_subset_fidelity(s, d):
    """How near the profile of each model over a suite comes to that over all benchmarks: cosine."""
    y, w = A.normalised(matrix(s, d)).select("benchmark", "model", "score_pct"), tag_weights(s, d)
    suite = small(t(s, d, "benchmarks").where("category in ('math', 'coding', 'general')").select(F.col("id").alias("benchmark")))
    full, part = A.profiles(y, w, "score_pct"), A.profiles(y.join(suite, "benchmark", "left_semi"), w, "score_pct")
    j = full.select("model", "tag", F.col("weight").alias("a")).join(part.select("model", "tag", F.col("weight").alias("b")), ["model", "tag"], "left").fillna(0.0, ["b"])
    g = j.groupBy("model").agg(F.sum(F.col("a") * F.col("b")).alias("d"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("x"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("z"))
    return A.rounded(g.select("model", F.try_divide("d", F.nullif(F.col("x") * F.col("z"), F.lit(0.0))).alias("fidelity")), fidelity=6)


def tk9_model_ranking(s, d):
    """Models by the cosine of their profile with wanted tags, ties by name."""
    w = {"manual": 1.0, "tech_report": 0.5}
    p = A.covered_profile(A.normalised(matrix(s, d)), tag_weights(s, d), "score_pct").select(F.col("model").alias("benchmark"), "tag", F.round("weight", 6).alias("weight"))
    from pyspark.sql import Window as W

    out = A.rounded(B.relevance(p, w), relevance=5)
    return out.select(F.col("benchmark").alias("model"), "relevance", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("relevance"), "benchmark")).alias("place"))


def tk16_evaluated(s, d):
    """Rankings of models on each benchmark as its three nearest benchmarks by tags predict them, beside two baselines: the mean
    over the other benchmarks of its category, and over all others. Spearman with the true one."""
    y = matrix(s, d)
    near = A.top_neighbours(A.rounded(A.tag_similarity(tag_weights(s, d)).withColumnRenamed("s", "sim"), sim=8), "sim", 3)
    by = near.join(y.select(F.col("benchmark").alias("b"), "model", "score"), "b").groupBy(F.col("a").alias("benchmark"), "model").agg(F.round(F.sum(F.col("sim") * F.col("score")) / F.sum("sim"), 7).alias("predicted"))
    c = small(t(s, d, "benchmarks").select(F.col("id").alias("benchmark"), "category"))
    yc = y.join(c, "benchmark")
    # the mean over the others: the sum over all less the own score
    other = lambda keys: yc.join(yc.groupBy(*keys, "model").agg(F.sum("score").alias("_s"), F.count("*").alias("_n")), [*keys, "model"]).where("_n > 1").select("benchmark", "model", F.round((F.col("_s") - F.col("score")) / (F.col("_n") - 1), 7).alias("predicted"))
    out = U.ranking_of(y, by).select("benchmark", "models", F.col("rho").alias("near"))
    for name, p in (("domain", other(["category"])), ("overall", other([]))):
        out = out.join(U.ranking_of(y, p).select("benchmark", F.col("rho").alias(name)), "benchmark", "left")
    return A.rounded(out, near=5, domain=5, overall=5)


def _few_models(s, d, k):
    return [r.model for r in matrix(s, d).groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(k).collect()]


def tk12_core_plans(s, d):
    """The twenty best disjoint pairs of models to see and to hold out, of the eight most scored."""
    return U.core_plans(matrix(s, d), _few_models(s, d, 8), 2, 20)


def tk13_model_splits(s, d):
    """The ten best ways to hold out some of the twelve most scored models."""
    return U.model_split_search(matrix(s, d), _few_models(s, d, 12), buckets(s, d), 4, 10)


def sp2_plain_folds(s, d):
    return U.plain_folds(t(s, d, "benchmarks"), "id", 5, 3)


def sp4_balanced_folds(s, d):
    return U.balanced_folds(pair_table(s, d), t(s, d, "benchmarks").select(F.col("id").alias("benchmark")), 5, 3, 5_000, 10, 6)


def sp5_model_split(s, d):
    return U.family_split(t(s, d, "models"), "id", X.model_family(F.col("id")), 0.75, 11)


def sp8_seed_search(s, d):
    """The first seed of a thousand whose split has two given models among the seen ones and a third among the held."""
    m = sorted(_few_models(s, d, 3))
    names = [r.id for r in t(s, d, "models").select("id").distinct().orderBy("id").collect()]

    def run(b):
        import hashlib

        order = sorted(names, key=lambda x: (hashlib.md5(f"{b}|{x}".encode()).hexdigest(), x))
        seen = set(order[: round(len(order) * 0.75)])
        return [(b,)] if len(m) == 3 and m[0] in seen and m[1] in seen and m[2] not in seen else []

    return U._each(s, 1_000, run, "seed bigint").agg(F.min("seed").alias("seed"), F.count("*").alias("fitting"))


def rs1_bootstrap(s, d):
    return A.rounded(U.pair_bootstrap(pair_table(s, d), 200, 1), **{m: 6 for m in U.METRICS})


def rs2_block_bootstrap(s, d):
    return A.rounded(U.block_bootstrap(pair_table(s, d), 1_000, 2), **{m: 6 for m in U.METRICS})


def rs3_interval(s, d):
    """Intervals of all metrics over the replicates of rs1."""
    return A.rounded(U.intervals(rs1_bootstrap(s, d)), mean=5, sd=5, low=5, high=5)


def rs4_sign_flips(s, d):
    """Is the loss of pairs within a category smaller with r as it is than mapped to 0..1? Categories are the paired folds."""
    c = small(t(s, d, "benchmarks").select(F.col("id").alias("p"), "category"))
    g = pair_table(s, d).join(c, "p").groupBy(F.col("category").alias("name")).agg(F.round(F.avg(F.pow(F.col("s") - F.col("r01"), 2)) - F.avg(F.pow(F.col("s") - F.col("r"), 2)), 6).alias("delta"))
    return A.rounded(U.sign_flips(g), observed=8, p_value=8)


def rs5_permutation(s, d):
    """10,000 shuffles of r over all pairs, and 10,000 within the buckets of the pairs' first benchmark, pooled."""
    p = pair_table(s, d)
    b = small(buckets(s, d).select(F.col("benchmark").alias("p"), "bucket"))
    one = U.permutation_test(p, 10_000, 5).withColumn("form", F.lit("single"))
    return one.unionByName(U.permutation_test(p.join(b, "p"), 10_000, 6, "bucket").withColumn("form", F.lit("pooled")))


def rs6_gate(s, d):
    """Does 'manual' come nearer to the teacher than 'github_repo'? 500 item draws."""
    return U.gate_bootstrap(_items(s, d), TEACHER, "manual", "github_repo", 500, 3)


def rs7_consensus(s, d):
    return U.consensus_bootstrap(_items(s, d), TEACHERS, 200, 4)


def rs8_power(s, d):
    return U.power_grid(s, [8, 12], [8, 20], [0.0, 0.3, 0.6], 50)


def rs9_random_tags(s, d):
    return U.random_tags(t(s, d, "benchmarks").select(F.col("id").alias("benchmark")), ["a", "b", "c"], 7).withColumn("weight", F.round("weight", 9))


def mx1_procrustes(s, d):
    """Profiles of each third of the runs against those of all: a rotation and what it leaves."""
    one = lambda by: _tagged(s, d).withColumn("seed", F.col("run") % 3).groupBy(*by, "benchmark").agg(*[F.avg(a).alias(a) for a in _AXES]).unpivot([*by, "benchmark"], list(_AXES), "axis", "weight")
    return A.rounded(U.procrustes(one(["seed"]), "seed", one([])), residual=6, correlation=6)


def mx2_structure(s, d):
    return A.rounded(U.structure(U.item_profile(_items(s, d))), correlation=5)


def mx3_optimized(s, d):
    """Losses before and after fitting the tag weights to the rank similarities, from two starts."""
    return U.optimized_weights(tag_weights(s, d), pair_table(s, d), starts=2).select("start", F.round("initial_loss", 6).alias("initial_loss"), F.round("loss", 6).alias("loss"), "clipped")


_HELP = {"matrix", "pair_table", "tag_weights", "buckets", "small", "stash", "t", "kind_key", "usable_score", "usable_text", "average_rank", "level_weight", "pearson", "reasons", "weight_level", "usable_matrix_score"}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] != "_" and k not in _HELP}

_BLANK = "('', '-', '--', '?', '.', 'n/a', 'na', 'none', 'null', 'nil', 'nan', 'tbd', 'unknown', 'undefined')"
_USABLE = "coalesce(lower(trim(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))) NOT IN " + _BLANK + ", false)::INT::DOUBLE"
_R = "CASE WHEN stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"
_KIND = "coalesce(nullif(regexp_replace(lower(trim(source.kind)), '[ _-]+', '_', 'g'), ''), 'none')"
_ITEMS = f"""
tg AS (
  SELECT {_KIND} AS tagger, substr(run_id, 5)::INT AS run, substr(run_id, 5)::INT % 2 + 1 AS pass, category AS benchmark, model_id AS item, score, config, extra,
    coalesce(regexp_full_match(trim(source.published), '\\d{{4}}-\\d{{2}}-\\d{{2}}'), false)::INT::DOUBLE AS dated, {_USABLE.format('source.url')} AS linked, {_USABLE.format('source.ref')} AS referred, {_USABLE.format('source.reported_by')} AS reported, coalesce(len(variants) > 0, false)::INT::DOUBLE AS varied
  FROM score_records JOIN benchmarks b ON b.id = benchmark_id JOIN models m ON m.id = model_id WHERE run_id IS NOT NULL
), items AS (
  SELECT tagger, pass, benchmark, item, axis, weight FROM (SELECT tagger, pass, benchmark, item, round(avg(dated), 6) AS dated, round(avg(linked), 6) AS linked, round(avg(referred), 6) AS referred, round(avg(reported), 6) AS reported, round(avg(varied), 6) AS varied FROM tg GROUP BY ALL)
  UNPIVOT (weight FOR axis IN (dated, linked, referred, reported, varied))
), prof AS (
  SELECT tagger, benchmark, axis, round(avg(weight), 8) AS weight FROM items GROUP BY ALL
), paired AS (
  SELECT o.tagger, o.benchmark, o.item, o.axis, h.weight AS theirs, o.weight AS ours FROM items o JOIN items h ON h.tagger = '{TEACHER}' AND h.pass = 1 AND h.benchmark = o.benchmark AND h.item = o.item AND h.axis = o.axis WHERE o.pass = 1 AND o.tagger <> '{TEACHER}'
)"""
_ITER = f"""
js AS (
  SELECT s.run_id, bk.bucket AS scope, s.benchmark, lower(trim(s.metric)) AS metric, round(s.score, 6) AS x, y.score AS y FROM scores s JOIN benchmarks b ON b.id = s.benchmark JOIN y ON y.benchmark = s.benchmark AND y.model = s.model JOIN bk ON bk.benchmark = s.benchmark
  WHERE coalesce(b.scale, '') <> 'rating' AND NOT isnan(s.score) AND s.score >= 0 AND s.score <= 1 AND s.run_id IS NOT NULL
), jr AS (
  SELECT *, rank() OVER (PARTITION BY run_id, scope ORDER BY x) + (count(*) OVER (PARTITION BY run_id, scope, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY run_id, scope ORDER BY y) + (count(*) OVER (PARTITION BY run_id, scope, y) - 1) / 2.0 AS ry FROM js
), iters AS MATERIALIZED (
  SELECT (substr(run_id, 5)::INT // 10)::INT AS fold, (substr(run_id, 5)::INT % 10)::INT AS iter, scope, count(*) AS n_pairs, count(DISTINCT benchmark) AS effective, round(avg((x - y) ** 2), 6) AS l_align, round({_R.format('x', 'y')}, 6) + 0.0 AS rho_p, round({_R.format('rx', 'ry')}, 6) + 0.0 AS rho_s,
    round(avg(x) FILTER (metric = 'accuracy') - avg(x) FILTER (metric <> 'accuracy'), 6) + 0.0 AS delta_tag, round(max(abs(x - y)), 6) AS residual_max, round(avg(abs(x - y)), 6) AS residual_mean, count(DISTINCT metric) AS tag_count FROM jr GROUP BY run_id, scope
), cand AS MATERIALIZED (
  SELECT fold, iter, max(l_align) FILTER (scope = 'train') AS train_l, max(l_align) FILTER (scope = 'dev') AS dev_l, max(rho_s) FILTER (scope = 'train') AS train_rho, max(rho_s) FILTER (scope = 'dev') AS dev_rho, max(rho_p) FILTER (scope = 'dev') AS dev_rho_p, max(delta_tag) FILTER (scope = 'dev') AS delta_tag, max(tag_count) AS tag_count, coalesce(max(n_pairs) FILTER (scope = 'test'), 0) AS test_pairs FROM iters GROUP BY 1, 2
)"""


def _replayed(threshold: float, floor: float | None, rise: float | None) -> str:
    """CTE ``rep``: the loop of each fold as a recursion over its iterations."""
    gate = f"c.delta_tag > {threshold} OR (abs(c.delta_tag - {threshold}) <= 1e-12 AND {threshold} < 0)"
    ok = f"coalesce({gate}, false) AND c.dev_l IS NOT NULL" + (f" AND coalesce(c.dev_rho >= {floor}, false)" if floor is not None else "") + (f" AND (w.best IS NULL OR coalesce(c.train_l <= w.train_l + {rise}, false))" if rise is not None else "")
    first = "w.best IS NULL OR w.dev_l IS NULL" + (f" OR NOT coalesce(w.dev_rho >= {floor}, false)" if floor is not None else "")
    wins = f"(({ok}) AND (({first}) OR coalesce(CASE WHEN c.dev_l < w.dev_l - 1e-12 THEN true WHEN c.dev_l > w.dev_l + 1e-12 THEN false WHEN c.dev_rho_p IS NOT NULL AND (w.dev_rho_p IS NULL OR c.dev_rho_p > w.dev_rho_p) THEN true WHEN w.dev_rho_p IS NOT NULL AND (c.dev_rho_p IS NULL OR w.dev_rho_p > c.dev_rho_p) THEN false ELSE c.delta_tag IS NOT NULL AND (w.delta_tag IS NULL OR c.delta_tag > w.delta_tag) END, false)))"
    why = f"CASE WHEN win THEN 'new_best' WHEN NOT passes THEN 'delta_tag_gate_failed' WHEN had IS NULL THEN 'selection_gate_failed' ELSE 'not_better_than_current_best' END"
    keep = ", ".join(f"CASE WHEN {wins} THEN c.{f} ELSE w.{f} END AS {f}" for f in ("train_l", "dev_l", "dev_rho", "dev_rho_p", "delta_tag"))
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY iter) AS k FROM cand), walk AS (
  WITH RECURSIVE w AS (
    SELECT fold, 0::BIGINT AS k, NULL::INT AS iter, NULL::INT AS best, NULL::INT AS had, false AS win, false AS passes, 0 AS stall, NULL::DOUBLE AS train_l, NULL::DOUBLE AS dev_l, NULL::DOUBLE AS dev_rho, NULL::DOUBLE AS dev_rho_p, NULL::DOUBLE AS delta_tag FROM (SELECT DISTINCT fold FROM cand)
    UNION ALL SELECT w.fold, c.k, c.iter, CASE WHEN {wins} THEN c.iter ELSE w.best END, w.best, {wins}, coalesce({gate}, false), CASE WHEN {wins} THEN 0 ELSE w.stall + 1 END, {keep} FROM w JOIN num c ON c.fold = w.fold AND c.k = w.k + 1
  ) SELECT * FROM w WHERE k > 0
), rep AS (SELECT fold, iter, win AS improved, {why} AS reason, stall, best FROM walk)"""


_DRAW = "('0x' || md5({0})[:8])::BIGINT % n"
_METRICS = f"round(avg((s - r) ** 2), 6) AS l_align, round(avg((s - r01) ** 2), 6) AS l_align_01, round({_R.format('s', 'r')}, 6) + 0.0 AS rho_p, round({_R.format('rs', 'rr')}, 6) + 0.0 AS rho_s, round(avg(r) FILTER (s >= hi) - avg(r) FILTER (s <= lo), 6) + 0.0 AS delta_tag"
_MEASURED = f"""SELECT b, count(*) AS n, {_METRICS} FROM (
  SELECT *, quantile_cont(s, 0.3) OVER w AS lo, quantile_cont(s, 0.7) OVER w AS hi, rank() OVER (PARTITION BY b ORDER BY s) + (count(*) OVER (PARTITION BY b, s) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY b ORDER BY r) + (count(*) OVER (PARTITION BY b, r) - 1) / 2.0 AS rr FROM drawn WINDOW w AS (PARTITION BY b)) GROUP BY b"""
_PT = "ptm AS MATERIALIZED (SELECT p, q, s, r, (r + 1) / 2 AS r01 FROM pt)"
_RS1 = f"{_PT}, idx AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY p, q) - 1 AS i, count(*) OVER () AS n FROM ptm), drawn AS (SELECT d.b, x.s, x.r, x.r01 FROM (SELECT b, {_DRAW.format(chr(39) + '1|' + chr(39) + ' || b || ' + chr(39) + '|' + chr(39) + ' || i')} AS pos FROM idx, range(1, 201) t(b)) d JOIN idx x ON x.i = d.pos)"
_RS2 = f"{_PT}, nm AS MATERIALIZED (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, count(*) OVER () AS n FROM (SELECT p AS e FROM ptm UNION SELECT q FROM ptm)), dr AS MATERIALIZED (SELECT b, pos, count(*) AS k FROM (SELECT b, {_DRAW.format(chr(39) + '2|' + chr(39) + ' || b || ' + chr(39) + '|' + chr(39) + ' || i')} AS pos FROM nm, range(1, 1001) t(b)) GROUP BY ALL), dn AS MATERIALIZED (SELECT b, e, k FROM dr JOIN nm ON i = pos), drawn AS (SELECT b, s, r, r01 FROM (SELECT x.b, s, r, r01, unnest(range(x.k * z.k)) FROM ptm JOIN dn x ON x.e = p JOIN dn z ON z.e = q AND z.b = x.b))"
_BLOCK = lambda x, n, e, l, r: f"CASE WHEN {n} IS NULL THEN '{x}_missing' END, CASE WHEN {n} < 10 THEN '{x}_n_pairs' END, CASE WHEN {e} < 6 THEN '{x}_effective' END, CASE WHEN {n} IS NOT NULL AND {l} IS NULL THEN '{x}_l_align_not_finite' END, CASE WHEN {n} IS NOT NULL AND {r} IS NULL THEN '{x}_rho_s_not_finite' END, CASE WHEN {r} < 0 THEN '{x}_rho_s_below_floor' END"
_FOLD = lambda seed: f"(SELECT id AS benchmark, CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1) ELSE n % 3 + (i - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM (SELECT id, row_number() OVER (ORDER BY md5('{seed}|' || id), id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM benchmarks)))"
_SEEDS = " UNION ALL ".join(f"SELECT {k} AS seed, min(pairs) AS least_pairs, sum(pairs)::BIGINT AS pairs, min(ends) AS least_ends, sum(ends)::BIGINT AS ends FROM (SELECT f.fold, count(DISTINCT (p, q)) FILTER (p IS NOT NULL) AS pairs, count(DISTINCT e) AS ends FROM (SELECT DISTINCT fold FROM {_FOLD(k)}) f LEFT JOIN (SELECT a.fold, p, q, unnest([p, q]) AS e FROM ptm JOIN {_FOLD(k)} a ON a.benchmark = p JOIN {_FOLD(k)} b ON b.benchmark = q AND a.fold = b.fold) z ON z.fold = f.fold GROUP BY 1)" for k in range(5))

_FAMILY = "CASE " + " ".join(f"WHEN starts_with(lower(trim(id)), '{p}') THEN '{v}'" for p, v in X.FAMILIES) + " ELSE coalesce(nullif(string_split(lower(trim(id)), '-')[1], ''), lower(trim(id))) END"

_WITH = {
    "ag12_chunk_levels": (_ITEMS, "SELECT benchmark, axis, round(sum(n * v) / sum(n), 6) AS weight, " + ", ".join(f"coalesce(sum(n) FILTER (level = '{x}'), 0)::BIGINT AS {x}" for x in ("absent", "weak", "medium", "strong", "dominant")) + " FROM (SELECT *, CASE WHEN w >= 0.875 THEN 'dominant' WHEN w >= 0.625 THEN 'strong' WHEN w >= 0.375 THEN 'medium' WHEN w >= 0.125 THEN 'weak' ELSE 'absent' END AS level, CASE WHEN w >= 0.875 THEN 1.0 WHEN w >= 0.625 THEN 0.75 WHEN w >= 0.375 THEN 0.5 WHEN w >= 0.125 THEN 0.25 ELSE 0.0 END AS v FROM (SELECT benchmark, run, count(*) AS n, round(avg(dated), 6) AS dated, round(avg(linked), 6) AS linked, round(avg(referred), 6) AS referred, round(avg(reported), 6) AS reported, round(avg(varied), 6) AS varied FROM tg GROUP BY 1, 2) UNPIVOT (w FOR axis IN (dated, linked, referred, reported, varied))) GROUP BY 1, 2"),
    "ag13_evidence": ("", "SELECT benchmark_id, count(*) AS k, sum(n)::BIGINT AS records, string_agg(text, ' / ' ORDER BY i) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY benchmark_id ORDER BY first, text) AS i FROM (SELECT benchmark_id, trim(config)[:200] AS text, min(record_id) AS first, count(*) AS n FROM score_records WHERE benchmark_id IS NOT NULL AND trim(config) <> '' GROUP BY 1, 2)) WHERE i <= 60 GROUP BY 1"),
    "ag15_documents": ("", f"WITH e AS (SELECT benchmark_id, 'config' AS f, lower(trim(config)) AS v FROM score_records UNION ALL SELECT benchmark_id, 'kind', {_KIND} FROM score_records), n AS (SELECT benchmark_id, f, v, count(*) AS n FROM e WHERE v <> '' GROUP BY ALL), l AS (SELECT benchmark_id, f, string_agg(v || ' (' || n || ')', ', ' ORDER BY i) AS line FROM (SELECT *, row_number() OVER (PARTITION BY benchmark_id, f ORDER BY n DESC, v) AS i FROM n) WHERE i <= 5 GROUP BY 1, 2) SELECT b.id AS benchmark_id, concat_ws(chr(10), '# ' || name, description, 'configs: ' || c.line, 'kinds: ' || k.line) AS document FROM benchmarks b LEFT JOIN l c ON c.benchmark_id = b.id AND c.f = 'config' LEFT JOIN l k ON k.benchmark_id = b.id AND k.f = 'kind'"),
    "ag27_cell_means": ("", f"WITH g AS ({extras.SQL['gd1_grades']}) SELECT benchmark_id, model_id, count(*) AS n, round(avg(spans), 6) AS mean FROM g JOIN score_records r USING (record_id) WHERE benchmark_id IS NOT NULL AND model_id IS NOT NULL GROUP BY 1, 2"),
    "ag28_tagger_costs": (_ITEMS, f"SELECT tagger, total, round(valid / total, 6) AS valid_rate, round(cost / total, 6) AS cost_per_item, round((SELECT cost / total FROM c WHERE tagger = '{TEACHER}') / nullif(cost / total, 0), 6) AS ratio FROM c"),
    "ag29_calibration": (_ITEMS, f"SELECT tagger, benchmark, max(items) AS items, round(coalesce({_R.format('theirs', 'ours')}, 0), 5) + 0.0 AS correlation, round(count(*) FILTER (a <= 3 AND c <= 3) / 3, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY tagger, benchmark ORDER BY theirs DESC, axis) AS a, row_number() OVER (PARTITION BY tagger, benchmark ORDER BY ours DESC, axis) AS c FROM (SELECT tagger, benchmark, axis, round(avg(theirs), 8) AS theirs, round(avg(ours), 8) AS ours, count(*) AS items FROM paired GROUP BY ALL)) GROUP BY 1, 2"),
    "ag29_decoding": (_ITEMS, f"SELECT tagger, benchmark, round(coalesce({_R.format('a', 'b')}, 0), 5) + 0.0 AS correlation FROM (SELECT x.tagger, x.benchmark, x.axis, round(avg(x.weight), 8) AS a, round(avg(z.weight), 8) AS b FROM items x JOIN items z ON x.pass = 1 AND z.pass = 2 AND x.tagger = z.tagger AND x.benchmark = z.benchmark AND x.item = z.item AND x.axis = z.axis GROUP BY ALL) GROUP BY 1, 2"),
    "ag30_consensus": (_ITEMS, "SELECT candidate, round(avg(worst), 6) AS consensus, round(min(worst), 6) AS minimum, min(worst) >= 0.8 AS passes FROM (SELECT candidate, teacher, min(cosine) AS worst FROM (SELECT c.tagger AS candidate, h.tagger AS teacher, c.benchmark, coalesce(sum(c.weight * h.weight) / nullif(sqrt(sum(c.weight * c.weight)) * sqrt(sum(h.weight * h.weight)), 0), 0) AS cosine FROM prof c JOIN prof h ON h.tagger IN ('manual', 'tech_report') AND h.benchmark = c.benchmark AND h.axis = c.axis WHERE c.tagger NOT IN ('manual', 'tech_report') GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"),
    "ag31_partial_correlation": ("", f", x AS (SELECT s, r, (a.category = b.category)::INT::DOUBLE AS same FROM pt JOIN benchmarks a ON a.id = p JOIN benchmarks b ON b.id = q), m AS (SELECT avg(s) AS ms, avg(r) AS mr, avg(same) AS md, coalesce(covar_pop(s, same) / nullif(var_pop(same), 0), 0) AS bs, coalesce(covar_pop(r, same) / nullif(var_pop(same), 0), 0) AS br FROM x) SELECT count(*) AS n, round(coalesce({_R.format('s', 'r')}, 0), 6) + 0.0 AS by_tag, round(coalesce({_R.format('same', 'r')}, 0), 6) + 0.0 AS by_domain, round(coalesce({_R.format('es', 'er')}, 0), 6) + 0.0 AS partial, round(avg(r) FILTER (same = 1), 6) + 0.0 AS same_mean, round(avg(r) FILTER (same = 0), 6) + 0.0 AS cross_mean FROM (SELECT *, s - (ms + bs * (same - md)) AS es, r - (mr + br * (same - md)) AS er FROM x, m)"),
    "ag33_model_probe": ("", f", cm AS MATERIALIZED (SELECT * FROM cs), tm AS MATERIALIZED (SELECT p, q, round(s, 6) AS s FROM ts), dr AS (SELECT d.model AS dropped, c.p, c.q, rank() OVER (PARTITION BY d.model, c.p, c.q ORDER BY c.x) + (count(*) OVER (PARTITION BY d.model, c.p, c.q, c.x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY d.model, c.p, c.q ORDER BY c.y) + (count(*) OVER (PARTITION BY d.model, c.p, c.q, c.y) - 1) / 2.0 AS ry FROM cm c JOIN (SELECT p, q, model FROM cm) d ON d.p = c.p AND d.q = c.q AND d.model <> c.model), changed AS MATERIALIZED (SELECT dropped, p, q, CASE WHEN count(*) >= 4 THEN round({_R.format('rx', 'ry')}, 6) END AS r FROM dr GROUP BY 1, 2, 3), whole AS MATERIALIZED (SELECT p, q, s, round(r, 6) AS r FROM rs JOIN tm USING (p, q) WHERE common_count >= 4 AND r IS NOT NULL), ms AS (SELECT DISTINCT model AS dropped FROM cm), every AS (SELECT m.dropped, w.s, w.r FROM ms m, whole w WHERE (m.dropped, w.p, w.q) NOT IN (SELECT model, p, q FROM cm) UNION ALL SELECT dropped, s, r FROM changed JOIN tm USING (p, q) WHERE r IS NOT NULL), pr AS (SELECT dropped, count(*)::DOUBLE AS n_pairs, avg((s - r) ** 2) AS l_align, {_R.format('s', 'r')} AS rho_p FROM every GROUP BY 1) SELECT metric, count(v) AS probes, round(avg(v), 5) + 0.0 AS mean, round(min(v), 5) + 0.0 AS least, round(max(v), 5) + 0.0 AS most FROM (SELECT 'l_align' AS metric, l_align AS v FROM pr UNION ALL SELECT 'rho_p', rho_p FROM pr UNION ALL SELECT 'n_pairs', n_pairs FROM pr) GROUP BY 1"),
    "ag35_fold_diagnostics": (_PT, _SEEDS),
    "tk14_best_seed": (_PT, f"SELECT seed, row_number() OVER (ORDER BY least_pairs DESC, least_ends DESC, pairs DESC, seed) AS place FROM ({_SEEDS})"),
    "ag36_kfold_gate": (_ITER, f"SELECT *  REPLACE (round(l_align, 6) AS l_align, round(rho_s, 6) + 0.0 AS rho_s), concat_ws(',', {_BLOCK('test', 'n_pairs', 'effective', 'l_align', 'rho_s')}) AS faults FROM (SELECT fold, count(*) AS iterations, min(n_pairs) AS n_pairs, min(effective) AS effective, avg(l_align) AS l_align, avg(rho_s) AS rho_s FROM iters WHERE scope = 'test' GROUP BY 1)"),
    "ag37_best_run": (_ITER, "SELECT run_id, status, l_align, rho_s, delta_tag, folds FROM (SELECT *, CASE WHEN rho_s >= 0.5 THEN 'pass' WHEN rho_s < 0.2 THEN 'fail' END AS status FROM (SELECT printf('fold-%04d', fold) AS run_id, round(avg(l_align), 6) AS l_align, round(avg(rho_s), 6) AS rho_s, round(avg(delta_tag), 6) AS delta_tag, count(*) AS folds FROM iters WHERE scope = 'dev' GROUP BY fold)) ORDER BY CASE status WHEN 'pass' THEN 0 WHEN 'fail' THEN 2 ELSE 1 END, l_align NULLS LAST, rho_s DESC NULLS LAST, delta_tag DESC NULLS LAST, folds DESC, run_id DESC LIMIT 5"),
    "ag38_subset_ranking": ("", ", g AS (SELECT model, coalesce(avg(score) FILTER (benchmark IN (SELECT id FROM benchmarks WHERE category = 'math')), avg(score)) * 100 AS s, avg(score) * 100 AS f, count(*) OVER () AS n FROM y WHERE benchmark IN (SELECT id FROM benchmarks WHERE scale = 'percent') GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY s DESC, model) AS a, row_number() OVER (ORDER BY f DESC, model) AS b FROM g) SELECT model, a AS subset_rank, round(s, 1) AS subset_score, b AS full_rank, round(f, 1) AS full_score, round(greatest(0, a - b) / greatest(1, n), 3) AS regret, round(1 - least(0.5, abs(s - f) / 100), 3) AS reliability FROM p WHERE a <= 8"),
    "ag40_suite_coverage": ("", "SELECT tag, round(c, 6) AS coverage, CASE WHEN c >= 0.15 THEN 'strong' ELSE 'weak' END AS rating FROM (SELECT tag, coalesce(sum(weight) FILTER (benchmark IN (SELECT id FROM benchmarks WHERE category = 'coding')), 0) / (SELECT count(*) FROM benchmarks WHERE category = 'coding') AS c FROM tw GROUP BY 1)"),
    "ag43_projection": ("", ", f AS (SELECT benchmark, model FROM y UNION SELECT benchmark, model FROM scores WHERE benchmark IS NOT NULL AND model IS NOT NULL), n AS (SELECT a.bucket, count(*) AS now FROM (SELECT p, q FROM cs GROUP BY 1, 2 HAVING count(*) >= 6) c JOIN bk a ON a.benchmark = p JOIN bk b ON b.benchmark = q AND a.bucket = b.bucket GROUP BY 1), z AS (SELECT a.bucket, count(*) AS projected FROM (SELECT a.benchmark AS p, b.benchmark AS q FROM f a JOIN f b ON a.model = b.model AND a.benchmark < b.benchmark GROUP BY 1, 2 HAVING count(*) >= 6) c JOIN bk a ON a.benchmark = p JOIN bk b ON b.benchmark = q AND a.bucket = b.bucket GROUP BY 1) SELECT bucket, coalesce(now, 0) AS now, coalesce(projected, 0) AS projected FROM (SELECT DISTINCT bucket FROM bk) LEFT JOIN n USING (bucket) LEFT JOIN z USING (bucket)"),
    "ag44_iteration_decisions": ("", "SELECT run_id, round(m, 6) AS mean, CASE WHEN best IS NULL OR m > best + 1e-12 THEN 'accepted' ELSE 'rejected' END AS decision, abs(round(m, 4) - m) > 1e-9 AS mismatch FROM (SELECT *, max(m) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT run_id, round(avg(score), 8) AS m FROM scores WHERE score >= 0 AND NOT isnan(score) AND score <= 1 AND run_id IS NOT NULL GROUP BY 1))"),
    "ag45_regraded": ("", "SELECT benchmark, model, n, d + 0.0 AS delta, abs(d) <= 0.02 AS within FROM (SELECT benchmark, model, n, round(x / 100 - score, 6) AS d FROM y JOIN (SELECT benchmark_id AS benchmark, model_id AS model, avg(score) AS x, count(*) AS n FROM score_records WHERE NOT isnan(score) AND score BETWEEN 1 AND 100 GROUP BY 1, 2) r USING (benchmark, model))"),
    "ag46_success": (f"{_ITER}, {_replayed(-1.0, None, None)}", "SELECT count(*) AS folds, count(*) FILTER (best <> first) AS moved, count(*) FILTER (best_l < base_l) AS better, count(*) FILTER (best <> first) = count(*) AND count(*) FILTER (best_l < base_l) = count(*) AS success FROM (SELECT fold, arg_max(best, iter) AS best FROM rep GROUP BY 1) l JOIN (SELECT fold, arg_min(dev_l, iter) FILTER (dev_l IS NOT NULL) AS base_l, min(iter) AS first FROM cand GROUP BY 1) b USING (fold) LEFT JOIN (SELECT fold, iter, dev_l AS best_l FROM cand) t ON t.fold = l.fold AND t.iter = l.best"),
    "jn12_paired_items": (_ITEMS, "SELECT tagger, benchmark, count(DISTINCT item) AS items, round(avg(abs(ours - theirs)), 6) AS gap FROM paired GROUP BY 1, 2"),
    "it1_replay": (f"{_ITER}, {_replayed(-0.05, 0.1, 0.05)}", "SELECT fold, iter, improved, reason, stall, best FROM rep"),
    "it2_stability": (_ITER, "SELECT fold, iter, round(l, 6) AS l_max, round(r, 6) AS rho_min, round(l - 0.3 * coalesce(r, 0), 6) + 0.0 AS stability FROM (SELECT fold, iter, greatest(train_l, dev_l) + 0.01 * abs(tag_count - 6) AS l, least(train_rho, dev_rho) AS r FROM cand)"),
    "it3_adoption": (_ITER, ", ".join(()) + "SELECT m.fold, m.iter, concat_ws(',', CASE WHEN NOT coalesce(m.l_align < f.l_align, false) THEN 'l_align_not_improved' END, CASE WHEN NOT coalesce(m.rho_p >= f.rho_p - 0.02, false) THEN 'rho_p_drop_exceeded' END, CASE WHEN NOT coalesce(m.delta_tag >= f.delta_tag - 0.05, false) THEN 'delta_tag_drop_exceeded' END, CASE WHEN NOT coalesce(m.residual_max <= f.residual_max, false) THEN 'residual_max_increase_exceeded' END) AS against, CASE WHEN m.n_pairs < 3 THEN 'too_few_pairs' ELSE coalesce(nullif(concat_ws(',', CASE WHEN m.residual_max >= 0.5 THEN 'residual_max_met' END, CASE WHEN m.residual_mean >= 0.05 THEN 'residual_mean_met' END, CASE WHEN m.l_align >= 0.01 THEN 'l_align_met' END), ''), 'nothing_met') END AS trigger FROM (SELECT * FROM iters WHERE scope = 'dev') m JOIN (SELECT * FROM iters WHERE scope = 'dev' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY iter) = 1) f ON f.fold = m.fold"),
    "it7_candidates": (_ITER, "SELECT * FROM cand"),
    "it8_guard": (_ITER, "SELECT fold, iter, CASE WHEN NOT coalesce(delta_tag > -0.05 OR abs(delta_tag + 0.05) <= 1e-12, false) THEN 'delta_tag_gate_failed' WHEN NOT coalesce(dev_rho >= 0.3, false) THEN 'dev_rho_floor_failed' WHEN NOT coalesce(train_rho >= 0.4, false) THEN 'train_rho_floor_failed' END AS reason FROM cand"),
    "it9_schedule": (_ITER, "SELECT fold, iter, [8, 12, 16][(greatest(iter, 1) - 1) % 3 + 1] AS target, role, (7 + off + iter)::INT AS seed FROM cand, (VALUES ('executer', 100000), ('maker', 200000), ('improver', 300000), ('taxonomy', 400000), ('judge', 0)) v(role, off)"),
    "fl19_gate": ("", ", w AS (SELECT a.bucket, p, s, r FROM pt JOIN bk a ON a.benchmark = p JOIN bk b ON b.benchmark = q AND a.bucket = b.bucket), k AS (SELECT bucket, quantile_cont(s, 0.3) AS lo, quantile_cont(s, 0.7) AS hi FROM w GROUP BY 1) SELECT bucket, d + 0.0 AS delta_tag, coalesce(d > 0, false) AS at_zero, coalesce(d > -0.05 OR abs(d + 0.05) <= 1e-12, false) AS at_minus, coalesce(d > 0.5, false) AS at_half, c BETWEEN 5 AND 30 AS by_count FROM (SELECT w.bucket, round(avg(r) FILTER (s >= hi) - avg(r) FILTER (s <= lo), 6) AS d, count(DISTINCT p) AS c FROM w JOIN k ON k.bucket = w.bucket GROUP BY 1)"),
    "fl20_faults": (_ITER, f"SELECT fold, iter, concat_ws(',', {_BLOCK('dev', 'dn', 'de', 'dl', 'dr')}, {_BLOCK('test', 'tn', 'te', 'tl', 'tr')}, CASE WHEN dr IS NULL THEN 'pooled_rho_s_not_finite' END, CASE WHEN dr < 0.2 THEN 'pooled_rho_s_below_floor' END, CASE WHEN dl IS NULL THEN 'pooled_p_not_finite' END, CASE WHEN dl > 0.05 THEN 'pooled_p_above_alpha' END, CASE WHEN tn IS NULL THEN 'pooled_n_pairs_missing' END, CASE WHEN tn <= 0 THEN 'pooled_n_pairs_empty' END) AS faults FROM (SELECT fold, iter, " + ", ".join(f"max({c}) FILTER (scope = '{x}') AS {x[0]}{k}" for x in ("dev", "test") for c, k in (("n_pairs", "n"), ("effective", "e"), ("l_align", "l"), ("rho_s", "r"))) + " FROM iters GROUP BY 1, 2)"),
    "cl3_subset_fidelity": ("", "SELECT model, round(sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 6) AS fidelity FROM (SELECT model, tag, sum(score_pct * weight) AS a, coalesce(sum(score_pct * weight) FILTER (benchmark IN (SELECT id FROM benchmarks WHERE category IN ('math', 'coding', 'general'))), 0) AS b FROM ns JOIN tw USING (benchmark) GROUP BY 1, 2) GROUP BY 1"),
    "tk16_evaluated": ("", ", nb AS (SELECT a, b, sim FROM (SELECT p AS a, q AS b, round(s, 8) AS sim FROM ts UNION ALL SELECT q, p, round(s, 8) FROM ts) QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 3), pr AS (SELECT 'near' AS how, a AS benchmark, model, round(sum(sim * score) / sum(sim), 7) AS v FROM nb JOIN y ON y.benchmark = nb.b GROUP BY 2, 3 UNION ALL SELECT 'domain', benchmark, model, round((sum(score) OVER w - score) / nullif(count(*) OVER w - 1, 0), 7) FROM y JOIN benchmarks b ON b.id = benchmark WINDOW w AS (PARTITION BY category, model) UNION ALL SELECT 'overall', benchmark, model, round((sum(score) OVER w - score) / nullif(count(*) OVER w - 1, 0), 7) FROM y WINDOW w AS (PARTITION BY model)), rk AS (SELECT how, benchmark, rank() OVER (PARTITION BY how, benchmark ORDER BY score) + (count(*) OVER (PARTITION BY how, benchmark, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY how, benchmark ORDER BY v) + (count(*) OVER (PARTITION BY how, benchmark, v) - 1) / 2.0 AS b FROM pr JOIN y USING (benchmark, model) WHERE v IS NOT NULL), g AS (SELECT how, benchmark, count(*) AS models, CASE WHEN count(*) >= 4 THEN round(" + _R.format("a", "b") + ", 5) + 0.0 END AS rho FROM rk GROUP BY 1, 2) SELECT n.benchmark, n.models, n.rho AS near, d.rho AS domain, o.rho AS overall FROM g n LEFT JOIN g d ON d.benchmark = n.benchmark AND d.how = 'domain' LEFT JOIN g o ON o.benchmark = n.benchmark AND o.how = 'overall' WHERE n.how = 'near'"),
    "tk9_model_ranking": ("", "SELECT model, relevance, row_number() OVER (ORDER BY relevance DESC, model) AS place FROM (SELECT model, round(coalesce(sum(w * CASE tag WHEN 'manual' THEN 1 WHEN 'tech_report' THEN 0.5 ELSE 0 END) / nullif(sqrt(sum(w * w)) * sqrt(1.25), 0), 0), 5) AS relevance FROM (SELECT model, tag, round(sum(score_pct * weight) / sum(weight), 6) AS w FROM ns JOIN tw USING (benchmark) WHERE weight <> 0 GROUP BY 1, 2) GROUP BY 1)"),
    "tk12_core_plans": ("", ", f AS (SELECT model, (SELECT count(DISTINCT benchmark) FROM y) - count(*) AS gap FROM y GROUP BY 1 ORDER BY count(*) DESC, model LIMIT 8), c AS (SELECT a.model AS x, b.model AS z, a.gap + b.gap AS g FROM f a JOIN f b ON a.model < b.model) SELECT s.x || ',' || s.z AS seen, h.x || ',' || h.z AS held, s.g AS missing_seen, h.g AS missing_held, s.g + h.g AS missing FROM c s JOIN c h ON s.x NOT IN (h.x, h.z) AND s.z NOT IN (h.x, h.z) ORDER BY missing, missing_held, missing_seen, s.x, s.z, h.x, h.z LIMIT 20"),
    "sp2_plain_folds": ("", "SELECT id, (CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END)::INT AS fold FROM (SELECT id, row_number() OVER (ORDER BY md5('3|' || id), id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM benchmarks))"),
    "sp5_model_split": ("", f", m AS (SELECT id, md5('11|' || id) AS h, md5('12|' || id) AS h2, {_FAMILY} AS f FROM (SELECT DISTINCT id FROM models)), g AS (SELECT *, count(*) OVER (PARTITION BY f) AS size, row_number() OVER (PARTITION BY f ORDER BY h, id) AS i, count(*) OVER () AS n FROM m), k AS (SELECT *, round_even(n * 0.75, 0) AS want, size > 1 AND i <= greatest(1, least(size - 1, round_even(size * 0.75, 0))) AS pick FROM g), j AS (SELECT *, count(*) FILTER (pick) OVER () AS s, sum((size = 1)::INT) OVER (ORDER BY h, id ROWS UNBOUNDED PRECEDING) AS o FROM k), q AS (SELECT *, pick OR (size = 1 AND s + o <= want) AS p2 FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY p2 ORDER BY h2, id) AS z, count(*) FILTER (p2) OVER () AS s2 FROM q) SELECT id, CASE WHEN CASE WHEN p2 THEN z <= want ELSE z <= want - s2 END THEN 'seen' ELSE 'held' END AS scope FROM r"),
    "rs1_bootstrap": (_RS1, _MEASURED),
    "rs2_block_bootstrap": (_RS2, _MEASURED),
    "rs3_interval": (_RS1, f"SELECT metric, round(avg(v), 5) + 0.0 AS mean, round(stddev_pop(v), 5) AS sd, round(quantile_cont(v, 0.025), 5) + 0.0 AS low, round(quantile_cont(v, 0.975), 5) + 0.0 AS high FROM (SELECT l_align, l_align_01, rho_p, rho_s, delta_tag FROM ({_MEASURED})) UNPIVOT (v FOR metric IN (l_align, l_align_01, rho_p, rho_s, delta_tag)) GROUP BY 1"),
    "rs4_sign_flips": ("", ", d AS MATERIALIZED (SELECT category, round(avg((s - r01) ** 2) - avg((s - r) ** 2), 6) AS x, row_number() OVER (ORDER BY category) - 1 AS i, count(*) OVER () AS n FROM pt JOIN benchmarks b ON b.id = p GROUP BY 1), f AS (SELECT m, sum(CASE WHEN (m >> i) & 1 = 1 THEN -x ELSE x END) / max(n) AS v FROM d, range(32768) t(m) WHERE m < 1 << n GROUP BY 1) SELECT (SELECT max(n) FROM d)::INT AS n, round((SELECT sum(x) / max(n) FROM d), 8) AS observed, round((count(*) FILTER (abs(v) >= abs((SELECT sum(x) / max(n) FROM d)) - 1e-12) + 1) / (count(*) + 1), 8) AS p_value FROM f"),
    "rs9_random_tags": ("", "SELECT id AS benchmark, tag, round(('0x' || md5('7|' || id || '|' || tag)[:8])::BIGINT / 4294967296.0, 9) AS weight FROM benchmarks, (VALUES ('a'), ('b'), ('c')) t(tag)"),
    "mx2_structure": (_ITEMS, f", pc AS MATERIALIZED (SELECT x.tagger, x.benchmark AS p, z.benchmark AS q, round(coalesce(sum(x.weight * z.weight) / nullif(sqrt(sum(x.weight * x.weight)) * sqrt(sum(z.weight * z.weight)), 0), 0), 8) AS c FROM prof x JOIN prof z ON x.tagger = z.tagger AND x.axis = z.axis AND x.benchmark < z.benchmark GROUP BY 1, 2, 3) SELECT x.tagger AS a, z.tagger AS b, count(*) AS pairs, round(coalesce({_R.format('x.c', 'z.c')}, 0), 5) + 0.0 AS correlation FROM pc x JOIN pc z ON x.p = z.p AND x.q = z.q AND x.tagger < z.tagger GROUP BY 1, 2"),
}
SQL = {}
for _k, (_c, _q) in _WITH.items():
    _head = f"WITH {BASE}" + (f", {_c.strip()}" if _c else "")
    SQL[_k] = _q if _q.startswith("WITH") else f"{_head} {_q}"
SQL["ag28_tagger_costs"] = SQL["ag28_tagger_costs"].replace(" SELECT tagger, total, round(valid", ", c AS (SELECT tagger, count(*) AS total, count(*) FILTER (score >= 0 AND NOT isnan(score)) AS valid, (sum(coalesce(length(config), 0)) * coalesce(any_value(trust), 1) + sum(coalesce(length(extra), 0)) * 2 * coalesce(any_value(trust), 1)) / 1000 AS cost FROM tg LEFT JOIN source_kinds k ON k.kind = tagger GROUP BY 1) SELECT tagger, total, round(valid")
