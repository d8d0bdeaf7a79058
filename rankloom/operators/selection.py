"""Choosing among iterations and runs: gates, comparisons, replay of a loop, quality of folds.

A candidate is a row with train_l, dev_l, train_rho, dev_rho (Spearman), dev_rho_p, delta_tag and tag_count; null and NaN say
that a number is missing. Comparisons hold beyond EPSILON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.semantics import reasons

EPSILON = 1e-12
# What a research-grade run needs.
LEAST_COMMON, LEAST_PAIRS, LEAST_ENDS, ALPHA, LEAST_RHO, LEAST_FOLD_RHO = 6, 10, 6, 0.05, 0.20, 0.0
# How far the seeds of the roles lie apart.
SEED_OFFSETS = {"executer": 100_000, "maker": 200_000, "improver": 300_000, "taxonomy": 400_000}


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def passes_delta(delta: Column, threshold: float) -> Column:
    """Strictly above the threshold; at it (within EPSILON) only if it is negative. False if missing."""
    over = delta > threshold
    return F.coalesce(~F.isnan(delta) & ((over | (F.abs(delta - threshold) <= EPSILON)) if threshold < 0 else over), F.lit(False))


def passes_count(count: Column, least: int | None = None, most: int | None = None) -> Column:
    ok = F.lit(True)
    if least is not None:
        ok = ok & (count >= least)
    if most is not None:
        ok = ok & (count <= most)
    return F.coalesce(ok, F.lit(False))


def better(c: Column, best: Column, threshold: float = 0.0, floor: float | None = None, drop: float | None = None, rise: float | None = None, tags: tuple[int | None, int | None] = (None, None)) -> Column:
    """Whether candidate ``c`` takes the place of ``best`` (structs; best null at first): it passes the gates, then dev loss,
    then dev correlation, then delta decide. ``floor`` and ``drop`` bound dev_rho, ``rise`` bounds train_l against the best."""
    gate = passes_delta(c["delta_tag"], threshold) & passes_count(c["tag_count"], *tags) & c["dev_l"].isNotNull()
    first = best.isNull() | best["dev_l"].isNull()
    if floor is not None:
        gate = gate & F.coalesce(c["dev_rho"] >= floor, F.lit(False))
        first = first | ~F.coalesce(best["dev_rho"] >= floor, F.lit(False))
    if drop is not None:
        gate = gate & (best.isNull() | (c["dev_rho"].isNotNull() & (best["dev_rho"].isNull() | (c["dev_rho"] >= best["dev_rho"] - drop))))
    if rise is not None:
        gate = gate & (best.isNull() | F.coalesce(c["train_l"] <= best["train_l"] + rise, F.lit(False)))
    more = lambda f: c[f].isNotNull() & (best[f].isNull() | (c[f] > best[f]))
    less = lambda f: best[f].isNotNull() & (c[f].isNull() | (best[f] > c[f]))
    wins = F.when(c["dev_l"] < best["dev_l"] - EPSILON, True).when(c["dev_l"] > best["dev_l"] + EPSILON, False).when(more("dev_rho_p"), True).when(less("dev_rho_p"), False).otherwise(more("delta_tag"))
    return F.coalesce(gate & (first | F.coalesce(wins, F.lit(False))), F.lit(False))


FIELDS = ("train_l", "dev_l", "train_rho", "dev_rho", "dev_rho_p", "delta_tag", "tag_count")


def replay(candidates: DataFrame, threshold: float = 0.0, **rules) -> DataFrame:
    """(fold, iter, improved, reason, stall, best): the loop over the iterations of each fold, replayed.

    ``stall`` counts iterations since the last improvement, ``best`` is the iteration that holds the place. A fold has as
    many iterations as its loop had rounds; they are folded in one array.
    """
    row = F.struct("iter", *[finite(F.col(f).cast("double")).alias(f) for f in FIELDS])
    kind = "struct<iter:int," + ",".join(f"{f}:double" for f in FIELDS) + ">"
    zero = F.struct(F.lit(None).cast(kind).alias("best"), F.lit(0).alias("stall"), F.array().cast("array<struct<iter:int,improved:boolean,reason:string,stall:int,best:int>>").alias("log"))

    def step(a, c):
        wins = better(c, a["best"], threshold, **rules)
        why = F.when(wins, "new_best").when(~passes_delta(c["delta_tag"], threshold), "delta_tag_gate_failed").when(a["best"].isNull(), "selection_gate_failed").otherwise("not_better_than_current_best")
        best, stall = F.when(wins, c).otherwise(a["best"]), F.when(wins, 0).otherwise(a["stall"] + 1)
        return F.struct(best.alias("best"), stall.alias("stall"), F.concat(a["log"], F.array(F.struct(c["iter"].alias("iter"), wins.alias("improved"), why.alias("reason"), stall.alias("stall"), best["iter"].alias("best")))).alias("log"))

    g = candidates.groupBy("fold").agg(F.sort_array(F.collect_list(row)).cast(f"array<{kind}>").alias("v"))
    return g.select("fold", F.explode(F.aggregate("v", zero, step)["log"]).alias("x")).select("fold", "x.*")


def candidates(iterations: DataFrame) -> DataFrame:
    """(fold, iter, FIELDS..., test_pairs): rows (fold, iter, scope, ...) of train, dev and test of an iteration side by side."""
    of = lambda scope, c: F.max(F.when(F.col("scope") == scope, F.col(c)))
    return iterations.groupBy("fold", "iter").agg(of("train", "l_align").alias("train_l"), of("dev", "l_align").alias("dev_l"), of("train", "rho_s").alias("train_rho"), of("dev", "rho_s").alias("dev_rho"), of("dev", "rho_p").alias("dev_rho_p"), of("dev", "delta_tag").alias("delta_tag"), F.max("tag_count").alias("tag_count"), F.coalesce(of("test", "n_pairs"), F.lit(0)).alias("test_pairs"))


def stability(c: DataFrame, target_tags: int, penalty: float, weight: float = 0.3) -> DataFrame:
    """``c`` with l_max (the greater loss and the penalty for each tag off the target), rho_min and the score l_max - weight * rho_min; missing numbers are left out."""
    l_max = F.greatest(finite(F.col("train_l")), finite(F.col("dev_l"))) + penalty * F.abs(F.col("tag_count") - target_tags)
    rho = F.least(finite(F.col("train_rho")), finite(F.col("dev_rho")))
    return c.withColumns({"l_max": l_max, "rho_min": rho, "stability": l_max - weight * F.coalesce(rho, F.lit(0.0))})


def adoption(fixed: str, new: str, least_gain: float = 0.0, rho_drop: float = 0.02, delta_drop: float = 0.05, residual_rise: float = 0.0) -> Column:
    """Reasons against taking the metrics in the struct ``new`` in place of those in ``fixed``; none: adopt."""
    a, b = (lambda f: finite(F.col(f"{fixed}.{f}"))), (lambda f: finite(F.col(f"{new}.{f}")))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(F.col(new).isNull(), F.array(F.lit("not_completed"))).otherwise(reasons(
        (no(b("l_align") < a("l_align") - least_gain), "l_align_not_improved"), (no(b("rho_p") >= a("rho_p") - rho_drop), "rho_p_drop_exceeded"),
        (no(b("delta_tag") >= a("delta_tag") - delta_drop), "delta_tag_drop_exceeded"), (no(b("residual_max") <= a("residual_max") + residual_rise), "residual_max_increase_exceeded")))


def trigger(n_pairs: Column, residual_max: Column, residual_mean: Column, l_align: Column, limits: tuple[float, float, float], least_pairs: int = 3) -> Column:
    """Reasons to refine a taxonomy, or the one for which not."""
    few = F.coalesce(n_pairs, F.lit(0)) < least_pairs
    met = reasons(*[(F.coalesce(finite(c) >= x, F.lit(False)), n) for c, x, n in zip((residual_max, residual_mean, l_align), limits, ("residual_max_met", "residual_mean_met", "l_align_met"))])
    return F.when(few, F.array(F.lit("too_few_pairs"))).when(F.size(met) == 0, F.array(F.lit("nothing_met"))).otherwise(met)


def skip_reason(threshold: float, dev_floor: float, train_floor: float) -> Column:
    """The first floor that a candidate's row misses, null if none: then a rewrite may be worth its cost."""
    under = lambda c, x: ~F.coalesce(finite(F.col(c)) >= x, F.lit(False))
    return F.when(~passes_delta(F.col("delta_tag"), threshold), "delta_tag_gate_failed").when(under("dev_rho", dev_floor), "dev_rho_floor_failed").when(under("train_rho", train_floor), "train_rho_floor_failed")


def target_count(counts: list[int], iteration: Column) -> Column:
    """The wanted number of tags goes round in the list (positive numbers, each once)."""
    clean = list(dict.fromkeys(int(c) for c in counts if int(c) > 0))
    return F.element_at(F.array(*map(F.lit, clean)), (F.pmod(F.greatest(iteration, F.lit(1)) - 1, F.lit(len(clean))) + 1).cast("int")) if clean else F.lit(None).cast("int")


def role_seed(base: int, role: Column, iteration: Column) -> Column:
    offset = F.create_map(*[F.lit(x) for kv in SEED_OFFSETS.items() for x in kv])
    return F.lit(base) + F.coalesce(F.try_element_at(offset, role), F.lit(0)) + F.coalesce(iteration, F.lit(0))


def block_faults(label: str, n_pairs: Column, ends: Column, loss: Column, rho: Column) -> list[tuple[Column, str]]:
    """Rules that say what the evidence of one split lacks."""
    return [
        (n_pairs.isNull(), f"{label}_missing"), (n_pairs < LEAST_PAIRS, f"{label}_n_pairs"), (ends < LEAST_ENDS, f"{label}_effective"),
        (n_pairs.isNotNull() & finite(loss).isNull(), f"{label}_l_align_not_finite"), (n_pairs.isNotNull() & finite(rho).isNull(), f"{label}_rho_s_not_finite"), (finite(rho) < LEAST_FOLD_RHO, f"{label}_rho_s_below_floor"),
    ]


def pooled_faults(rho: Column, p_value: Column, n_pairs: Column) -> Column:
    r, p = finite(rho), finite(p_value)
    return reasons((r.isNull(), "pooled_rho_s_not_finite"), (r < LEAST_RHO, "pooled_rho_s_below_floor"), (p.isNull(), "pooled_p_not_finite"), (p > ALPHA, "pooled_p_above_alpha"), (n_pairs.isNull(), "pooled_n_pairs_missing"), (n_pairs <= 0, "pooled_n_pairs_empty"))


def config_faults(config: dict) -> list[str]:
    """What keeps a run's settings from counting as strict."""
    out = []

    def least(key, x):
        v = config.get(key)
        if not isinstance(v, int) or isinstance(v, bool):
            out.append(f"missing:{key}")
        elif v < x:
            out.append(f"{key}:{v}<{x}")

    least("min_common_models", LEAST_COMMON)
    for part in ("train", "dev", "test"):
        least(f"min_{part}_valid_pairs", LEAST_PAIRS)
        least(f"min_{part}_effective_benchmarks", LEAST_ENDS)
    for key, want in (("require_held_model_test", True), ("score_model_scope", "seen"), ("fallback_to_seed", False), ("allow_uniform_fallback", False), ("json_contract_strict", True)):
        if config.get(key) != want or isinstance(config.get(key), bool) != isinstance(want, bool):
            out.append(f"{key}:{config.get(key)}")
    return out


def best_runs(runs: DataFrame, k: int = 1) -> DataFrame:
    """The k best of ``runs`` (run_id, status, l_align, rho_s, delta_tag, folds): passed before unjudged before failed ones, then least loss, greatest rho, delta, folds and id."""
    status = F.when(F.col("status") == "pass", 0).when(F.col("status") == "fail", 2).otherwise(1)
    return runs.orderBy(status, F.asc_nulls_last("l_align"), F.desc_nulls_last("rho_s"), F.desc_nulls_last("delta_tag"), F.desc("folds"), F.desc("run_id")).limit(k)


def running_best(rows: DataFrame, order: str, value: str, block_rows: int = 100_000) -> DataFrame:
    """``rows`` with ``before``: the greatest value of all rows earlier in the order, in two steps over ranges of the order."""
    from pyspark.sql import Window as W

    from rankloom.runtime import small, stash

    n = max(1, -(-rows.count() // block_rows))
    ranged = stash(rows.repartitionByRange(n, order).withColumn("_block", F.spark_partition_id()), "ranged")
    tops = ranged.groupBy("_block").agg(F.max(value).alias("_top"))
    earlier = tops.select("_block", F.max("_top").over(W.partitionBy(F.lit(1)).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"))  # one row for each block
    inside = F.max(value).over(W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return ranged.withColumn("_inside", inside).join(small(earlier), "_block").withColumn("before", F.greatest("_inside", "_earlier")).drop("_block", "_inside", "_earlier")
