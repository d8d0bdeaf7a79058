"""Studies over bounded tables: resampling of pairs and items, taggers against each other, stability, folds and plans.

Pairs are bounded by the benchmark catalog and items by the catalogs of taggers, benchmarks and models, so both travel to
the executors after a check of their size; replicates, probes, candidates and seeds are what is distributed. Draws come
from md5 of the seed, the replicate and the position, the same in every engine, unless a docstring says otherwise.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.semantics import pearson
from rankloom.operators.board import hash_order
from rankloom.runtime import catalog_rows, small

METRICS = ("l_align", "l_align_01", "rho_p", "rho_s", "delta_tag")
#: Pairs and item weights that executors hold at most.
PAIRS, ITEMS = 500_000, 2_000_000


def ranks(x: np.ndarray) -> np.ndarray:
    """0-based average ranks."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - n + (n - 1) / 2)[at]


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson; None below three values or if either side is constant."""
    if len(x) < 3 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    return float(np.corrcoef(x, y)[0, 1])


def metrics(s: np.ndarray, r: np.ndarray, low: float = 0.3, high: float = 0.7) -> list[float | None]:
    """METRICS of paired similarities by tags and by ranks."""
    if not len(s):
        return [None] * len(METRICS)
    lo, hi = np.quantile(s, [low, high])
    up, down = r[s >= hi], r[s <= lo]
    gap = float(up.mean() - down.mean()) if len(up) and len(down) else None
    return [float(((s - r) ** 2).mean()), float(((s - (r + 1) / 2) ** 2).mean()), correlation(s, r), correlation(ranks(s), ranks(r)), gap]


def drawn(seed: int, b: int, size: int, of: int) -> np.ndarray:
    """``size`` places out of ``of``, with replacement."""
    return np.array([int(hashlib.md5(f"{seed}|{b}|{i}".encode()).hexdigest()[:8], 16) % of for i in range(size)], dtype=np.int64)


def _pairs(pairs: DataFrame) -> tuple[list, list, np.ndarray, np.ndarray]:
    rows = sorted(catalog_rows(pairs.select("p", "q", "s", "r"), PAIRS))
    return [x.p for x in rows], [x.q for x in rows], np.array([x.s for x in rows]), np.array([x.r for x in rows])


def _each(spark: SparkSession, n: int, run, schema: str) -> DataFrame:
    """``run(b)`` gives rows, for b from 1 to n on all executors."""
    names = spark.createDataFrame([], schema).columns

    def work(batches):
        for pdf in batches:
            yield pd.DataFrame([row for b in pdf["id"] for row in run(int(b))], columns=names)

    return spark.range(1, n + 1, numPartitions=spark.sparkContext.defaultParallelism).mapInPandas(work, schema)


_ROW = "b bigint, n bigint, " + ", ".join(f"{m} double" for m in METRICS)


def pair_bootstrap(pairs: DataFrame, draws: int, seed: int) -> DataFrame:
    """(b, n, METRICS): each replicate takes as many pairs as there are, with replacement."""
    _, _, s, r = _pairs(pairs)

    def run(b):
        at = drawn(seed, b, len(s), len(s)) if len(s) else np.zeros(0, dtype=int)
        return [(b, len(at), *metrics(s[at], r[at]))]

    return _each(pairs.sparkSession, draws, run, _ROW)


def block_bootstrap(pairs: DataFrame, draws: int, seed: int) -> DataFrame:
    """(b, n, METRICS): each replicate draws as many benchmarks as there are; their pairs count once for each two of their
    draws, those of a benchmark with itself not at all."""
    p, q, s, r = _pairs(pairs)
    names = sorted({*p, *q})
    at = {x: i for i, x in enumerate(names)}
    pi, qi = np.array([at[x] for x in p], dtype=int), np.array([at[x] for x in q], dtype=int)

    def run(b):
        n = np.bincount(drawn(seed, b, len(names), len(names)), minlength=len(names)) if names else np.zeros(0, dtype=int)
        w = n[pi] * n[qi] if len(pi) else np.zeros(0, dtype=int)
        return [(b, int(w.sum()), *metrics(np.repeat(s, w), np.repeat(r, w)))]

    return _each(pairs.sparkSession, draws, run, _ROW)


def intervals(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """(metric, mean, sd, low, high) over the replicates that have the metric."""
    a = (1 - level) / 2
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")
    q = F.percentile("x.v", F.array(F.lit(a), F.lit(1 - a)))
    return replicates.select(each).groupBy("x.metric").agg(F.avg("x.v").alias("mean"), F.stddev_pop("x.v").alias("sd"), q.alias("q")).select("metric", "mean", "sd", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def permutation_test(pairs: DataFrame, draws: int, seed: int, group: str | None = None) -> DataFrame:
    """(metric, draws, observed, p_two_sided, p_low, null_mean, null_sd) of rho_p, rho_s and l_align against shuffles of r.

    With ``group`` r is shuffled within the groups of a column of ``pairs`` and the pooled pairs are measured. p are add-one
    shares, null_sd has n - 1. Draws come from numpy's generator, seeded by the replicate.
    """
    rows = sorted(catalog_rows(pairs.select(*([group] if group else [F.lit("").alias("g")]), "p", "q", "s", "r"), PAIRS))
    g, s, r = np.unique([str(x[0]) for x in rows], return_inverse=True)[1], np.array([x.s for x in rows]), np.array([x.r for x in rows])
    rank_s, rank_r = ranks(s), ranks(r)
    order = np.argsort(g, kind="stable")

    def measured(at):
        return correlation(s, r[at]), correlation(rank_s, rank_r[at]), float(((s - r[at]) ** 2).mean()) if len(s) else None

    def run(b):
        rng = np.random.default_rng([seed, b])
        at = np.empty(len(s), dtype=int)
        at[order] = order[np.lexsort((rng.random(len(s)), g[order]))]
        return [(b, *measured(at))]

    null = _each(pairs.sparkSession, draws, run, "b bigint, rho_p double, rho_s double, l_align double")
    out = None
    for name, seen in zip(("rho_p", "rho_s", "l_align"), measured(np.arange(len(s)))):
        if seen is None:
            continue
        v = F.col(name)
        one = null.agg(F.count(v).alias("draws"), F.count_if(F.abs(v) >= abs(seen)).alias("k"), F.count_if(v <= seen).alias("low"), F.avg(v).alias("null_mean"), F.stddev_samp(v).alias("null_sd"))
        one = one.select(F.lit(name).alias("metric"), "draws", F.lit(float(seen)).alias("observed"), ((F.col("k") + 1) / (F.col("draws") + 1)).alias("p_two_sided"), ((F.col("low") + 1) / (F.col("draws") + 1)).alias("p_low"), "null_mean", "null_sd")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else pairs.sparkSession.createDataFrame([], "metric string, draws bigint, observed double, p_two_sided double, p_low double, null_mean double, null_sd double")


def sign_flips(deltas: DataFrame, most: int = 20) -> DataFrame:
    """(n, observed, p_value): all 2^n signs of up to ``most`` paired differences (name, delta), two-sided, add-one."""
    rows = sorted(catalog_rows(deltas.where("delta is not null and not isnan(delta)").select("name", "delta"), most))
    n, d = len(rows), F.array(*[F.lit(float(r.delta)) for r in rows])
    if not n:
        return deltas.sparkSession.createDataFrame([], "n int, observed double, p_value double")
    seen = sum(r.delta for r in rows) / n
    flipped = F.aggregate(F.transform(d, lambda x, i: F.when(F.col("id").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x) / n
    hits = deltas.sparkSession.range(1 << n).agg(F.count_if(F.abs(flipped) >= abs(seen) - 1e-12).alias("k"))
    return hits.select(F.lit(n).alias("n"), F.lit(float(seen)).alias("observed"), ((F.col("k") + 1) / ((1 << n) + 1)).alias("p_value"))


def probes(common: DataFrame, similarity: DataFrame, min_common: int) -> DataFrame:
    """(dropped, n_pairs, l_align, rho_p): the alignment without each model in turn, for all models.

    ``common`` (p, q, model, x, y), ``similarity`` (p, q, s). Only pairs that have a model change without it, so each pair
    gives its own sums once and the change for each of its models; ranks without a model follow from those with it.
    """
    packed = common.groupBy("p", "q").agg(F.sort_array(F.collect_list(F.struct("model", "x", "y"))).alias("v"))  # at most the catalog's models

    def run(batches):
        for pdf in batches:
            rows = []
            for p, q, s, v in zip(pdf["p"], pdf["q"], pdf["s"], pdf["v"]):
                x, y, k = np.array([e["x"] for e in v]), np.array([e["y"] for e in v]), len(v)
                rx, ry = ranks(x), ranks(y)
                whole = correlation_of(rx, ry) if k >= min_common else None
                if k - 1 >= min_common:
                    less = lambda z, r: r[None] - (z[:, None] < z[None]) - 0.5 * (z[:, None] == z[None])
                    a, b, off = less(x, rx), less(y, ry), ~np.eye(k, dtype=bool)
                    m = k - 1
                    sa, sb, saa, sbb, sab = ((z * off).sum(axis=1) for z in (a, b, a * a, b * b, a * b))
                    var = (saa - sa * sa / m) * (sbb - sb * sb / m)
                    r = np.where(var > 1e-9, (sab - sa * sb / m) / np.sqrt(np.maximum(var, 1e-300)), np.nan)
                else:
                    r = np.full(k, np.nan)
                rows.append((None, s, whole, 1))
                rows += [(e["model"], s, None if math.isnan(z) else float(z), 0) for e, z in zip(v, r)]
                rows += [(e["model"], s, whole, -1) for e in v]
            yield pd.DataFrame(rows, columns=["dropped", "s", "r", "sign"])

    parts = packed.join(similarity, ["p", "q"]).select("p", "q", "s", "v").mapInPandas(run, "dropped string, s double, r double, sign int").where("r is not null")
    w = F.when(F.col("sign") < 0, -1).otherwise(1)
    s, r = F.round("s", 6), F.round("r", 6)
    sums = {"n": w, "s": w * s, "r": w * r, "ss": w * s * s, "rr": w * r * r, "sr": w * s * r}
    g = parts.groupBy("dropped").agg(*[F.sum(e).alias(k) for k, e in sums.items()])
    whole = g.where("dropped is null").select(*[F.col(k).alias(f"_{k}") for k in sums])
    models = common.select(F.col("model").alias("dropped")).distinct()
    j = models.join(g, "dropped", "left").join(F.broadcast(whole))  # one row
    c = {k: F.coalesce(F.col(k), F.lit(0.0)) + F.col(f"_{k}") for k in sums}
    n = c["n"]
    cov, va, vb = c["sr"] / n - c["s"] * c["r"] / n / n, c["ss"] / n - c["s"] * c["s"] / n / n, c["rr"] / n - c["r"] * c["r"] / n / n
    return j.select("dropped", n.cast("bigint").alias("n_pairs"), ((c["ss"] - 2 * c["sr"] + c["rr"]) / n).alias("l_align"), F.try_divide(cov, F.nullif(F.sqrt(F.greatest(va * vb, F.lit(0.0))), F.lit(0.0))).alias("rho_p"))


def correlation_of(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson; None if either side is constant."""
    return None if np.ptp(x) == 0 or np.ptp(y) == 0 else float(np.corrcoef(x, y)[0, 1])


def ranking_of(cells: DataFrame, predicted: DataFrame, least: int = 4) -> DataFrame:
    """(benchmark, models, rho): Spearman of predicted (benchmark, model, predicted) with true scores, over the models that have both; null below ``least``."""
    from rankloom.functions.semantics import average_rank

    j = cells.join(predicted, ["benchmark", "model"]).where("predicted is not null")
    r = j.select("benchmark", average_rank("score", "benchmark").alias("a"), average_rank("predicted", "benchmark").alias("b"))
    g = r.groupBy("benchmark").agg(F.count("*").alias("models"), pearson("a", "b").alias("rho"))
    return g.select("benchmark", "models", F.when(F.col("models") >= least, F.col("rho")).alias("rho"))


# taggers: items (tagger, pass, benchmark, item, axis, weight)


def item_profile(items: DataFrame) -> DataFrame:
    """(tagger, benchmark, axis, weight): mean over the items of all passes."""
    return items.groupBy("tagger", "benchmark", "axis").agg(F.round(F.avg("weight"), 8).alias("weight"))


def paired_items(items: DataFrame, teacher: str) -> DataFrame:
    """(tagger, benchmark, item, axis, theirs, ours): first-pass items of every other tagger that the teacher has as well."""
    one = items.where("pass = 1")
    t = one.where(F.col("tagger") == teacher).select("benchmark", "item", "axis", F.col("weight").alias("theirs"))
    return one.where(F.col("tagger") != teacher).select("tagger", "benchmark", "item", "axis", F.col("weight").alias("ours")).join(t, ["benchmark", "item", "axis"]).select("tagger", "benchmark", "item", "axis", "theirs", "ours")


def zero_pearson(x: str, y: str) -> Column:
    """Pearson, 0 if either side is constant."""
    return F.coalesce(pearson(x, y), F.lit(0.0))


def calibration(items: DataFrame, teacher: str, k: int = 5) -> DataFrame:
    """(tagger, benchmark, items, correlation, overlap): profiles on shared items against the teacher's: Pearson, and the share of the k strongest axes in common."""
    p = paired_items(items, teacher).groupBy("tagger", "benchmark", "axis").agg(F.round(F.avg("theirs"), 8).alias("theirs"), F.round(F.avg("ours"), 8).alias("ours"), F.count("*").alias("items"))
    place = lambda c: F.row_number().over(W.partitionBy("tagger", "benchmark").orderBy(F.desc(c), "axis"))
    p = p.withColumns({"_t": place("theirs"), "_o": place("ours")})
    return p.groupBy("tagger", "benchmark").agg(F.max("items").alias("items"), zero_pearson("theirs", "ours").alias("correlation"), (F.count_if((F.col("_t") <= k) & (F.col("_o") <= k)) / k).alias("overlap"))


def cosines(profile: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, cosine) of the columns a and b over the rows of each group; 0 for a zero vector."""
    g = profile.groupBy(*by).agg(F.sum(F.col(a) * F.col(b)).alias("_d"), F.sqrt(F.sum(F.col(a) * F.col(a))).alias("_a"), F.sqrt(F.sum(F.col(b) * F.col(b))).alias("_b"))
    return g.select(*by, F.coalesce(F.try_divide("_d", F.nullif(F.col("_a") * F.col("_b"), F.lit(0.0))), F.lit(0.0)).alias("cosine"))


def pair_cosines(profile: DataFrame) -> DataFrame:
    """(tagger, p, q, cosine) of every pair of a tagger's benchmarks."""
    a = profile.select("tagger", F.col("benchmark").alias("p"), "axis", F.col("weight").alias("a"))
    b = profile.select("tagger", F.col("benchmark").alias("q"), "axis", F.col("weight").alias("b"))
    return cosines(a.join(b, ["tagger", "axis"]).where("p < q"), ["tagger", "p", "q"], "a", "b")


def structure(profile: DataFrame) -> DataFrame:
    """(a, b, pairs, correlation): Pearson of the pair cosines of any two taggers over the pairs that both have."""
    c = pair_cosines(profile).withColumn("cosine", F.round("cosine", 8))
    x, y = c.select(F.col("tagger").alias("a"), "p", "q", F.col("cosine").alias("x")), c.select(F.col("tagger").alias("b"), "p", "q", F.col("cosine").alias("y"))
    return x.join(y, ["p", "q"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("pairs"), zero_pearson("x", "y").alias("correlation"))


def worst_cosines(profile: DataFrame, teachers: list[str]) -> DataFrame:
    """(candidate, teacher, worst): the least cosine over shared benchmarks of every tagger that is no teacher with each teacher."""
    t = profile.where(F.col("tagger").isin(*teachers)).select(F.col("tagger").alias("teacher"), "benchmark", "axis", F.col("weight").alias("b"))
    c = profile.where(~F.col("tagger").isin(*teachers)).select(F.col("tagger").alias("candidate"), "benchmark", "axis", F.col("weight").alias("a"))
    return cosines(c.join(t, ["benchmark", "axis"]), ["candidate", "teacher", "benchmark"], "a", "b").groupBy("candidate", "teacher").agg(F.min("cosine").alias("worst"))


def consensus(profile: DataFrame, teachers: list[str], least: float = 0.8) -> DataFrame:
    """(candidate, consensus, minimum, passes) over the teachers."""
    return worst_cosines(profile, teachers).groupBy("candidate").agg(F.avg("worst").alias("consensus"), F.min("worst").alias("minimum")).withColumn("passes", F.col("minimum") >= least)


def _item_arrays(items: DataFrame) -> tuple[dict, list[str]]:
    """{tagger: {benchmark: (items, axes)}}: bounded by the catalogs."""
    rows = catalog_rows(items.groupBy("tagger", "benchmark", "item", "axis").agg(F.avg("weight").alias("weight")), ITEMS)
    axes = sorted({r.axis for r in rows})
    at = {a: i for i, a in enumerate(axes)}
    found: dict = {}
    for r in rows:
        found.setdefault(r.tagger, {}).setdefault(r.benchmark, {}).setdefault(r["item"], np.zeros(len(axes)))[at[r.axis]] = r.weight
    return {t: {b: (sorted(v), np.array([v[i] for i in sorted(v)])) for b, v in bs.items()} for t, bs in found.items()}, axes


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def consensus_bootstrap(items: DataFrame, teachers: list[str], draws: int, seed: int, least: float = 0.8) -> DataFrame:
    """(candidate, low, high, p_pass, stable): items of both sides are drawn anew; interval of the least cosine over the
    teachers, how often it passes, and how often the same candidates win. numpy's draws, seeded by the replicate."""
    data, _ = _item_arrays(items)
    names = sorted(t for t in data if t not in teachers)

    def least_of(c, rng):
        out = []
        for t in teachers:
            worst = 1.0
            for b in sorted(data[c].keys() & data.get(t, {}).keys()):
                mean = lambda m: m[rng.integers(0, len(m), len(m))].mean(axis=0)
                worst = min(worst, _cosine(mean(data[c][b][1]), mean(data[t][b][1])))
            out.append(worst)
        return min(out)

    def point(c):
        return min(min((_cosine(data[c][b][1].mean(axis=0), data[t][b][1].mean(axis=0)) for b in data[c].keys() & data.get(t, {}).keys()), default=1.0) for t in teachers)

    winners = [c for c in names if point(c) >= least]

    def run(b):
        rng = np.random.default_rng([seed, b])
        got = {c: least_of(c, rng) for c in names}
        same = [c for c in names if got[c] >= least] == winners
        return [(b, c, v, same) for c, v in got.items()]

    r = _each(items.sparkSession, draws, run, "b bigint, candidate string, least double, same boolean")
    q = F.percentile("least", F.array(F.lit(0.025), F.lit(0.975)))
    return r.groupBy("candidate").agg(q.alias("q"), F.avg((F.col("least") >= least).cast("double")).alias("p_pass"), F.avg(F.col("same").cast("double")).alias("stable")).select("candidate", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "p_pass", "stable")


def gate_bootstrap(items: DataFrame, teacher: str, new: str, old: str, draws: int, seed: int) -> DataFrame:
    """(items, smoothed_new, smoothed_old, p_gt, low, high): two taggers on their shared items of each benchmark, drawn alike
    for both; the score is the mean cosine with the teacher's profile. p_gt: share of replicates in which the new one scores more."""
    data, _ = _item_arrays(items.where(F.col("tagger").isin(teacher, new, old)))
    pairs = []
    for b in sorted(data.get(new, {}).keys() & data.get(old, {}).keys() & data.get(teacher, {}).keys()):
        (ia, a), (ib, c) = data[new][b], data[old][b]
        both = sorted(set(ia) & set(ib))
        if both:
            pairs.append((a[[ia.index(i) for i in both]], c[[ib.index(i) for i in both]], data[teacher][b][1].mean(axis=0)))

    def run(b):
        rng = np.random.default_rng([seed, b])
        one, two = [], []
        for x, y, goal in pairs:
            at = rng.integers(0, len(x), len(x))
            one.append(_cosine(x[at].mean(axis=0), goal)), two.append(_cosine(y[at].mean(axis=0), goal))
        return [(b, float(np.mean(one)) if one else None, float(np.mean(two)) if two else None)]

    r = _each(items.sparkSession, draws, run, "b bigint, a double, c double")
    q = F.percentile(F.col("a") - F.col("c"), F.array(F.lit(0.025), F.lit(0.975)))
    return r.agg(F.lit(sum(len(x) for x, _, _ in pairs)).alias("items"), F.avg("a").alias("smoothed_new"), F.avg("c").alias("smoothed_old"), F.avg((F.col("a") > F.col("c")).cast("double")).alias("p_gt"), q.alias("q")).select("items", "smoothed_new", "smoothed_old", "p_gt", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def partial_correlation(pairs: DataFrame) -> DataFrame:
    """(n, by_tag, by_domain, partial, same_mean, cross_mean) of pairs (s, r, same): correlation of s and r once both are
    freed of the line through ``same`` (1.0 or 0.0)."""
    c = lambda x, y: F.covar_pop(x, y)
    g = pairs.agg(F.count("*").alias("n"), zero_pearson("s", "r").alias("by_tag"), zero_pearson("same", "r").alias("by_domain"), c("s", "r").alias("sr"), c("s", "same").alias("sd"), c("r", "same").alias("rd"), F.var_pop("s").alias("ss"), F.var_pop("r").alias("rr"), F.nullif(F.var_pop("same"), F.lit(0.0)).alias("dd"), F.avg(F.when(F.col("same") == 1, F.col("r"))).alias("same_mean"), F.avg(F.when(F.col("same") == 0, F.col("r"))).alias("cross_mean"))
    off = lambda a, b: F.coalesce(F.col(a) * F.col(b) / F.col("dd"), F.lit(0.0))
    top, bottom = F.col("sr") - off("sd", "rd"), F.sqrt((F.col("ss") - off("sd", "sd")) * (F.col("rr") - off("rd", "rd")))
    return g.select("n", "by_tag", "by_domain", F.coalesce(F.try_divide(top, F.nullif(bottom, F.lit(0.0))), F.lit(0.0)).alias("partial"), "same_mean", "cross_mean")


def procrustes(profiles: DataFrame, seed: str, reference: DataFrame) -> DataFrame:
    """(seed, residual, correlation): the reference matrix (benchmark, axis, weight) turned onto that of each seed; Frobenius
    norm of what is left, and mean correlation of the columns that aren't constant. Matrices are bounded by the catalogs."""
    ref = catalog_rows(reference.select("benchmark", "axis", "weight"))
    names, axes = sorted({r.benchmark for r in ref}), sorted({r.axis for r in ref})
    a = np.zeros((len(names), len(axes)))
    at, aat = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(axes)}
    for r in ref:
        a[at[r.benchmark], aat[r.axis]] = r.weight

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = np.zeros_like(a)
        for n, x, w in zip(pdf["benchmark"], pdf["axis"], pdf["weight"]):
            if n in at and x in aat:
                b[at[n], aat[x]] = w
        u, _, v = np.linalg.svd(a.T @ b, full_matrices=False)
        turned = a @ (u @ v)
        cors = [np.corrcoef(x, y)[0, 1] for x, y in zip(turned.T, b.T) if x.std() >= 1e-12 and y.std() >= 1e-12]
        return pd.DataFrame({"seed": [pdf[seed].iloc[0]], "residual": [float(np.linalg.norm(turned - b))], "correlation": [float(np.mean(cors)) if cors else None]})

    return profiles.select(F.col(seed).cast("string").alias(seed), "benchmark", "axis", "weight").groupBy(seed).applyInPandas(run, "seed string, residual double, correlation double")


def optimized_weights(tags: DataFrame, pairs: DataFrame, lower: float = 0.0, upper: float = 1.0, l2: float = 0.01, steps: int = 200, starts: int = 1, seed: int = 0) -> DataFrame:
    """(start, initial_loss, loss, clipped, weights): tag weights within bounds whose cosines come near to r, by projected
    gradient with backtracking; a penalty keeps them near where they began. Negative targets are 0 if weights can't be
    negative. The first start is the table, the others (numpy's draws) run beside it on the executors."""
    rows, ps = catalog_rows(tags.select("benchmark", "tag", "weight")), catalog_rows(pairs.where("r is not null").select("p", "q", "r"), PAIRS)
    names, axes = sorted({r.benchmark for r in rows}), sorted({r.tag for r in rows})
    at, aat = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(axes)}
    x0 = np.zeros((len(names), len(axes)))
    for r in rows:
        x0[at[r.benchmark], aat[r.tag]] = r.weight
    x0 = np.clip(x0, lower, upper)
    ps = [x for x in ps if x.p in at and x.q in at]
    i, j, goal = np.array([at[x.p] for x in ps], dtype=int), np.array([at[x.q] for x in ps], dtype=int), np.array([x.r for x in ps])
    clipped = int((goal < 0).sum()) if lower >= 0 else 0
    goal = np.clip(goal, 0.0 if lower >= 0 else -1.0, 1.0)

    def loss_of(x):
        n = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
        u = x / n[:, None]
        c = (u[i] * u[j]).sum(axis=1)
        e = c - goal
        loss = float((e**2).mean()) + l2 * float(((x - x0) ** 2).mean())
        g = np.zeros_like(x)
        f = 2 * e / len(e)
        np.add.at(g, i, f[:, None] * (u[j] - c[:, None] * u[i]) / n[i][:, None])
        np.add.at(g, j, f[:, None] * (u[i] - c[:, None] * u[j]) / n[j][:, None])
        return loss, g + 2 * l2 * (x - x0) / x.size

    def run(b):
        if not len(goal):
            return [(b, None, None, clipped, [])]
        x = x0 if b == 1 else np.random.default_rng([seed, b]).uniform(lower, upper, x0.shape)
        first = loss_of(x0)[0]
        loss, g = loss_of(x)
        step = 1.0
        for _ in range(steps):
            while step > 1e-9:
                y = np.clip(x - step * g, lower, upper)
                new, h = loss_of(y)
                if new < loss:
                    break
                step /= 2
            if step <= 1e-9 or loss - new < 1e-12:
                break
            x, loss, g, step = y, new, h, step * 2
        return [(b, first, loss, clipped, [(n, a, float(x[k, m])) for k, n in enumerate(names) for m, a in enumerate(axes)])]

    return _each(tags.sparkSession, starts, run, "start bigint, initial_loss double, loss double, clipped int, weights array<struct<benchmark:string,tag:string,weight:double>>")


def power_grid(spark: SparkSession, benchmarks: list[int], models: list[int], effects: list[float], draws: int, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(benchmarks, models, effect, draws, mean_rho, power): how often a planted correlation of two pair tables comes out as
    significant (one-sided, normal approximation of Spearman's rho). Cells of the grid are distributed, each with its own seed."""
    grid = [(n, m, e) for n in benchmarks for m in models for e in effects]

    def run(b):
        n, m, e = grid[b - 1]
        rng, rhos = np.random.default_rng(seed + b), []
        for _ in range(draws):
            shared, a, c = rng.normal(size=(3, n, m))
            tables = []
            for own in (a, c):
                x = math.sqrt(e) * shared + math.sqrt(1 - e) * own
                u = x / np.linalg.norm(x, axis=1, keepdims=True)
                tables.append((u @ u.T)[np.triu_indices(n, 1)])
            rhos.append(correlation(*map(ranks, tables)) or 0.0)
        cut = 1.6448536269514722 if alpha == 0.05 else 2.326347874
        k = n * (n - 1) // 2
        return [(n, m, e, draws, float(np.mean(rhos)), float(np.mean(np.array(rhos) * math.sqrt(k - 1) > cut)))]

    return _each(spark, len(grid), run, "benchmarks int, models int, effect double, draws int, mean_rho double, power double")


def random_tags(benchmarks: DataFrame, axes: list[str], seed: int) -> DataFrame:
    """(benchmark, tag, weight): uniform weights by hash, a baseline."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "benchmark", "tag")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return benchmarks.select("benchmark", F.explode(F.array(*map(F.lit, axes))).alias("tag")).select("benchmark", "tag", u.alias("weight"))


# splits


def plain_folds(names: DataFrame, name: str, k: int, seed: int) -> DataFrame:
    """(name, fold): names of a catalog in hash order, cut into k slices; the first ones are longer by one where it doesn't divide."""
    one = F.lit(1)
    r = names.select(name).distinct().select(name, (F.row_number().over(W.partitionBy(one).orderBy(hash_order(F.col(name), seed), name)) - 1).alias("_i"), F.count(one).over(W.partitionBy(one)).alias("_n"))
    base, long = F.floor(F.col("_n") / k), F.col("_n") % k
    edge = long * (base + 1)
    fold = F.when(F.col("_i") < edge, F.floor(F.col("_i") / (base + 1))).otherwise(long + F.floor((F.col("_i") - edge) / F.greatest(base, F.lit(1))))
    return r.select(name, fold.cast("int").alias("fold"))


def family_split(names: DataFrame, name: str, family: Column, share: float, seed: int) -> DataFrame:
    """(name, scope): 'seen' or 'held' with families on both sides. A family of several gives its rounded share, at least one to
    either side; single ones fill up the seen; then names move in hash order until the share of all is exact."""
    one = F.lit(1)
    h = hash_order(F.col(name), seed)
    m = names.select(name, family.alias("_f")).distinct()
    g = W.partitionBy("_f")
    m = m.withColumns({"_size": F.count(one).over(g), "_i": F.row_number().over(g.orderBy(h, name)), "_n": F.count(one).over(W.partitionBy(one))})
    want = F.bround(F.col("_n") * share).cast("bigint")
    k = F.greatest(F.lit(1), F.least(F.col("_size") - 1, F.bround(F.col("_size") * share).cast("bigint")))
    m = m.withColumns({"_want": want, "_seen": (F.col("_size") > 1) & (F.col("_i") <= k), "_one": F.col("_size") == 1})
    m = m.withColumns({"_s": F.count_if("_seen").over(W.partitionBy(one)), "_j": F.sum(F.col("_one").cast("int")).over(W.partitionBy(one).orderBy(h, name).rowsBetween(W.unboundedPreceding, 0))})
    m = m.withColumn("_seen", F.col("_seen") | (F.col("_one") & (F.col("_s") + F.col("_j") <= F.col("_want"))))
    m = m.withColumn("_k", F.row_number().over(W.partitionBy("_seen").orderBy(hash_order(F.col(name), seed + 1), name))).withColumn("_s", F.count_if("_seen").over(W.partitionBy(one)))
    seen = F.when(F.col("_seen"), F.col("_k") <= F.col("_want")).otherwise(F.col("_k") <= F.col("_want") - F.col("_s"))
    return m.select(name, F.when(seen, "seen").otherwise("held").alias("scope"))


def balanced_folds(pairs: DataFrame, names: DataFrame, k: int, seed: int, search: int = 5_000, least_pairs: int = 0, least_ends: int = 0) -> DataFrame:
    """(benchmark, fold, missing, worst, total): folds that keep benchmarks of opposite rankings apart.

    First greedily, those with most opposition first, each into the fold where it adds least; then ``search`` shuffles, tried
    on the executors. The least (missing pairs and ends, greatest cost of a fold, sum of costs) wins; a cost is the sum of
    squares of negative r within a fold. numpy's shuffles, seeded by their number; the catalog is bounded.
    """
    ns = sorted({r.benchmark for r in catalog_rows(names.select("benchmark").distinct())})
    n = len(ns)
    if n < k or k < 2:
        raise ValueError("two or more folds, and no more than names")
    at = {x: i for i, x in enumerate(ns)}
    cost, valid = np.zeros((n, n)), np.zeros((n, n), dtype=int)
    for r in catalog_rows(pairs.where("r is not null").select("p", "q", "r"), PAIRS):
        if r.p in at and r.q in at:
            i, j = at[r.p], at[r.q]
            valid[i, j] = valid[j, i] = 1
            cost[i, j] = cost[j, i] = min(0.0, r.r) ** 2
    sizes = [n // k + (f < n % k) for f in range(k)]

    def judged(fold):
        same = fold[:, None] == np.arange(k)
        costs = np.array([cost[np.ix_(m, m)].sum() / 2 for m in same.T])
        missing = 0
        for m in same.T:
            v = valid[np.ix_(m, m)]
            missing += max(0, least_pairs - int(v.sum()) // 2) + max(0, least_ends - int((v.sum(axis=1) > 0).sum()))
        return missing, float(costs.max()), float(costs.sum())

    order = sorted(range(n), key=lambda i: (-cost[i].sum(), hashlib.md5(f"{seed}|{ns[i]}".encode()).hexdigest()))
    fold = np.full(n, -1)
    for i in order:
        free = [f for f in range(k) if (fold == f).sum() < sizes[f]]
        fold[i] = min(free, key=lambda f: (cost[i][fold == f].sum(), (fold == f).sum(), f))
    plain = np.repeat(np.arange(k), sizes)

    def run(b):
        f = np.empty(n, dtype=int)
        f[np.random.default_rng([seed, b]).permutation(n)] = plain
        return [(b, *judged(f))]

    best = judged(fold)
    if search:
        top = _each(pairs.sparkSession, search, run, "b bigint, missing int, worst double, total double").agg(F.min(F.struct("missing", "worst", "total", "b")).alias("x")).first().x
        if (top.missing, top.worst, top.total) < best:
            best = (top.missing, top.worst, top.total)
            fold[np.random.default_rng([seed, top.b]).permutation(n)] = plain
    return pairs.sparkSession.createDataFrame([(x, int(f), *best) for x, f in zip(ns, fold)], "benchmark string, fold int, missing int, worst double, total double")


def fold_counts(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, pairs, ends): valid pairs within each fold and benchmarks that have one."""
    a, b = folds.select(F.col("benchmark").alias("p"), F.col("fold").alias("_a")), folds.select(F.col("benchmark").alias("q"), F.col("fold").alias("_b"))
    inside = pairs.where("r is not null").join(small(a), "p").join(small(b), "q").where("_a = _b")
    ends = inside.select(F.col("_a").alias("fold"), F.explode(F.array("p", "q")).alias("e")).groupBy("fold").agg(F.count_distinct("e").alias("ends"))
    n = inside.groupBy(F.col("_a").alias("fold")).agg(F.count("*").alias("pairs"))
    every = folds.select("fold").distinct()
    return every.join(n, "fold", "left").join(ends, "fold", "left").select("fold", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("ends", F.lit(0)).alias("ends"))


def core_plans(scores: DataFrame, models: list[str], size: int, k: int) -> DataFrame:
    """(seen, held, missing_seen, missing_held, missing): disjoint sets of ``size`` of a few models with fewest missing cells, the k best."""
    rows = catalog_rows(scores.where(F.col("model").isin(*models)).select("benchmark", "model"), ITEMS)
    total = scores.select("benchmark").distinct().count()
    gaps = {m: total - len({r.benchmark for r in rows if r.model == m}) for m in models}
    plans = [(a, b) for a in combinations(sorted(models), size) for b in combinations([m for m in sorted(models) if m not in a], size)]
    out = sorted(((sum(gaps[m] for m in a) + sum(gaps[m] for m in b), sum(gaps[m] for m in b), sum(gaps[m] for m in a), a, b) for a, b in plans))[:k]
    return scores.sparkSession.createDataFrame([(",".join(a), ",".join(b), x, y, n) for n, y, x, a, b in out], "seen string, held string, missing_seen int, missing_held int, missing int")


def model_split_search(scores: DataFrame, models: list[str], split: DataFrame, min_common: int, k: int) -> DataFrame:
    """(held_models, seen_n, held_n, seen_least, held_test): all ways to hold out some of up to 20 models, the k best by how many
    pairs of benchmarks of one bucket keep ``min_common`` models: the least of all counts, then the held test, then the seen.

    Pairs and models are bits; the subsets are distributed.
    """
    if len(models) > 20:
        raise ValueError("at most 20 models")
    names = sorted(models)
    at = {m: i for i, m in enumerate(names)}
    bucket = {r.benchmark: r.bucket for r in catalog_rows(split.select("benchmark", "bucket"))}
    bits: dict[str, int] = {}
    for r in catalog_rows(scores.where(F.col("model").isin(*names)).select("benchmark", "model"), ITEMS):
        bits[r.benchmark] = bits.get(r.benchmark, 0) | 1 << at[r.model]
    pairs = {b: np.array([bits[p] & bits[q] for p, q in combinations(sorted(x for x in bits if bucket.get(x) == b), 2)], dtype=np.int64) for b in ("train", "dev", "test")}
    whole = (1 << len(names)) - 1

    def run(b):
        held = b
        n = int(held).bit_count()
        if not min_common <= n <= len(names) - min_common:
            return []
        count = lambda m, x: int((np.bitwise_count(pairs[x] & m) >= min_common).sum()) if len(pairs[x]) else 0
        seen = [count(whole & ~held, x) for x in ("train", "dev", "test")]
        test = count(held, "test")
        return [(",".join(m for m, i in at.items() if held >> i & 1), len(names) - n, n, min(seen), test, min(*seen, test), seen[1], seen[0], seen[2])]

    r = _each(scores.sparkSession, whole, run, "held_models string, seen_n int, held_n int, seen_least int, held_test int, least int, dev int, train int, test int")
    return r.orderBy(*[F.desc(c) for c in ("least", "held_test", "seen_least", "dev", "train", "test")], "held_models").limit(k).select("held_models", "seen_n", "held_n", "seen_least", "held_test")
