"""Leaderboard operators: record merge, views, rankings, recommendation, risk, splits and statistics over records.

Everything aggregates before it joins; catalogs (models, benchmarks, kinds) are the only broadcast sides, after a check
of their size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.cleaning import decimals, instant, kind_key, publication_day, usable_score
from rankloom.runtime import catalog_rows


def flattened(records: DataFrame) -> DataFrame:
    """One row for each record and variant: (run_id, model_id, benchmark_id, record_id, entry_no, score, config, source)."""
    kind = records.schema["variants"].dataType
    own = F.array(F.struct(F.col("score").alias("score"), F.col("config").alias("config"), F.col("source").alias("source")).cast(kind.elementType))
    return records.select("run_id", "model_id", "benchmark_id", "record_id", "extra", F.posexplode(F.concat(own, F.coalesce("variants", F.array().cast(kind)))).alias("entry_no", "v")).select("run_id", "model_id", "benchmark_id", "record_id", "extra", "entry_no", "v.score", "v.config", "v.source")


GROUP = ("run_id", "model_id", "benchmark_id")
#: Reliability of an entry that a user corrected, and of one from a host that only repeats the numbers of others.
CORRECTED, REPEATED = 6, 2


def host_of(url: Column) -> Column:
    """Host of an http link without 'www.', '' if it is none."""
    return F.regexp_extract(F.lower(url), r"^https?://(?:www\.)?([^/:?#]+)", 1)


def ordered_entries(records: DataFrame, source_kinds: DataFrame, repeaters: tuple[str, ...] = ()) -> DataFrame:
    """Usable entries of all records, each once by config, score, url, ref and reporter, with ``_order``: the greatest comes first.

    A group that is all dated is ordered by date; one that is not by reliability, fetch instant and score, with the date last
    (an order that asks for the date of both sides only is not transitive in mixed groups). Reliability is the trust of the
    kind, but CORRECTED for a record whose extra says so and REPEATED for hosts that repeat others. Groups are reduced
    map-side, so a hot one costs a row for each distinct entry and task.
    """
    trust = {r.kind: int(r.trust) for r in catalog_rows(source_kinds.where("kind is not null and trust is not null").select(kind_key(F.col("kind")).alias("kind"), "trust"))}
    known = F.create_map(*[F.lit(x) for kv in trust.items() for x in kv]) if trust else F.create_map(F.lit(""), F.lit(0))
    e = flattened(records).where(usable_score(F.col("score")) & F.col("model_id").isNotNull() & F.col("benchmark_id").isNotNull())
    host = host_of(F.col("source.url"))
    repeats = F.lit(False)
    for h in repeaters:
        repeats = repeats | (host == h) | host.endswith("." + h)
    corrected = (F.col("entry_no") == 0) & (F.get_json_object("extra", "$.user_correction") == "true")
    rel = F.when(F.coalesce(corrected, F.lit(False)), CORRECTED).when(F.coalesce(repeats, F.lit(False)), REPEATED).otherwise(F.coalesce(F.try_element_at(known, F.coalesce(kind_key(F.col("source.kind")), F.lit(""))), F.lit(0)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    e = e.select(*GROUP, "record_id", "entry_no", "score", F.lower(F.trim(text("config"))).alias("config"), text("source.url").alias("url"), text("source.ref").alias("ref"), text("source.reported_by").alias("by"),
                 F.coalesce(F.unix_date(publication_day(F.col("source.published"))), F.lit(-(10**6))).alias("day"), rel.alias("rel"), F.coalesce(F.unix_micros(instant(F.col("source.fetched_at"))), F.lit(-(2**60))).alias("fetched"))
    dated = e.groupBy(*GROUP).agg((F.min("day") > -(10**6)).alias("_dated"))
    order = F.struct(F.when(F.col("_dated"), F.col("day")).otherwise(0).alias("a"), "rel", "fetched", "score", "day", (-F.col("record_id")).alias("r"), (-F.col("entry_no")).alias("e"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in GROUP]
    marked = e.join(dated.select(*[F.col(g).alias(f"_{g}") for g in GROUP], "_dated"), same)
    best = marked.groupBy(*GROUP, "config", "score", "url", "ref", "by").agg(F.max(order).alias("_order"))
    return best.select(*GROUP, (-F.col("_order.r")).alias("record_id"), (-F.col("_order.e")).alias("entry_no"), "score", "config", "_order")


def merged(records: DataFrame, source_kinds: DataFrame, repeaters: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, model_id, benchmark_id, score, config, record_id, entry_no, variants): the entry promoted and how many stay behind it."""
    e = ordered_entries(records, source_kinds, repeaters)
    out = e.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_order", "score", "config", "record_id", "entry_no")).alias("x"))
    return out.select(*GROUP, "x.score", "x.config", "x.record_id", "x.entry_no", (F.col("n") - 1).alias("variants"))


def variants(records: DataFrame, source_kinds: DataFrame, repeaters: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, model_id, benchmark_id, place, record_id, entry_no, score, config): the representative (0) and its variants in order."""
    w = W.partitionBy(*GROUP).orderBy(F.desc("_order"))
    return ordered_entries(records, source_kinds, repeaters).select(*GROUP, (F.row_number().over(w) - 1).alias("place"), "record_id", "entry_no", "score", "config")


def deduplicated(records: DataFrame, source_kinds: DataFrame, spread: float = 0.5) -> DataFrame:
    """Entries (variants too) per run, model, benchmark and config: one score is kept; of scores within ``spread`` that with
    most decimals, the first in order on a tie; else none of them."""
    e = ordered_entries(records, source_kinds)
    g = e.groupBy(*GROUP, "config").agg(F.count_distinct("score").alias("n"), (F.max("score") - F.min("score")).alias("gap"), F.max(F.struct(decimals(F.col("score")).alias("dec"), "_order", "score")).alias("best"))
    return g.where((F.col("n") == 1) | (F.col("gap") <= spread)).select(*GROUP, "config", F.col("best.score").alias("score"), F.col("n").alias("distinct_scores"))


def chunked(rows: DataFrame, group: str, order: str, size: str, most: int, room: int) -> DataFrame:
    """(group, chunks, items): rows of a group in order fill chunks of at most ``most`` rows and ``room`` in size; a full one is flushed.

    Each border hangs on the one before, so a group is one run through its rows in order; they stream through their task in
    batches (three columns, sorted with spilling) and nothing of a group is held but the open chunk.
    """

    def run(batches):
        at, chunks, k, total, n = None, 0, 0, 0, 0
        for pdf in batches:
            out = []
            for g, x in zip(pdf[group], pdf[size]):
                if g != at:
                    if at is not None:
                        out.append((at, chunks, n))
                    at, chunks, k, total, n = g, 1, 0, 0, 0
                if k and (k >= most or total + x > room):
                    chunks, k, total = chunks + 1, 0, 0
                k, total, n = k + 1, total + x, n + 1
            yield pd.DataFrame(out, columns=[group, "chunks", "items"])
        if at is not None:
            yield pd.DataFrame([(at, chunks, n)], columns=[group, "chunks", "items"])

    ordered = rows.select(group, order, size).repartition(group).sortWithinPartitions(group, order)
    return ordered.mapInPandas(run, f"{group} string, chunks bigint, items bigint")


def heat(scores: DataFrame) -> DataFrame:
    """Cells with the least and greatest score of their column and where they lie between (0.5 if constant)."""
    w = W.partitionBy("benchmark")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.select("benchmark", "model", "score", lo.alias("lo"), hi.alias("hi"), F.when(hi > lo, F.try_divide(F.col("score") - lo, hi - lo)).otherwise(0.5).alias("shade"))


# When a benchmark is saturated, and which gap to its hard variant is large or notable.
NEAR_TOP, LEAST_TOP, SATURATED_MIDDLE, WIDE_GAP, SOME_GAP = 0.95, 50, 0.85, 15, 8


def contamination(scores: DataFrame, hard: DataFrame) -> DataFrame:
    """(benchmark, n, middle, top, ceiling, saturated, hard, hard_gap, hard_pairs, risk) of benchmarks with three or more scores.

    Scores are in percent; the ceiling (scores within 5 % of the best) only counts where the best is 50 or more. ``hard``
    (benchmark, hard) names a harder variant; its gap is the mean over shared models, if there are three or more.
    """
    top = scores.groupBy("benchmark").agg(F.max("score").alias("top"), F.median("score").alias("middle"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    near = scores.join(top.select("benchmark", "top"), "benchmark").groupBy("benchmark").agg(F.count_if((F.col("top") >= LEAST_TOP) & (F.col("score") >= NEAR_TOP * F.col("top"))).alias("ceiling"))
    pairs = scores.join(hard.where("benchmark <> hard"), "benchmark").join(scores.select(F.col("benchmark").alias("hard"), "model", F.col("score").alias("_h")), ["hard", "model"])
    gap = pairs.groupBy("benchmark", "hard").agg(F.avg(F.col("score") - F.col("_h")).alias("hard_gap"), F.count(F.lit(1)).alias("hard_pairs")).where("hard_pairs >= 3")
    j = top.join(near, "benchmark").join(gap, "benchmark", "left")
    saturated = (F.col("n") >= 5) & (F.col("ceiling") >= 3) & (F.col("middle") >= SATURATED_MIDDLE * F.col("top"))
    wide, some = F.coalesce(F.col("hard_gap") > WIDE_GAP, F.lit(False)), F.coalesce(F.col("hard_gap") > SOME_GAP, F.lit(False))
    risk = F.when(saturated & (F.col("ceiling") / F.col("n") >= 0.3) | wide, "high").when((F.col("ceiling") >= 2) | some, "medium").otherwise("low")
    return j.select("benchmark", "n", "middle", "top", "ceiling", saturated.alias("saturated"), "hard", "hard_gap", "hard_pairs", risk.alias("risk"))


def related(tags: DataFrame, least: float = 0.75, k: int = 6) -> DataFrame:
    """(tag, benchmark, place): the k benchmarks with most of a tag among those with ``least`` or more, ties by name."""
    w = W.partitionBy("tag").orderBy(F.desc("weight"), "benchmark")
    return tags.where(F.col("weight") >= least).select("tag", "benchmark", F.row_number().over(w).alias("place")).where(F.col("place") <= k)


def corrected(scores: DataFrame, corrections: DataFrame, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(scores with all corrections, mismatches): mismatches (benchmark, model, reason) are cells not found or of another value."""
    j = corrections.join(scores, ["benchmark", "model"], "left")
    reason = F.when(F.col("score").isNull(), "cell not found").when(F.abs(F.col("score") - F.col("old")) > tolerance, "another value")
    bad = j.select("benchmark", "model", reason.alias("reason")).where("reason is not null")
    new = scores.join(corrections.select("benchmark", "model", "new"), ["benchmark", "model"], "left")
    return new.select("benchmark", "model", F.coalesce("new", "score").alias("score"), F.col("new").isNotNull().alias("corrected")), bad


def all_corrected(scores: DataFrame, corrections: DataFrame) -> DataFrame:
    """Scores with all corrections, or an error that names what doesn't fit: all or nothing."""
    new, bad = corrected(scores, corrections)
    if wrong := bad.orderBy("benchmark", "model").limit(20).collect():
        raise ValueError("corrections don't fit: " + ", ".join(f"{r.model} at {r.benchmark}: {r.reason}" for r in wrong))
    return new


def relevance(tags: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """(benchmark, relevance): cosine of a benchmark's tags with the wanted ones, best first, ties by name; zero vectors last.

    Raises for no or unknown tags.
    """
    if not wanted:
        raise ValueError("no tag is wanted")
    known = {r.tag for r in catalog_rows(tags.select("tag").distinct())}
    if missing := sorted(wanted.keys() - known):
        raise ValueError(f"unknown tags: {missing}")
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("tag")), F.lit(0.0))
    own = sum(v * v for v in wanted.values()) ** 0.5
    g = tags.groupBy("benchmark").agg(F.sum(F.col("weight") * w).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    return g.select("benchmark", F.coalesce(F.try_divide(F.col("dot"), F.nullif(F.col("n") * own, F.lit(0.0))), F.lit(0.0)).alias("relevance")).orderBy(F.desc("relevance"), "benchmark")


def utility(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """(benchmark, relevance, breadth, utility): 0.72 of the mean wanted weight plus 0.2 of the share of tags at 0.5 or more; above 0.05."""
    k = catalog_rows(tags.agg(F.count_distinct("tag").alias("k")))[0].k or 1
    g = tags.groupBy("benchmark").agg((F.coalesce(F.sum(F.when(F.col("tag").isin(*wanted), F.col("weight"))), F.lit(0.0)) / len(wanted)).alias("relevance"), (F.count_if(F.col("weight") >= 0.5) / F.lit(k)).alias("breadth"))
    return g.withColumn("utility", F.lit(0.72) * F.col("relevance") + F.lit(0.2) * F.col("breadth")).where("utility > 0.05").orderBy(F.desc("utility"), F.desc("relevance"), "benchmark")


def model_fit(profile: DataFrame, wanted: dict[str, float], k: int) -> DataFrame:
    """(model, fit): weighted mean of the wanted tags of a profile, the k best."""
    w = F.try_element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("tag"))
    return profile.withColumn("_w", w).where("_w IS NOT NULL").groupBy("model").agg((F.sum(F.col("_w") * F.col("weight")) / sum(wanted.values())).alias("fit")).orderBy(F.desc("fit"), "model").limit(k)


def subset_ranking(scores: DataFrame, subset: list[str], k: int) -> DataFrame:
    """(model, subset_rank, subset_score, full_rank, full_score, regret, reliability): the k best models by the mean of a subset
    of the benchmarks (of all they have, if they have none of it) beside their place by all; scores are fractions, shown in percent."""
    g = scores.groupBy("model").agg(F.avg(F.when(F.col("benchmark").isin(*subset), F.col("score"))).alias("_s"), F.avg("score").alias("_f"))
    one = F.lit(1)
    p = g.select("model", (F.coalesce("_s", "_f") * 100).alias("_s"), (F.col("_f") * 100).alias("_f"), F.count(one).over(W.partitionBy(one)).alias("_n"))
    place = lambda c: F.row_number().over(W.partitionBy(one).orderBy(F.desc(c), "model"))  # noqa: E731 - a catalog
    p = p.withColumns({"subset_rank": place("_s"), "full_rank": place("_f")}).where(F.col("subset_rank") <= k)
    regret = F.greatest(F.lit(0), F.col("subset_rank") - F.col("full_rank")) / F.greatest(F.lit(1), F.col("_n"))
    return p.select("model", "subset_rank", F.col("_s").alias("subset_score"), "full_rank", F.col("_f").alias("full_score"), regret.alias("regret"), (1 - F.least(F.lit(0.5), F.abs(F.col("_s") - F.col("_f")) / 100)).alias("reliability"))


def hash_order(name: Column, seed: int) -> Column:
    """A shuffle that is the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), name))


def ratio_split(names: DataFrame, name: str, shares: dict[str, float], seed: int) -> DataFrame:
    """(name, bucket): names of a catalog in hash order, cut at the rounded shares."""
    one = F.lit(1)
    n = F.count(F.lit(1)).over(W.partitionBy(one))
    r = names.select(name).distinct().select(name, F.row_number().over(W.partitionBy(one).orderBy(hash_order(F.col(name), seed), name)).alias("_i"), n.alias("_n"))
    out, at = None, 0.0
    items = list(shares.items())
    for b, share in items[:-1]:
        at += share
        c = F.col("_i") <= F.round(F.col("_n") * at)
        out = F.when(c, b) if out is None else out.when(c, b)
    return r.select(name, (out.otherwise(items[-1][0]) if out is not None else F.lit(items[0][0])).alias("bucket"))


def folds(names: DataFrame, name: str, stratum: str, k: int, seed: int) -> DataFrame:
    """(name, stratum, fold): round robin within each stratum, from an offset that depends on the stratum."""
    i = F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(F.col(name), seed), name)) - 1
    offset = F.conv(F.substring(hash_order(F.coalesce(F.col(stratum), F.lit("")), seed), 1, 4), 16, 10).cast("int")
    return names.select(name, stratum, ((i + offset) % k).cast("int").alias("fold"))


def sampled(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (or all) of each group, by hash order."""
    w = W.partitionBy(group).orderBy(hash_order(F.col(key).cast("string"), seed), key)
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def greedy_cover(tags: DataFrame, k: int) -> list[str]:
    """The k benchmarks that cover most: each step takes the greatest gain in the sum of per-tag maxima (plus 1e-6 of its norm), ties by name."""
    rows = catalog_rows(tags.select("benchmark", "tag", "weight"))
    own: dict[str, dict[str, float]] = {}
    for r in rows:
        own.setdefault(r.benchmark, {})[r.tag] = float(r.weight)
    have: dict[str, float] = {}
    out: list[str] = []
    while len(out) < min(k, len(own)):
        gain = lambda b: sum(max(0.0, w - have.get(t, 0.0)) for t, w in own[b].items()) + 1e-6 * sum(w * w for w in own[b].values()) ** 0.5
        best = min((b for b in own if b not in out), key=lambda b: (-gain(b), b))
        out.append(best)
        for t, w in own[best].items():
            have[t] = max(w, have.get(t, 0.0))
    return out


def k_medoids(tags: DataFrame, k: int, seed: int = 0, rounds: int = 64) -> list[str]:
    """Medoids of the tag vectors under 1 - cosine (1 for a zero vector): alternate assignment and update, ties by name.

    Starts from a seeded sample; where two clusters fall onto one medoid the first names not yet taken fill up, so k come
    back. The catalog is bounded.
    """
    import random

    import numpy as np

    rows = catalog_rows(tags.select("benchmark", "tag", "weight"))
    names, kinds = sorted({r.benchmark for r in rows}), sorted({r.tag for r in rows})
    if k <= 0 or k >= len(names):
        return names if k > 0 else []
    m = np.zeros((len(names), len(kinds)))
    at, tat = {n: i for i, n in enumerate(names)}, {t: i for i, t in enumerate(kinds)}
    for r in rows:
        m[at[r.benchmark], tat[r.tag]] = r.weight
    size = np.outer(*[np.linalg.norm(m, axis=1)] * 2)
    d = 1 - np.clip(np.divide(m @ m.T, size, out=np.zeros_like(size), where=size > 0), -1, 1)
    medoids = sorted(random.Random(seed).sample(range(len(names)), k))
    for _ in range(rounds):
        who = d[:, medoids].argmin(axis=1)
        new = set()
        for c, old in enumerate(medoids):
            members = np.flatnonzero(who == c)
            new.add(int(members[d[np.ix_(members, members)].sum(axis=1).argmin()]) if len(members) else old)
        if sorted(new) == medoids:
            break
        new |= set([i for i in range(len(names)) if i not in new][: k - len(new)])
        medoids = sorted(new)
    return [names[i] for i in medoids]
