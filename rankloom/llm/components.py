"""Splits that keep related records together: connected components by frontier breadth-first search.

Entries are linked by keys: the names of their authors, the page or repository of their source, and their entity (their
own name or the one they are derived from), all within one run and one split table. The graph is never turned into
pairs of entries; it stays a table (node, key), hash-partitioned by either side when it is expanded.

1. Every key learns its smallest node (a map-side minimum, so a key that a third of the nodes share costs one row for each
   task), every node the smallest node among its keys: its way towards a seed. A node that hears of none smaller is a seed.
2. The frontiers of all seeds run outward along these ways at the same time; since a node that was reached hands on its
   label to all behind it, the reach of a frontier doubles in each round. Every node ends with the label of one seed.
3. Where frontiers of two seeds meet at a key their labels collide. The pairs of colliding labels are a small graph, which
   the same search merges; every level has at most half the nodes of the one before, and the last has no collisions.
   A component is named by its smallest node.
4. Components are split by hash order: in a run, components in order of their hash take the wanted shares in turn, each
   going to the bucket in which its middle falls.

Blank values, names that stand for nobody in particular and front pages link nothing. Null entry ids are dropped; a null
run is a run of its own; repeated rows link by their names. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.cleaning import PLACEHOLDERS, name_key, page_key, usable_text
from rankloom.runtime import catalog_rows, stash

#: Rows of a hash range whose running sums one task makes, roughly.
RANGE_ROWS = 50_000

# Names that stand for nobody in particular, squeezed.
NOBODY = frozenset(("", "various", "community", "anonymous", "unknown", "na", "none", "null", "tbd", "others", "other", "misc", "several", "multiple", "authors", "team", "self", "selfreported", "internal", "unspecified", "variousauthors", "etal"))
# Texts in place of an entity that name none, squeezed.
NO_ENTITY = frozenset(("", "original", "none", "na", "null", "unknown", "tbd", "self", "scratch", "base", "new"))


def author_keys(c: Column) -> Column:
    """Squeezed names of a text with one or more names."""
    names = F.split(F.regexp_replace(F.lower(c), r"\s+and\s+|\s+et\s+|\s+with\s+", ";"), r"[;/&+,|]")
    keys = F.filter(F.transform(names, lambda x: name_key(F.regexp_replace(x, r"\bet al\b\.?", ""))), lambda x: ~x.isin(*NOBODY))
    return F.when(usable_text(c), keys)


def entity_key(c: Column) -> Column:
    k = name_key(c, ".")
    return F.when(~k.isin(*NO_ENTITY) & ~F.lower(F.trim(c)).isin(*PLACEHOLDERS), k)


def entity_links(entries: DataFrame, kind: str, name: str, authors: str, source: str, parent: str) -> DataFrame:
    """(node, key) of one split table; a key is the run, the table, the kind of link and its value."""
    links = F.concat(
        F.transform(F.coalesce(author_keys(F.col(authors)), F.array().cast("array<string>")), lambda x: F.struct(F.lit("author").alias("t"), x.alias("v"))),
        F.array(F.struct(F.lit("source").alias("t"), page_key(F.col(source)).alias("v")), F.struct(F.lit("entity").alias("t"), entity_key(F.col(name)).alias("v")), F.struct(F.lit("entity").alias("t"), entity_key(F.col(parent)).alias("v"))),
    )
    out = entries.where(F.col("entry_id").isNotNull()).select(F.col("entry_id").cast("bigint").alias("node"), "run_id", F.explode(links).alias("l")).where("l.v is not null")
    return out.select("node", F.concat_ws("\0", F.lit(kind), F.coalesce(F.concat(F.lit("r"), "run_id"), F.lit("-")), "l.t", "l.v").alias("key"))


def joined(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of the bipartite graph ``links`` (node, key) that share a key with another node."""
    low = links.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("_hi")).where("lo < _hi").select("key", "lo")
    edges = stash(links.join(low, "key").select("node", "lo"), "edges")
    ways = stash(edges.groupBy("node").agg(F.min("lo").alias("label"), F.max("lo").alias("_far")), "ways")
    labels = ways.select("node", "label")
    while True:
        further = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label")
        labels = stash(further.select("node", F.col("_to").alias("label"), (F.col("label") != F.col("_to")).alias("_moved")), "labels")
        if labels.where("_moved").isEmpty():
            break
        labels = labels.select("node", "label")
    labels = labels.select("node", "label")
    # only a node whose keys have different smallest nodes can bring two labels together
    meet = edges.join(ways.where("_far > label").select("node", "label"), "node").where("lo <> label").groupBy("label", "lo").agg(F.lit(1).alias("_1"))
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("label").alias(name))
    clash = stash(meet.join(of("label", "a"), "label").join(of("lo", "b"), "lo").where("a <> b").select("a", "b"), "clash")
    if clash.isEmpty():
        return labels.withColumnRenamed("label", "component")
    small = joined(clash.select(F.col("a").alias("node"), F.col("b").alias("key")).unionByName(clash.select(F.col("b").alias("node"), F.col("b").alias("key"))))
    merged = labels.join(small.select(F.col("node").alias("label"), F.col("component").alias("_to")), "label", "left")
    return merged.select("node", F.coalesce("_to", "label").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (node, key); nodes that share no key have a component of their own."""
    links = stash(links, "links")
    return links.select("node").distinct().join(joined(links), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def linked(bench_split: DataFrame, model_split: DataFrame) -> DataFrame:
    return entity_links(bench_split, "benchmark", "benchmark", "maintainer", "source_url", "derived_from").unionByName(entity_links(model_split, "model", "model", "team", "report_url", "base_model"))


def related_groups(bench_split: DataFrame, model_split: DataFrame) -> DataFrame:
    """(entry_a, entry_b): the smallest entry of each group with every other member."""
    return joined(stash(linked(bench_split, model_split), "links")).where("node <> component").select(F.col("component").alias("entry_a"), F.col("node").alias("entry_b"))


def prefix_sums(parts: DataFrame, over: list[str], by: str, amount: str, rows: int) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over the rows of the group that come earlier by the BIGINT hash ``by``.

    In two steps, so that a group of any size is spread: hash ranges of each group are summed and added up, then every
    range adds up its own rows. ``rows`` is the number of rows in all: even if they are one group, a range has about
    RANGE_ROWS of them.
    """
    bits = max(1, math.ceil(math.log2(max(2, rows / RANGE_ROWS))))
    p = parts.withColumn("_b", F.shiftright(F.col(by), 64 - bits))
    sums = p.groupBy(*over, "_b").agg(F.sum(amount).alias("_s"))
    done = sums.withColumn("_o", F.coalesce(F.sum("_s").over(W.partitionBy(*over).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inner = F.coalesce(F.sum(amount).over(W.partitionBy(*over, "_b").orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return p.withColumn("_i", inner).join(done, [*over, "_b"]).withColumn("before", F.col("_o") + F.col("_i")).drop("_b", "_o", "_i")


def assigned(bench_split: DataFrame, model_split: DataFrame, ratios: DataFrame) -> DataFrame:
    """(entry_id, run_id, unit_kind, component, assigned_bucket): whole components in the wanted shares.

    A component of more than a bucket's share goes where its middle falls, so shares are as near as whole components allow.
    """
    base = bench_split.select(F.col("entry_id").cast("bigint").alias("entry_id"), "run_id", F.lit("benchmark").alias("unit_kind")).unionByName(model_split.select(F.col("entry_id").cast("bigint").alias("entry_id"), "run_id", F.lit("model").alias("unit_kind"))).where("entry_id is not null")
    found = joined(stash(linked(bench_split, model_split), "links"))
    c = stash(base.join(found, base["entry_id"] == found["node"], "left").select("entry_id", F.coalesce("run_id", F.lit("")).alias("run_id"), "unit_kind", F.coalesce("component", "entry_id").alias("component")), "members")
    sizes = c.groupBy("run_id", "unit_kind", "component").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("component", F.lit(17)))
    total = sizes.groupBy("run_id", "unit_kind").agg(F.sum("n").alias("total"))
    placed = prefix_sums(sizes, ["run_id", "unit_kind"], "h", "n", c.count()).join(total, ["run_id", "unit_kind"])
    middle = (F.col("before") + F.col("n") / 2) / F.col("total")
    rows = catalog_rows(ratios.where("ratio is not null").select("unit_kind", "bucket", "ratio"), 1000)
    bucket = F.lit(None).cast("string")
    for kind in sorted({r.unit_kind for r in rows}):
        own = sorted((r for r in rows if r.unit_kind == kind), key=lambda r: (-r.ratio, r.bucket))
        whole, at = sum(r.ratio for r in own), 0.0
        pick = F.lit(own[-1].bucket)
        bounds = []
        for r in own[:-1]:
            at += r.ratio / whole
            bounds.append((at, r.bucket))
        for edge, b in reversed(bounds):
            pick = F.when(middle < edge, F.lit(b)).otherwise(pick)
        bucket = F.when(F.col("unit_kind") == kind, pick).otherwise(bucket)
    where = placed.select("run_id", "unit_kind", "component", bucket.alias("assigned_bucket"))
    return c.join(where, ["run_id", "unit_kind", "component"]).select("entry_id", "run_id", "unit_kind", "component", "assigned_bucket")


def split_shares(placed: DataFrame, ratios: DataFrame) -> DataFrame:
    """(unit_kind, bucket, ratio, entries, actual, least_run, most_run): the wanted share, that of all entries, and its range over the runs."""
    runs = placed.groupBy("run_id", "unit_kind", F.col("assigned_bucket").alias("bucket")).agg(F.count("*").alias("n"))
    size = runs.groupBy("run_id", "unit_kind").agg(F.sum("n").alias("of"))
    wanted = ratios.where("ratio is not null").groupBy("unit_kind", "bucket").agg(F.sum("ratio").alias("ratio"))
    each = size.join(wanted, "unit_kind").join(runs, ["run_id", "unit_kind", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = each.groupBy("unit_kind", "bucket", "ratio").agg(F.sum("n").alias("entries"), (F.sum("n") / F.sum("of")).alias("actual"), F.min(F.col("n") / F.col("of")).alias("least_run"), F.max(F.col("n") / F.col("of")).alias("most_run"))
    return out


__all__ = ["assigned", "components", "joined", "linked", "prefix_sums", "related_groups", "split_shares"]
