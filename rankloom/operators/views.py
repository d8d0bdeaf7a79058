"""From score records and catalogs to views: aliases, filters, model groups, benchmark metadata, category tabs, provenance.

Catalogs (models, benchmarks, aliases) are bounded and broadcast after a check of their size; records are reduced before
they are joined. Names that are null or blank match nothing. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.cleaning import name_key
from rankloom.functions.semantics import reasons
from rankloom.operators.board import host_of
from rankloom.operators.align import listed
from rankloom.runtime import small, stash

# Tabs that show all of their benchmarks, and models from which a benchmark is shown in any other tab.
OVERVIEWS, CORE_MODELS = ("all", "deterministic", "non_deterministic"), 6
# Tabs of scores that don't repeat, and the parent tab with its categories.
UNSTEADY_TABS, PARENT_TAB, CHILDREN = ("preference", "agent", "safety", "korean", "multilinguality"), "multimodal", ("multimodal", "vision", "video")
# Words that a model's bracket may hold as its config.
CONFIG_WORDS = ("high", "medium", "low", "max", "none")


def alias_table(models: DataFrame) -> DataFrame:
    """(alias, model): names and aliases of the catalog as written, trimmed; of several models the first by id."""
    names = F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).alias("alias")
    return models.select("id", names).where("alias is not null").groupBy(F.trim("alias").alias("alias")).agg(F.min("id").alias("model"))


def renamed(names: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``names`` with ``column`` trimmed and, if it is an alias as written, replaced by the model."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("model").alias("_model"))
    j = names.withColumn(column, F.trim(column)).join(small(a), F.col(column) == F.col("_alias"), "left")
    return j.withColumn(column, F.coalesce("_model", column)).drop("_alias", "_model")


def leaderboard(rows: DataFrame, aliases: DataFrame, composites: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(benchmark, model, score) of rows (benchmark, model, score, place): of the names of one model the first by place counts.

    Names that start with '_', composite benchmarks and excluded ones (whatever their case) are left out.
    """
    keep = rows.where(~F.startswith("benchmark", F.lit("_")) & ~F.startswith("model", F.lit("_")) & F.col("score").isNotNull())
    if composites:
        keep = keep.where(~F.col("benchmark").isin(*composites))
    if exclude:
        keep = keep.where(~F.lower("benchmark").isin(*[x.lower() for x in exclude]))
    return renamed(keep, "model", aliases).groupBy("benchmark", "model").agg(F.min_by("score", "place").alias("score"))


def flat_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s_./\\\-()\[\]]+", "")


def resolved(names: DataFrame, column: str, models: DataFrame) -> DataFrame:
    """``names`` with ``resolved``: the first model by id whose id, name or an alias is the same but for blanks, marks and brackets; null if none."""
    forms = F.explode(F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    table = models.select("id", forms.alias("x")).where("x is not null").groupBy(flat_name(F.col("x")).alias("_flat")).agg(F.min("id").alias("resolved"))
    return names.withColumn("_flat", F.when(F.col(column) != "", flat_name(F.col(column)))).join(small(table), "_flat", "left").drop("_flat")


def filtered(scores: DataFrame, aliases: DataFrame, benchmarks: list[str] = (), models: list[str] = (), without: list[str] = ()) -> DataFrame:
    """(benchmark, model, score) of the listed benchmarks (by key) and models (by alias), less those in ``without``; empty lists don't filter."""
    to_names = lambda xs: renamed(scores.sparkSession.createDataFrame([(x,) for x in xs if x and x.strip()], "model string"), "model", aliases).distinct()
    out = renamed(scores, "model", aliases)
    if benchmarks:
        keys = scores.sparkSession.createDataFrame([(x,) for x in benchmarks if x and x.strip()], "x string").select(name_key(F.col("x")).alias("_key")).distinct()
        out = out.join(small(keys), name_key(F.col("benchmark")) == F.col("_key"), "left_semi")
    if models:
        out = out.join(small(to_names(models)), "model", "left_semi")
    if without:
        out = out.join(small(to_names(without)), "model", "left_anti")
    return out.select("benchmark", "model", "score")


def restricted(scores: DataFrame, models: DataFrame) -> DataFrame:
    """Scores of the models of a set (model)."""
    return scores.join(models.select("model").distinct(), "model", "left_semi")


def subset(benchmarks: DataFrame, keep: DataFrame, reason: str) -> DataFrame:
    """(benchmark, reason): null for those of ``keep`` (benchmark), ``reason`` for those that fall out."""
    k = keep.select("benchmark").distinct().withColumn("_in", F.lit(True))
    return benchmarks.select("benchmark").distinct().join(k, "benchmark", "left").select("benchmark", F.when(F.col("_in").isNull(), reason).alias("reason"))


def model_config(c: Column) -> tuple[Column, Column]:
    """(base, config): a bracket at the end of a model's name is its config if all its words are; config is null otherwise."""
    whole = r"^(.*?)\s*\(([^()]*)\)\s*$"
    inner = F.regexp_extract(c, whole, 2)
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    fits = c.rlike(whole) & (F.size(parts) > 0) & F.forall(parts, lambda x: x.isin(*CONFIG_WORDS) | x.rlike(r"^\d+\s*k$") | x.contains("thinking") | x.contains("reasoning"))
    return F.when(fits, F.trim(F.regexp_extract(c, whole, 1))).otherwise(c), F.when(fits, F.trim(inner))


def joined_config(model: Column, score: Column) -> Column:
    """Config of a score with that of its model in front, unless it has it already."""
    s = F.trim(F.coalesce(score, F.lit("")))
    return F.when(model.isNull(), s).when(s == "", model).when(F.contains(F.lower(s), F.lower(model)), s).otherwise(F.concat(model, F.lit("; "), s))


def model_groups(models: DataFrame) -> DataFrame:
    """(model_id, group_id, group_name, config): models of one vendor whose names differ by a config only form a group.

    It has the id of the model that bears the bare name, else of the first by id. A model of its own has its own id and name.
    """
    base, config = model_config(F.col("name"))
    m = models.select(F.col("id").alias("model_id"), "name", "vendor", base.alias("base"), config.alias("config"))
    m = m.withColumn("_key", F.concat_ws("::", F.lower(F.trim(F.coalesce("vendor", F.lit("")))), F.regexp_replace(F.lower(F.trim("base")), r"\s+", " ")))
    g = W.partitionBy("_key")  # a catalog
    bare = F.when(F.lower(F.trim("name")) == F.lower(F.trim("base")), F.col("model_id"))
    m = m.withColumns({"_grouped": F.max(F.col("config").isNotNull()).over(g), "_bare": F.min(bare).over(g), "_first": F.min("model_id").over(g)})
    return m.select("model_id", F.when(F.col("_grouped"), F.coalesce("_bare", "_first")).otherwise(F.col("model_id")).alias("group_id"), F.when(F.col("_grouped"), F.col("base")).otherwise(F.col("name")).alias("group_name"), "config")


def tabs(benchmarks: DataFrame) -> DataFrame:
    """(tab, benchmark) of every tab that a benchmark belongs to by its type and category."""
    steady, kind = F.col("type") == "deterministic", F.col("category")
    each = F.array(
        F.lit("all"),
        F.when(steady, F.lit("deterministic")),
        F.when(F.col("type") == "non_deterministic", F.lit("non_deterministic")),
        F.when((F.col("type") == "non_deterministic") & kind.isin(*UNSTEADY_TABS), F.concat(F.lit("nd_"), kind)),
        F.when(steady, kind),
        F.when(steady & kind.isin(*CHILDREN) & (kind != PARENT_TAB), F.lit(PARENT_TAB)),
    )
    return benchmarks.select(F.explode(F.array_compact(each)).alias("tab"), F.col("id").alias("benchmark"))


def core_columns(tabbed: DataFrame, models: DataFrame, well_known: DataFrame) -> DataFrame:
    """``tabbed`` with ``shown``: overviews show all, other tabs well-known benchmarks (benchmark) and those with CORE_MODELS models (benchmark, models)."""
    w = well_known.select("benchmark").distinct().withColumn("_known", F.lit(True))
    j = tabbed.join(small(models), "benchmark", "left").join(small(w), "benchmark", "left")
    return j.select("tab", "benchmark", (F.col("tab").isin(*OVERVIEWS) | F.coalesce("_known", F.lit(False)) | (F.coalesce("models", F.lit(0)) >= CORE_MODELS)).alias("shown"))


def canonical_records(records: DataFrame, aliases: DataFrame, blocked: DataFrame) -> DataFrame:
    """Records with benchmark ids replaced by what ``aliases`` (benchmark, canonical) says; those in ``blocked`` (benchmark) fall out."""
    a = aliases.select(F.col("benchmark").alias("_b"), "canonical")
    j = records.join(small(a), F.col("benchmark_id") == F.col("_b"), "left").withColumn("benchmark_id", F.coalesce("canonical", "benchmark_id")).drop("_b", "canonical")
    return j.join(small(blocked.select(F.col("benchmark").alias("benchmark_id")).distinct()), "benchmark_id", "left_anti")


def merged_metadata(benchmarks: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row for each canonical id: first name, first source_url, description and note that say something, last of the other fields (in order of id)."""
    a = aliases.select(F.col("benchmark").alias("_b"), "canonical")
    j = benchmarks.join(small(a), F.col("id") == F.col("_b"), "left").withColumn("_id", F.coalesce("canonical", "id"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return j.groupBy(F.col("_id").alias("id")).agg(F.count("*").alias("entries"), *map(first, ("name", "source_url", "description", "note")), *map(last, ("category", "type", "language", "scale")))


def placeholder(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike("todo|replace|placeholder"), F.lit(False))


def url_faults(c: Column) -> list[tuple[Column, str]]:
    host = host_of(F.trim(c))
    local = host.isin("localhost", "127.0.0.1", "0.0.0.0") | host.endswith(".local")
    return [(host == "", "url_not_absolute"), (local, "url_local"), (F.contains(host, F.lit("example.com")) | host.endswith(".invalid"), "url_placeholder")]


def provenance_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (benchmark, model, scale, metric, score, title, url, date, retrieved_at) with ``faults``, all of them in order.

    A day is written as 2025-03-07, an instant as that with a time behind it. A date that is there counts, else retrieved_at.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    day, moment = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    reads = lambda c, p: F.coalesce(F.trim(F.col(c)).rlike(p) & F.try_to_date(F.substring(F.trim(c), 1, 10)).isNotNull(), F.lit(False))
    has_date, has_moment = F.coalesce(F.col("date"), F.lit("")) != "", F.coalesce(F.col("retrieved_at"), F.lit("")) != ""
    rules = [
        (blank("benchmark"), "no_benchmark"), (blank("model"), "no_model"), (F.coalesce(F.trim("scale"), F.lit("")) != "0-1", "wrong_scale"), (blank("metric"), "no_metric"), (placeholder(F.col("metric")), "metric_placeholder"),
        (F.coalesce(F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1), F.lit(True)), "score_out_of_range"), (blank("title"), "no_title"), (placeholder(F.col("title")), "title_placeholder"), (blank("url"), "no_url"),
        *[(~blank("url") & c, n) for c, n in url_faults(F.col("url"))],
        (has_date & ~reads("date", day), "date_not_iso"), (~has_date & has_moment & ~reads("retrieved_at", moment), "instant_not_iso"), (~has_date & ~has_moment, "no_date"),
    ]
    return rows.withColumn("faults", reasons(*rules))


def doubled_cells(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, model, n): cells that several rows (benchmark, model) claim once names are made alike."""
    return renamed(rows, "model", aliases).groupBy(name_key(F.col("benchmark")).alias("key"), "model").agg(F.count("*").alias("n")).where("n > 1")


def tagged(benchmarks: DataFrame, rules: list[tuple[str, str]], valid: list[str], fallback: str, overrides: DataFrame) -> DataFrame:
    """(id, tags): an override (id, tags), else its category and all tags whose pattern its name or description has, else the fallback; valid ones only, in order."""
    text = F.lower(F.concat_ws(" ", "id", "name", "description"))
    found = F.array_compact(F.array(F.col("category"), *[F.when(text.rlike(p), F.lit(t)) for t, p in rules]))
    j = benchmarks.join(small(overrides.select(F.col("id").alias("_o"), F.col("tags").alias("_tags"))), F.col("id") == F.col("_o"), "left")
    own = F.coalesce("_tags", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback))))
    return j.select("id", F.array_join(F.array_sort(F.array_intersect(own, F.array(*map(F.lit, valid)))), ",").alias("tags"))


def new_benchmarks(records: DataFrame, benchmarks: DataFrame, category: Column, unsteady: Column, slug: Column) -> DataFrame:
    """(id, name, category, type) of benchmark names in the records that the catalog has under no id or key; of names with one slug the first."""
    known = benchmarks.select(name_key(F.col("id")).alias("_key")).unionByName(benchmarks.select(name_key(F.col("name")).alias("_key"))).where("_key is not null").distinct()
    names = records.where("trim(benchmark_id) <> ''").groupBy(F.trim("benchmark_id").alias("name")).agg(F.lit(1).alias("_one"))
    fresh = names.join(small(known), name_key(F.col("name")) == F.col("_key"), "left_anti")
    return fresh.select(slug.alias("id"), "name", category.alias("category"), F.when(unsteady, "non_deterministic").otherwise("deterministic").alias("type")).where("id <> ''").groupBy("id").agg(F.min(F.struct("name", "category", "type")).alias("x")).select("id", "x.*")


def placed(rows: DataFrame, group: list[str], order: list[str], block_rows: int = 250_000) -> DataFrame:
    """``rows`` with ``place``: their number (from 0) in the order within their group, in two steps over ranges, so that a group may hold any share of the rows."""
    n = max(1, -(-rows.count() // block_rows))
    ranged = stash(rows.repartitionByRange(n, *group, *order).withColumn("_block", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy(*group, "_block").orderBy(*order)) - 1
    return ranged.withColumn("_i", inside).join(sizes.select(*group, "_block", offset.alias("_o")), [*group, "_block"]).withColumn("place", F.col("_i") + F.col("_o")).drop("_block", "_i", "_o")

