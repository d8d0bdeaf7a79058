"""Filling missing values from similar records: sequential hot deck.

Records of a group are put in an order in which neighbours are alike; a missing value takes that of the nearest earlier or
later record of its group that has one (the earlier one on a tie), and the result says so: ``filled``, the ``donor`` and
the ``distance`` in places. A group of any size works: the data is range-partitioned by group and order, every block fills
itself, and only what the blocks of a split group have at their edges (a few values for each block) goes round.

Nulls in a group column form no group (nothing is filled there). A group without a usable value stays missing. Repeated
rows are neighbours of their own; ties in the order are broken by ``row_key``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.cleaning import usable_score, usable_text
from rankloom.runtime import catalog_rows, small, stash

#: Rows that a block of the ordered data has at most, roughly.
BLOCK_ROWS = 250_000


def hot_deck(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``filled_value``, ``filled`` (BOOLEAN), ``donor`` (its order columns as text) and ``distance``.

    ``value`` is null where it is missing. ``order`` has to make rows unique within a group, or ties are arbitrary.
    """
    spark = rows.sparkSession
    keys = [*group, *order]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // BLOCK_ROWS)
    ranged = stash(rows.repartitionByRange(n, *keys).withColumn("_block", F.spark_partition_id()), "deck")
    w = W.partitionBy(*group, "_block").orderBy(*order)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.concat_ws("|", *[F.col(c).cast("string") for c in order]).alias("d"), F.col("_at").alias("at")))
    blocks = ranged.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    several = blocks.withColumn("_m", F.count("*").over(W.partitionBy(*group))).where("_m > 1")
    split = small(stash(several.select(*group, "_block"), "split"))
    placed = ranged.withColumn("_at", F.row_number().over(w).cast("bigint")).withColumn("_here", here)
    local = placed.withColumn("_prev", F.last("_here", True).over(w)).withColumn("_next", F.first("_here", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    # edges of the groups that lie in several blocks: at most two groups for each block
    edge = placed.join(split, [*group, "_block"], "left_semi").groupBy(*group, "_block").agg(F.max(F.struct("_at", "_here")).alias("_end"), F.min(F.when(F.col("_here").isNotNull(), F.struct("_at", "_here"))).alias("_lo"), F.max(F.when(F.col("_here").isNotNull(), F.struct("_at", "_here"))).alias("_hi"))
    g = W.partitionBy(*group).orderBy("_block")
    offset = F.coalesce(F.sum("_end._at").over(g.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifted = lambda c: F.when(F.col(f"{c}._here").isNotNull(), F.struct(F.col(f"{c}._here.v").alias("v"), F.col(f"{c}._here.d").alias("d"), (F.col(f"{c}._at") + F.col("_off")).alias("at")))
    edge = edge.withColumn("_off", offset).withColumn("_l", shifted("_lo")).withColumn("_h", shifted("_hi"))
    edge = edge.select(*group, "_block", "_off", F.last("_h", True).over(g.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("_l", True).over(g.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    j = local.join(small(stash(edge, "edges")), [*group, "_block"], "left")
    off = F.coalesce("_off", F.lit(0))
    move = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.v").alias("v"), F.col(f"{c}.d").alias("d"), (F.col(f"{c}.at") + off).alias("at")))
    j = j.withColumn("_p", F.coalesce(move("_prev"), F.col("_before"))).withColumn("_q", F.coalesce(move("_next"), F.col("_after"))).withColumn("_at", F.col("_at") + off)
    back, ahead = F.col("_at") - F.col("_p.at"), F.col("_q.at") - F.col("_at")
    donor = F.when(F.col("_p").isNotNull() & (F.col("_q").isNull() | (back <= ahead)), F.col("_p")).otherwise(F.col("_q"))
    known = None
    for c in group:
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    filled = F.col(value).isNull() & donor.isNotNull() & known
    return j.select(*rows.columns, F.coalesce(value, F.when(filled, donor["v"])).alias("filled_value"), F.coalesce(filled, F.lit(False)).alias("filled"), F.when(filled, donor["d"]).alias("donor"), F.when(filled, F.abs(F.col("_at") - donor["at"])).alias("distance"))


def usable_matrix_score(score: Column, is_rating: Column) -> Column:
    """A fraction from 0 to 1, or for a rating a positive number below 3,000."""
    c = F.when(is_rating, (score > 0) & (score < 3000)).otherwise((score >= 0) & (score <= 1))
    return F.coalesce(c & ~F.isnan(score), F.lit(False))


def matrix_cells(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(run_id, benchmark, model, score, metric, present): one row for each cell, with null for what is missing.

    A run's benchmarks and models both come from bounded catalogs, and the cells are what has to be filled, so the lists
    of a run are joined on the run. Of repeated rows the latest usable value counts.
    """
    rating = [r.id for r in catalog_rows(benchmarks.where("scale = 'rating'").select("id"))]
    ok = usable_matrix_score(F.col("score"), F.col("benchmark").isin(*rating) if rating else F.lit(False))
    named = scores.where("run_id is not null and benchmark is not null and model is not null")
    rows = named.groupBy("run_id", "benchmark", "model").agg(F.max_by(F.when(ok, F.col("score")), F.when(ok, F.struct("loaded_at", "score"))).alias("score"), F.max_by(F.when(usable_text(F.col("metric")), F.regexp_replace(F.lower(F.trim("metric")), r"\s+", "_")), F.when(usable_text(F.col("metric")), F.struct("loaded_at", "metric"))).alias("metric"))
    marked = rows.withColumn("present", F.lit(True))
    axes = named.groupBy("run_id", "benchmark").agg(F.lit(1).alias("_b")).drop("_b").join(named.groupBy("run_id", "model").agg(F.lit(1).alias("_m")).drop("_m"), "run_id")
    return axes.join(marked, ["run_id", "benchmark", "model"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def filled_scores(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Cells of the score matrix with their gaps filled: (run_id, benchmark, model, field_name, value, filled, donor, distance).

    Models of a run and benchmark are ordered by id, so those of a family and generation stand together. The metric of
    an absent cell is no gap.
    """
    cells = stash(matrix_cells(scores, benchmarks), "cells")
    one = lambda field, df: df.select("run_id", "benchmark", "model", F.lit(field).alias("field_name"), F.col(field).cast("string").alias("value"))
    rows = one("score", cells).unionByName(one("metric", cells.where("present")))
    out = hot_deck(rows, ["run_id", "benchmark", "field_name"], ["model"], "value")
    return out.select("run_id", "benchmark", "model", "field_name", F.col("filled_value").alias("value"), "filled", "donor", "distance")


def filled_records(records: DataFrame) -> DataFrame:
    """Score records with missing scores filled: (record_id, run_id, benchmark_id, model_id, value, filled, donor, distance)."""
    rows = records.select("record_id", "run_id", "benchmark_id", "model_id", F.when(usable_score(F.col("score")), F.col("score")).alias("value")).withColumn("_model", F.coalesce(F.lower("model_id"), F.lit("")))
    out = hot_deck(rows, ["run_id", "benchmark_id"], ["_model", "record_id"], "value")
    return out.select("record_id", "run_id", "benchmark_id", "model_id", F.col("filled_value").alias("value"), "filled", "donor", "distance")


def gaps_filled(scores: DataFrame, records: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(origin, row_key, field_name) of everything that was missing and is filled."""
    a = filled_scores(scores, benchmarks).where("filled").select(F.lit("scores").alias("origin"), F.concat_ws("|", "run_id", "benchmark", "model").alias("row_key"), "field_name")
    b = filled_records(records).where("filled").select(F.lit("score_records").alias("origin"), F.col("record_id").cast("string").alias("row_key"), F.lit("score").alias("field_name"))
    return a.unionByName(b)
