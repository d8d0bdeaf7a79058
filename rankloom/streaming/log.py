"""Append-only logs and drop folders as streams. The batch forms are in the queries; these keep state across batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def last_wins(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key; for a stream use it within each batch (see ``keep_latest``)."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


#: Folders that the state is spread over by the hash of its keys.
BUCKETS = 64


def keep_latest(log: DataFrame, keys: list[str], order: str, state: str, checkpoint: str) -> StreamingQuery:
    """Maintains the latest row of each key under ``state``: ``bucket=B/batch=N``, written anew only where a batch brings keys.

    A batch merges itself with the newest state before it of the buckets that it touches, so a batch that is repeated
    writes the same; older states of those buckets are then superseded (``latest_state`` reads the newest only).
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        before = _state(spark, state, n)
        if before is not None:
            new = before.where(F.col("bucket").isin(touched)).select(*new.columns).unionByName(new)
        last_wins(new, [*keys, "bucket"], order).withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(state)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _state(spark: SparkSession, state: str, before: int | None = None) -> DataFrame | None:
    """The newest state of each bucket, of the batches before one if it is given; None if there is none."""
    try:
        rows = spark.read.parquet(state)
    except AnalysisException:
        return None
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.select("bucket", "batch").distinct().groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), ["bucket", "batch"])  # BUCKETS rows


def latest_state(spark: SparkSession, state: str) -> DataFrame:
    return _state(spark, state).drop("bucket", "batch")


def dropped_files(spark: SparkSession, folder: str, watermark: str = "7 days") -> DataFrame:
    """Each content once: files of a folder as a stream, repeated deliveries within the watermark dropped by their hash."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.withColumn("sha", F.sha2("content", 256)).withWatermark("modificationTime", watermark).dropDuplicatesWithinWatermark(["sha"])
