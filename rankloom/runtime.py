"""Session set-up and the helpers that cut lineage durably."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a catalog (models, benchmarks, kinds, ratios) may have to be sent to every executor.
CATALOG_ROWS = 200_000


def session(app: str = "rankloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect: UTC, adaptive execution, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine if the master is local, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


_written: list[str] = []


def stash(df: DataFrame, what: str = "t") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    The result has no lineage, so a lost executor costs a re-read and not a re-run of the loop that made it. The files
    stay as long as results may be read from them; ``sweep`` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Deletes all that ``stash`` wrote in this process; to be called once no result is read any more. Number of folders."""
    jvm, n = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def catalog_rows(df: DataFrame, most: int = CATALOG_ROWS) -> list:
    """The rows of a catalog, on the driver. Raises if there are more than ``most``: then it is no catalog."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: too many for a catalog that every executor holds")
    return rows


def small(df: DataFrame, most: int = CATALOG_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
