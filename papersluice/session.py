"""Session helpers: table loading, the shared work folder and guarded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; beyond it the join is left to the optimizer.
BROADCAST_ROWS = 100_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, unique folder that all executors share.

    The base is the session's ``spark.checkpoint.dir``. Only a single-JVM local session may go
    without that setting; it then gets a temporary folder that is removed at exit.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="papersluice-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores if it has at most half as many; else as it is.

    For work that costs far more than moving its input: a small table may lie in one file that can't be split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if it holds at most ``limit`` rows, else ``df`` as it is."""
    return F.broadcast(df) if len(df.limit(limit + 1).select(F.lit(1)).take(limit + 1)) <= limit else df
