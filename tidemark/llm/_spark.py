"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keep(df: DataFrame) -> DataFrame:
    """A checkpoint of df in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local session, as in tests, gets a
    temporary one, and a cluster's raises, as its machines share no such folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, which is a checkpoint, as the broadcast side of a join if it has no more than most rows, else as it is.

    Beyond that the join shuffles, and its skewed partitions split, as both sides are exchanged for it.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
