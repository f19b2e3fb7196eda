"""Tables that are read more than once, computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def keep(df: DataFrame) -> DataFrame:
    """A checkpoint of df in the folder that all executors share, for what is small against its inputs and read again.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one, and a
    cluster's raises, as its machines share no such folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
