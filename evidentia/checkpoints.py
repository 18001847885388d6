"""Where lineage is cut: the folder that all executors share, as the cluster names it in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The context's checkpoint folder. One is made here only in local mode, where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="evidentia-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df computed once and read back from the checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of an Arrow batch, unless the session sets another bound: rows alone don't bound a Python worker's memory.
BATCH_BYTES = 8_000_000
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, limit: int = BATCH_BYTES) -> DataFrame:
    """df, whose session from now on bounds the bytes of the batches that Python workers are sent, if it didn't before."""
    conf = df.sparkSession.conf
    if conf.get(_BATCHES, None) in (None, "-1", str((1 << 31) - 1), str((1 << 63) - 1)):
        conf.set(_BATCHES, str(limit))
    return df
