"""Where intermediate tables are kept: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The context's checkpoint folder. One is made here only in local mode, where the cluster names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="evidentia-checkpoint-"))
    return context.getCheckpointDir()


#: Makes Spark delete the shuffle files of an execution when it ends; they are of no use once its result is in the checkpoint folder.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock, _inside = threading.Lock(), {}


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """CLEAN_UP while any thread of the session is inside; the first one in sets it, the last one out puts it back."""
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _inside.get(key, (0, None))
        if n == 0:
            before = spark.conf.get(CLEAN_UP, "false")
            spark.conf.set(CLEAN_UP, "true")
        _inside[key] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _inside[key]
            if n == 1:
                spark.conf.set(CLEAN_UP, before)
                del _inside[key]
            else:
                _inside[key] = n - 1, before


def cut_lineage(df: DataFrame) -> DataFrame:
    """df computed once and read back from the checkpoint folder: lost executors cost no recomputation of what came before."""
    checkpoint_dir(df.sparkSession)
    with _cleaning(df.sparkSession):
        return df.checkpoint(eager=True)


def stage_folder(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder, for tables written between the stages of one run."""
    return f"{checkpoint_dir(spark)}/stages-{uuid.uuid4().hex}"


def fitted(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """df in about rows / per_task tasks where that is fewer than it has: a table that has shrunk needs no task for each shuffle partition."""
    return df.coalesce(max(1, -(-rows // per_task)))


#: Bytes of an Arrow batch, unless the session sets another bound: rows alone don't bound a Python worker's memory.
BATCH_BYTES = 8_000_000
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, limit: int = BATCH_BYTES) -> DataFrame:
    """df, whose session from now on bounds the bytes of the batches that Python workers are sent, if it didn't before."""
    conf = df.sparkSession.conf
    if conf.get(_BATCHES, None) in (None, "-1", str((1 << 31) - 1), str((1 << 63) - 1)):
        conf.set(_BATCHES, str(limit))
    return df
