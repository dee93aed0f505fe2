"""Intermediate results in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _set_folder(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that the cluster names in spark.checkpoint.dir.

    Where the setting is missing on one machine, as in tests, a folder of our own is set; on a cluster that is an error.
    """
    _set_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in that folder, for results that a job keeps there."""
    _set_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Rows of a side table that is sent to all tasks whole.
SENT = 100_000


def few(df: DataFrame, what: str, most: int = SENT) -> DataFrame:
    """df, counted first, to be sent to all tasks; an error if it has more rows than that."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} {what}")
    return F.broadcast(df)
