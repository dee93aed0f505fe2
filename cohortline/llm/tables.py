"""Intermediate tables in the shared folder, so that a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset on one machine, as in tests, one of our own.

    On a cluster without that setting this is an error: other machines wouldn't see such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: later plans start there."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Arrow batches have at most so many rows and bytes: JVM and Python hold a batch of texts each way for every task.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to ours, where they are higher; plans read them when they run."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = spark.conf.get(key)
        except PySparkException:  # this Spark has no such limit
            continue
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Up to so many ids are sent to all tasks (16 bytes each); more are joined by a shuffle.
SEND_IDS = 1_000_000


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(SEND_IDS + 1).count() <= SEND_IDS else ids


def rows_with(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows of df whose id is in ids (one column of that name, distinct): sent to all tasks while they are few."""
    return df.join(_bounded(ids), name, "left_semi")


def rows_without(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows of df whose id is null or isn't in ids (one column of that name, distinct)."""
    return df.join(_bounded(ids), name, "left_anti")


#: Keys with more rows than this, or than their total makes a millionth, are dealt over several tasks in a join.
OFTEN = 1_000


def often(counted: DataFrame, n: str = "c") -> DataFrame | None:
    """(key columns, parts) of the keys with many rows, from (key columns, number of rows); at most SEND_IDS of them. None if there are none."""
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).head()["n"]
    most = max(OFTEN, int(total) // SEND_IDS + 1)
    found = written(counted.filter(F.col(n) > most).withColumn("parts", F.ceil(F.col(n) / most).cast("int")).drop(n), "often")
    return found if found.head(1) else None


def join_spread(left: DataFrame, right: DataFrame, on: list[str], by: str, many: DataFrame | None) -> DataFrame:
    """Inner join in which the left rows of the keys in `many` are dealt to several tasks by the column `by`; right has few rows for a key."""
    if many is None:
        return left.join(right, on)
    many = F.broadcast(many)
    one = F.lit(1)
    left = left.join(many, on, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("parts", one))).drop("parts")
    right = right.join(many, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", one).cast("long") - 1))).drop("parts")
    return left.join(right, [*on, "_part"]).drop("_part")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id gives null."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), component being the smallest node reachable.

    Alternates two steps until nothing changes: each node's larger neighbours are linked to
    its smallest one, then its smaller neighbours are. Every step is a grouped minimum and a join,
    and no step makes more edges than there were.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if (now["n"], now["h"]) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = (now["n"], now["h"])


def no_text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))
