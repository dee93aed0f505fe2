"""Folds by subject: all records of a person are in one fold, and folds share the classes evenly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def hash_rank(df: DataFrame, keys: list[str], order: str, tie: str, out: str) -> DataFrame:
    """df with the rank (from 0) of each row within its keys by a hexadecimal hash column, then the tie column.

    Ranks come in two levels, the number of rows under smaller hash prefixes and the place among rows of
    the same prefix, so no task gets all rows of a key.
    """
    df = df.withColumn("_b", F.substring(order, 1, 3))
    below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*keys, "_b").agg(F.count("*").alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(below), F.lit(0))).drop("_c")
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order, tie)) - 1
    return df.withColumn("_p", place).join(base, [*keys, "_b"]).withColumn(out, F.col("_base") + F.col("_p")).drop("_b", "_p", "_base")


def subject_folds(df: DataFrame, subject: str, y: str, k: int, seeds: list[int]) -> DataFrame:
    """(seed, subject, fold from 1, positive): within each class subjects are dealt in turn, in an order that the seed fixes.

    A subject is positive if any of its records is.
    """
    subjects = df.filter(F.col(subject).isNotNull()).groupBy(F.col(subject).alias("subject")).agg(F.max(y).alias("positive"))
    spread = subjects.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")))
    order = F.md5(F.concat(F.col("seed").cast("string"), F.lit("|"), F.col("subject").cast("string")))
    ranked = hash_rank(spread.withColumn("_o", order), ["seed", "positive"], "_o", "subject", "_r")
    return ranked.select("seed", "subject", (F.col("_r") % k + 1).cast("int").alias("fold"), "positive")


def record_folds(df: DataFrame, record: str, y: str, k: int, seed: int) -> DataFrame:
    """df with the fold of each record, dealt in turn within its class."""
    ranked = hash_rank(df.withColumn("_o", stats.hash_order(seed, F.col(record))), [y], "_o", record, "_r")
    return ranked.withColumn("fold", (F.col("_r") % k + 1).cast("int")).select(*df.columns, "fold")


def valid_seeds(df: DataFrame, folds: DataFrame, subject: str, y: str, k: int) -> DataFrame:
    """Seeds all of whose folds have both classes in the fold and outside of it, in ascending order."""
    joined = df.select(F.col(subject).alias("subject"), y).join(folds, "subject")
    per = joined.groupBy("seed", "fold").agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy("seed")
    per = per.withColumns({"all_pos": F.sum("pos").over(w), "all_n": F.sum("n").over(w)})
    ok = (F.col("pos") > 0) & (F.col("pos") < F.col("n")) & (F.col("all_pos") > F.col("pos")) & (F.col("all_n") - F.col("all_pos") > F.col("n") - F.col("pos"))
    return per.groupBy("seed").agg(F.min(ok.cast("int")).alias("ok"), F.count("*").alias("folds")).filter((F.col("ok") == 1) & (F.col("folds") == k)).select("seed").orderBy("seed")


def with_own_subjects(df: DataFrame, subject: str, record: str) -> DataFrame:
    """df with its subjects as texts; a record without one (null or blank) is a subject of its own."""
    name = F.trim(F.col(subject).cast("string"))
    return df.withColumn(subject, F.when(F.length(name) > 0, name).otherwise(F.concat(F.lit("__no_subject_"), F.col(record).cast("string"))))


def dealt_folds(df: DataFrame, subject: str, y: str, k: int, seeds: list[int], attempts: int = 200) -> tuple[DataFrame, int]:
    """(seed, subject, fold, positive) in which every fold and its rest have both classes, and the number of folds.

    Folds are no more than the subjects of either class; fewer than two are an error. A seed stands for the first of
    the draws seed, seed + 1, ... that is valid; no valid one in so many attempts is an error. Subjects must not be null.
    """
    n = df.groupBy(F.col(subject)).agg(F.max(y).alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("b"), F.count("*").alias("n")).head()
    k = min(k, int(n["b"]), int(n["n"] - n["b"]))
    if k < 2:
        raise ValueError(f"two folds need two subjects of each class; there are {n['n'] - n['b']} and {n['b']}")
    chosen: dict[int, int] = {}
    tried, width = 0, 1
    while tried < attempts and len(chosen) < len(set(seeds)):  # one draw first, then more of them in a job
        some = range(tried, min(tried + width, attempts))
        draws = sorted({s + i for s in seeds if s not in chosen for i in some})
        ok = {r["seed"] for r in valid_seeds(df, subject_folds(df, subject, y, k, draws), subject, y, k).collect()}  # one number a draw
        for s in set(seeds) - set(chosen):
            chosen |= {s: s + i for i in reversed(some) if s + i in ok}
        tried, width = tried + width, width * 8
    if len(chosen) < len(set(seeds)):
        raise ValueError(f"no folds with both classes in {attempts} attempts for seeds {sorted(set(seeds) - set(chosen))}")
    drawn = subject_folds(df, subject, y, k, sorted(set(chosen.values()))).withColumnRenamed("seed", "_draw")
    names = df.sparkSession.createDataFrame(sorted(chosen.items()), "seed int, _draw int")
    return drawn.join(F.broadcast(names), "_draw").select("seed", "subject", "fold", "positive"), k


def fold_of_records(df: DataFrame, folds: DataFrame, subject: str) -> DataFrame:
    """Each record with the folds of its subject; give records without a subject their own first."""
    return df.join(folds.withColumnRenamed("subject", subject).drop("positive"), subject)


def subjects_by_class(df: DataFrame, subject: str, y: str) -> DataFrame:
    """Subjects of each class and those with records of both."""
    per = df.groupBy(subject).agg(F.max((F.col(y) == 0).cast("int")).alias("a"), F.max((F.col(y) == 1).cast("int")).alias("b"))
    return per.agg(F.sum("a").alias("n_class0"), F.sum("b").alias("n_class1"), F.sum(F.col("a") * F.col("b")).alias("n_mixed"))
