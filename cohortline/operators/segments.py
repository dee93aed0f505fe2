"""Sliding segments of sampled signals in long form: cutting, rejecting, capping, describing, rolling up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.shared import checkpointed
from . import folds


def robust_scale(df: DataFrame, key: str, value: str, out: str = "x", limit: float = 8.0) -> DataFrame:
    """Each signal centred on its median and divided by 1.4826 times its median absolute deviation (its standard deviation where that is 0), within +-limit."""
    half = {"_m": 0.5}
    center = df.groupBy(key).agg(F.stddev_samp(value).alias("_s")).join(stats.hazen_percentiles(df, [key], value, half), key, "left")
    moved = df.join(center, key).withColumn("_d", F.col(value) - F.col("_m"))
    spread = stats.hazen_percentiles(moved.select(key, F.abs("_d").alias("_d")), [key], "_d", {"_mad": 0.5})
    scale = F.when(F.col("_mad") > 0, F.col("_mad") * 1.4826).otherwise(F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))
    z = F.least(F.greatest(F.col("_d") / scale, F.lit(-limit)), F.lit(limit))
    return moved.join(spread, key, "left").withColumn(out, z).drop("_m", "_s", "_d", "_mad")


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with the place _i (from 0) of each row among the _n rows of its key, in order.

    Rows are sorted by ranges of (key, order), so a long signal lies in many ranges; places are those within a range plus the rows of
    the key in the ranges before, of which there is one number for each key and range.
    """
    at = checkpointed(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_id", F.monotonically_increasing_id()))
    at = at.withColumn("_range", F.shiftright("_id", 33))
    of_range = at.groupBy(key, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_c"))
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_range = of_range.select(key, "_range", "_first", before.alias("_before"), F.sum("_c").over(w).alias("_n"))
    return at.join(of_range, [key, "_range"]).withColumn("_i", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_range", "_first", "_before")


def cut_segments(df: DataFrame, key: str, order: list[str], length: int, hop: int) -> DataFrame:
    """Rows of full segments: key, segment (from 0), i (place in it) and the columns of df; a sample is in each segment that covers it. Keys must not be null."""
    rows = numbered(df, key, order)
    first = F.greatest(F.ceil((F.col("_i") - (length - 1)) / hop), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("_i") / hop), F.floor((F.col("_n") - length) / hop)).cast("int")
    rows = rows.filter(F.col("_n") >= length).withColumn("_f", first).withColumn("_l", last).filter("_f <= _l")
    return rows.withColumn("segment", F.explode(F.sequence("_f", "_l"))).withColumn("i", (F.col("_i") - F.col("segment") * hop).cast("int")).drop("_i", "_n", "_f", "_l")


def describe_segments(segments: DataFrame, key: str, x: str = "x", limit: float = 8.0, least_std: float = 0.05, most_jump: float = 5.0, high: float = 5.0, share: float = 0.05) -> DataFrame:
    """One row for each segment: mean, std, rms, range, mean_jump, and whether it is bad.

    Bad: a value that isn't finite or beyond the limit, a spread under least_std, a jump over
    most_jump, or more than the share of values beyond `high`.
    """
    v = F.col(x)
    step = F.abs(v - F.lag(v).over(Window.partitionBy(key, "segment").orderBy("i")))
    rows = segments.withColumn("_jump", step)
    odd = v.isNull() | F.isnan(v) | (F.abs(v) > limit)
    out = rows.groupBy(key, "segment").agg(
        F.avg(v).alias("mean"),
        stats.sample_std(x).alias("std"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        (F.max(v) - F.min(v)).alias("range"),
        F.avg("_jump").alias("mean_jump"),
        F.max(odd.cast("int")).alias("_odd"),
        F.max("_jump").alias("_most"),
        F.avg((F.abs(v) > high).cast("double")).alias("_high"),
    )
    bad = (F.col("_odd") == 1) | (F.col("std") < least_std) | (F.col("_most") > most_jump) | (F.col("_high") > share)
    return out.withColumn("bad", F.coalesce(bad, F.lit(True))).drop("_odd", "_most", "_high")


def cap_segments(segments: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most so many segments of each key, drawn by the seed, numbered anew in their order."""
    draw = stats.hash_order(seed, F.concat_ws("|", F.col(key).cast("string"), F.col("segment").cast("string")))
    kept = folds.hash_rank(segments.withColumn("_o", draw), [key], "_o", "segment", "_r").filter(F.col("_r") < most).drop("_o", "_r")
    return kept.withColumn("segment_id", F.row_number().over(Window.partitionBy(key).orderBy("segment")))


def roll_up(segments: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Mean, std, median and Hazen IQR of each descriptor, and the number of segments; groups are bounded by the cap."""
    aggs = [F.count("*").alias("num_segments")]
    for c in names:
        a = F.sort_array(F.collect_list(c))
        aggs += [F.avg(c).alias(f"{c}_mean"), stats.sample_std(c).alias(f"{c}_std"), F.median(c).alias(f"{c}_med")]
        aggs += [(stats.hazen_of_sorted(a, 0.75) - stats.hazen_of_sorted(a, 0.25)).alias(f"{c}_iqr")]
    return segments.groupBy(key).agg(*aggs)
