"""Feature ranking: effect sizes, AUC distance, top features of each fold, redundancy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import metrics


def class_moments(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, feature, n0, n1, m0, m1, v0, v1) of (keys, feature, y, value); null values don't count."""
    one = lambda c: F.when(F.col("y") == c, F.col(value))
    return long.groupBy(*keys, "feature").agg(*[x for c in (0, 1) for x in (F.count(one(c)).alias(f"n{c}"), F.avg(one(c)).alias(f"m{c}"), F.var_samp(one(c)).alias(f"v{c}"))])


def effect_sizes(moments: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Adds effect (absolute), signed_effect and cohens_d (pooled; null under two values of a class)."""
    d = F.col("m1") - F.col("m0")
    mean_sd = F.sqrt(0.5 * (F.col("v0") + F.col("v1")) + eps)
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    enough = (F.col("n0") >= 2) & (F.col("n1") >= 2)
    return moments.withColumns({"effect": F.abs(d) / mean_sd, "signed_effect": d / mean_sd, "cohens_d": F.when(enough & (pooled > 0), d / pooled)})


def guide_scores(effects: DataFrame, keys: list[str], keep: float = 0.35, low: float = 0.25) -> DataFrame:
    """Scores that guide the search: the scaled absolute effect, less for the class it doesn't favour, and less outside the top share.

    The factors are fixed values. The top share begins at the Hazen quantile of the scaled effects; a key's features are few. An effect of 0 favours both classes.
    """
    w = Window.partitionBy(*keys)
    a = F.abs("signed_effect")
    scaled = F.when(F.max(a).over(w) > F.min(a).over(w), (a - F.min(a).over(w)) / (F.max(a).over(w) - F.min(a).over(w))).otherwise(0.0)
    out = effects.withColumn("base", scaled)
    cutoff = stats.hazen_of_sorted(F.sort_array(F.collect_list("base").over(w)), 1 - keep)
    out = out.withColumn("_c", cutoff).withColumn("_d", F.when(F.col("base") >= F.col("_c"), 1.0).otherwise(low) * F.col("base"))
    favours = lambda ok: F.col("_d") * F.when(ok, 1.0).otherwise(0.65)
    return out.withColumns({"decline_score": favours(F.col("signed_effect") >= 0), "maintain_score": favours(F.col("signed_effect") <= 0), "balanced_score": F.col("_d")}).drop("_c", "_d")


def auc_distance(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """abs(AUC - 0.5) of each feature, the value scaled to [0, 1] as its score."""
    by = [*keys, "feature"]
    ends = long.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    p = F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    scored = long.filter(F.col(value).isNotNull()).join(ends, by).select(*by, "y", p.alias("p"))
    return metrics.area_under_roc(scored, by).select(*by, F.abs(F.col("auc") - 0.5).alias("auc_distance"))


def top_features(scores: DataFrame, keys: list[str], score: str, k: int) -> DataFrame:
    """(keys, features array in the order of names) with the k best scores; missing scores come last."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), "feature")
    return scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list("feature")).alias("features"))


def mean_abs_correlation(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean absolute correlation of all pairs of columns, over the rows that have both values, those that aren't finite as 0.

    One pass of matrix products; tasks give out sums of products, which are added up by place, so the plan doesn't grow with the pairs.
    """
    d = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            ok = np.isfinite(x)
            x, m = np.where(ok, x, 0.0), ok.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, "v array<double>")
    sums = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # four numbers a pair
    flat = np.zeros(4 * d * d)
    for r in sums:
        flat[r["i"]] = r["v"]
    n, sx, sxx, sxy = flat.reshape(4, d, d)
    with np.errstate(all="ignore"):
        spread = sxx / n - (sx / n) ** 2
        r = np.abs((sxy / n - sx / n * sx.T / n) / np.sqrt(spread * spread.T))
    pairs = np.where(np.isfinite(r), r, 0.0)[np.triu_indices(d, 1)]
    return df.sparkSession.createDataFrame([(float(pairs.mean()) if len(pairs) else 0.0,)], "redundancy double")
