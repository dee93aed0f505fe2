"""Analysis of a fixed signature by cross-validation: metrics, coefficients and attribution over all folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, stats
from ..operators import bayes, prep
from ..sources.shared import checkpointed
from .validation import Design, prepared


def fold_coefficients(df: DataFrame, record: str, subject: str, names: list[str], d: Design) -> DataFrame:
    """(seed, fold, feature, mean, sd, p_positive, attribution, attribution_abs): posterior of each fold's fit and the mean of b x p(1-p) over its held-out records."""
    spark = df.sparkSession
    names = sorted(names)
    rows = prepared(df, record, subject, names, d)
    wide = rows.groupBy("seed", "train", record, "y", "held_out").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "x"))), lambda e: e["x"]).alias("x"))
    wide = checkpointed(wide.withColumn("key", F.concat_ws("|", "seed", "train")))
    training = wide.filter("NOT held_out")
    training = checkpointed(training.join(prep.class_weights(training, ["key"], "y").withColumnRenamed("weight", "w"), ["key", "y"]))
    both = [r["key"] for r in training.groupBy("key").agg(F.countDistinct("y").alias("c")).filter("c = 2").select("key").collect()]  # one name for each fit
    fits = bayes.fit_logistic(training, len(names), sorted(both), d.prior)
    table = [(*map(int, k.split("|")), n, float(f.b[i + 1]), float(np.sqrt(max(f.cov[i + 1, i + 1], 0))), i) for k, f in fits.items() for i, n in enumerate(names)]
    coefficients = spark.createDataFrame(table, "seed int, fold int, feature string, mean double, sd double, i int")
    coefficients = coefficients.withColumn("p_positive", stats.normal_cdf(F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0)))
    scored = bayes.score_fits(wide.filter("held_out"), fits, ["seed", "train", record, "x"])
    parts = scored.select("seed", F.col("train").alias("fold"), "p", F.posexplode("x").alias("i", "v"))
    part = F.col("mean") * F.col("v") * F.col("p") * (1 - F.col("p"))
    means = parts.join(coefficients.select("seed", "fold", "i", "mean"), ["seed", "fold", "i"]).groupBy("seed", "fold", "i").agg(F.avg(part).alias("attribution"), F.avg(F.abs(part)).alias("attribution_abs"))
    return coefficients.join(means, ["seed", "fold", "i"], "left").drop("i")


def roll_up(per_fold: DataFrame) -> DataFrame:
    """Mean and spread over folds of coefficients and attributions, with the group of each feature and the direction."""
    values = ["mean", "attribution", "attribution_abs", "p_positive"]
    out = per_fold.groupBy("feature").agg(F.count("*").alias("folds"), *[x for c in values for x in (F.avg(c).alias(f"{c}_avg"), F.stddev_samp(c).alias(f"{c}_std"))])
    return out.withColumns({"grp": rules.feature_group(F.col("feature")), "direction": rules.direction(F.col("p_positive_avg"))})
