"""Evaluation metrics as grouped aggregates over predictions (keys, row_id, y, p).

Sorted scores are handled in two levels: counts of score bins first, then order within a bin. So
no task sorts a whole table, however few groups there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import few

BINS = 1000


def _bin(p: Column) -> Column:
    return F.least(F.floor(p * BINS), F.lit(BINS - 1)).cast("int")


def confusion(df: DataFrame, keys: list[str], threshold: float = 0.5, zero: bool = False) -> DataFrame:
    """Counts and the rates made of them; a rate whose denominator is 0 is null, or 0 (zero)."""
    y, hit = F.col("y") == 1, F.col("p") >= threshold
    out = df.groupBy(*keys).agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"))
    div = (lambda a, b: a / F.greatest(b, F.lit(1))) if zero else F.try_divide
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    out = out.withColumns({"accuracy": div(tp + tn, tp + tn + fp + fn), "recall1": div(tp, tp + fn), "recall0": div(tn, tn + fp), "precision1": div(tp, tp + fp), "precision0": div(tn, tn + fn)})
    f1 = lambda c: div(2 * F.col(f"recall{c}") * F.col(f"precision{c}"), F.col(f"recall{c}") + F.col(f"precision{c}"))
    return out.withColumns({"balanced_accuracy": (F.col("recall0") + F.col("recall1")) / 2, "macro_f1": (F.coalesce(f1(0), F.lit(0.0)) + F.coalesce(f1(1), F.lit(0.0))) / 2, "specificity": F.col("recall0")})


def losses(df: DataFrame, keys: list[str], clip: float = 1e-12) -> DataFrame:
    """Brier score and negative log likelihood of p clipped."""
    q = F.least(F.greatest(F.col("p"), F.lit(clip)), F.lit(1 - clip))
    nll = -F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))
    return df.groupBy(*keys).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg(nll).alias("nll"))


def calibration_error(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    per = df.groupBy(*keys, b.alias("b")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    whole = F.sum("n")
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / whole).alias("ece"))


def area_under_roc(df: DataFrame, keys: list[str], eps: float = 0.0) -> DataFrame:
    """AUC by rank sums with average ranks of ties; null where a class is missing."""
    per = df.groupBy(*keys, _bin(F.col("p")).alias("b"), "p").agg(F.sum("y").alias("pos"), (F.count("*") - F.sum("y")).alias("neg"))
    bins = per.groupBy(*keys, "b").agg(F.sum("neg").alias("n"))
    before = bins.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys, "b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = F.col("pos") * (F.col("base") + F.col("inside") + F.col("neg") / 2)
    out = per.withColumn("inside", inside).join(before, [*keys, "b"]).groupBy(*keys).agg(F.sum(won).alias("w"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return out.select(*keys, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("w") / (F.col("np") * F.col("nn") + eps)).alias("auc"))


def _descending(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the true and false positives among those not after them, by falling p, then row_id; and the totals."""
    rows = df.withColumn("b", _bin(F.col("p")))
    bins = rows.groupBy(*keys, "b").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    up = w.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "b", F.coalesce(F.sum("pos").over(up), F.lit(0)).alias("bp"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("bn"), F.sum("pos").over(w).alias("all_pos"), F.sum("n").over(w).alias("all_n"))
    own = Window.partitionBy(*keys, "b").orderBy(F.col("p").desc(), "row_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"ip": F.sum("y").over(own), "in_": F.count("*").over(own)})
    return rows.join(bins, [*keys, "b"]).withColumns({"tp": F.col("bp") + F.col("ip"), "fp": F.col("bn") + F.col("in_") - F.col("bp") - F.col("ip")})


def area_under_pr(df: DataFrame, keys: list[str]) -> DataFrame:
    """Area under precision over recall by trapezoids from (0, 1), rows in the order of falling p, then row_id.

    Only rows of class 1 widen the recall, by one step each; the precision before such a row follows from its own counts.
    """
    rows = _descending(df, keys).filter("y = 1")
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    seen = F.col("tp") + F.col("fp") - 1
    before = F.when(seen > 0, (F.col("tp") - 1) / seen).otherwise(1.0)
    return rows.groupBy(*keys).agg((F.sum((now + before) / 2) / F.first("all_pos")).alias("auprc"))


def best_threshold(df: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold with the best balanced accuracy, the first of equals: of a grid and all values of p.

    Grid: 0.05, 0.1, 0.15 to 0.85 by 0.01, 0.9, 0.95. Candidates between two values of p are alike, so
    each takes the counts of the values from it on.
    """
    grid = [0.05, 0.1, *[round(0.15 + 0.01 * i, 2) for i in range(71)], 0.9, 0.95]
    points = df.select(*keys).distinct().withColumn("p", F.explode(F.array(*[F.lit(g) for g in grid]))) if keys else df.sparkSession.createDataFrame([(g,) for g in grid], "p double")
    zero = points.select(*keys, "p", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"))
    per = df.groupBy(*keys, "p").agg(F.sum("y").cast("long").alias("pos"), F.count("*").alias("n")).unionByName(zero).groupBy(*keys, "p").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).withColumn("b", _bin(F.col("p")))
    w = Window.partitionBy(*keys)
    bins = per.groupBy(*keys, "b").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    above = w.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "b", F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("bn"), F.sum("pos").over(w).alias("all_pos"), F.sum("n").over(w).alias("all_n"))
    own = Window.partitionBy(*keys, "b").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = per.select(*keys, "b", "p", F.sum("pos").over(own).alias("ip"), F.sum("n").over(own).alias("in_")).join(bins, [*keys, "b"])
    tp, n = F.col("bp") + F.col("ip"), F.col("bn") + F.col("in_")
    negatives = F.col("all_n") - F.col("all_pos")
    ba = (F.try_divide(tp, F.col("all_pos")) + F.try_divide(negatives - (n - tp), negatives)) / 2
    rows = rows.withColumn("ba", F.round(ba, 12))
    return rows.groupBy(*keys).agg(F.max(F.struct("ba", (-F.col("p")).alias("m"))).alias("m")).select(*keys, (-F.col("m.m")).alias("threshold"), F.col("m.ba").alias("train_ba"))


def uncertainty(df: DataFrame, keys: list[str]) -> DataFrame:
    """Means of p_std, entropy, the width of the interval and attr_unc, of those that df has, over all records and those of each class."""
    of = {"p_std": F.col("p_std"), "entropy": F.col("entropy"), "ci_width": F.col("ci_hi") - F.col("ci_lo"), "attr_unc": F.col("attr_unc")}
    needs = {"ci_width": {"ci_hi", "ci_lo"}}
    have = [(n, c) for n, c in of.items() if needs.get(n, {n}) <= set(df.columns)]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[x for n, c in have for x in (F.avg(c).alias(f"{n}_mean"), F.avg(F.when(F.col("y") == 0, c)).alias(f"{n}_mean0"), F.avg(F.when(F.col("y") == 1, c)).alias(f"{n}_mean1"))])


def evaluate(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """All metrics of each key, with the means of what uncertainty columns there are."""
    out = confusion(df, keys, threshold)
    if {"p_std", "entropy", "ci_lo", "attr_unc"} & set(df.columns):
        out = out.join(uncertainty(df, keys).drop("n"), keys, "left")
    for part in (losses(df, keys), calibration_error(df, keys), area_under_roc(df, keys), area_under_pr(df, keys)):
        out = out.join(part, keys, "left")
    return out


def summarize(raw: DataFrame, keys: list[str], names: list[str], status: str | None = None) -> DataFrame:
    """Mean and standard deviation of each metric and the number of runs; failed runs don't count."""
    rows = raw.filter(F.col(status) == "OK") if status else raw
    return rows.groupBy(*keys).agg(F.count("*").alias("runs"), *[x for c in names for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])


def leaderboard(summary: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n best rows, nulls last."""
    return summary.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)


def selection_stability(selected: DataFrame, keys: list[str], features: DataFrame, fold: str = "fold") -> DataFrame:
    """Share of folds in which each feature was selected; features never selected have 0. selected: (keys, fold, features array)."""
    n = selected.groupBy(*keys).agg(F.countDistinct(fold).alias("folds"))
    hits = selected.select(*keys, F.explode("features").alias("feature")).groupBy(*keys, "feature").agg(F.count("*").alias("times"))
    return n.crossJoin(few(features, "features")).join(hits, [*keys, "feature"], "left").select(*keys, "feature", F.coalesce("times", F.lit(0)).alias("times"), (F.coalesce("times", F.lit(0)) / F.col("folds")).alias("stability"))
