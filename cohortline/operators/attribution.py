"""Attribution: contributions of features to a record's probability, and one-feature sweeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, stats
from ..sources.shared import few
from .bayes import INTERVAL, NODES, WEIGHTS, agreement, linear, quadratic


def representative_cases(scored: DataFrame, row_id: str) -> DataFrame:
    """(kind, row): the surest correct record of each class, the one nearest to 0.5 and the least certain one; a record only once.

    Where no record of a class is right, the surest of all counts.
    """
    p, y, r = F.col("p"), F.col("y"), F.col(row_id)
    right0, right1 = (y == 0) & (p < 0.5), (y == 1) & (p >= 0.5)
    pick = lambda order: F.min(F.struct(order, r)).getField(row_id)
    some = lambda ok, order: F.coalesce(F.min(F.when(ok, F.struct(order, r))).getField(row_id), pick(order))
    top = scored.agg(some(right0, p.alias("o")).alias("confident_0"), some(right1, (-p).alias("o")).alias("confident_1"), pick(F.abs(p - 0.5).alias("o")).alias("boundary"), pick((-F.col("p_std")).alias("o")).alias("uncertain"))
    kinds = ["confident_0", "confident_1", "boundary", "uncertain"]
    return top.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), F.col(k).alias("row")) for i, k in enumerate(kinds)])).alias("e")).select("e.*").groupBy("row").agg(F.min_by("kind", "i").alias("kind"))


def contributions(df: DataFrame, row_id: str, names: list[str], sample: DataFrame) -> DataFrame:
    """(row, feature, and of the logit and the probability contributions: mean, std, 95 % interval, share above 0, mean and std of the
    absolute value) over a table of draws (draw, b0, b1, ...).

    Rows are few cases; the draw table is small, and a group has one value a draw. Ends of intervals are Hazen quantiles.
    """
    joined = df.crossJoin(few(sample, "draws"))
    z = sum((F.col(c) * F.col(f"b{i + 1}") for i, c in enumerate(names)), F.col("b0"))
    p = rules.sigmoid(z)
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) * F.col(f"b{i + 1}")).alias("logit")) for i, c in enumerate(names)])
    long = joined.select(row_id, p.alias("p"), F.explode(parts).alias("e")).select(row_id, "e.feature", "e.logit", (F.col("e.logit") * F.col("p") * (1 - F.col("p"))).alias("prob"))
    end = lambda c, p: stats.hazen_of_sorted(F.sort_array(F.collect_list(c)), p)
    ends = [x for c in ("logit", "prob") for x in (end(c, 0.025).alias(f"{c}_lo"), end(c, 0.975).alias(f"{c}_hi"), F.stddev_samp(F.abs(c)).alias(f"{c}_abs_std"))]
    return long.groupBy(row_id, "feature").agg(*ends, *[x for c in ("logit", "prob") for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.avg((F.col(c) > 0).cast("double")).alias(f"{c}_positive"), F.avg(F.abs(c)).alias(f"{c}_abs_mean"))])


def attribution_uncertainty(df: DataFrame, names: list[str], b: np.ndarray, cov: np.ndarray) -> DataFrame:
    """df with attr_unc: the standard deviation of p(1-p) b_j x_j over the posterior, averaged over features.

    A coefficient and the logit are jointly normal, so given the logit the coefficient has a known mean and variance, and one sum over the logit's quadrature is left.
    """
    df = df.withColumn("_mu", linear(names, b)).withColumn("_s", F.sqrt(F.greatest(quadratic(names, cov), F.lit(1e-18))))
    nodes = F.array(*[F.struct(F.lit(float(x)).alias("xi"), F.lit(float(w)).alias("w")) for x, w in zip(NODES, WEIGHTS, strict=True)])

    def slope(n):
        p = rules.sigmoid(F.col("_mu") + F.col("_s") * n["xi"])
        return F.struct(n["xi"].alias("xi"), n["w"].alias("w"), (p * (1 - p)).alias("d"))

    df = df.withColumn("_n", F.transform(nodes, slope))
    one = [F.lit(1.0), *[F.col(c) for c in names]]
    shares = [sum((one[i] * float(cov[i, j]) for i in range(1, len(one))), one[0] * float(cov[0, j])) / F.col("_s") for j in range(1, len(one))]
    df = df.withColumn("_c", F.array(*shares))
    parts = F.array(*[F.struct(F.abs(one[j]).alias("x"), F.get("_c", F.lit(j - 1)).alias("c"), F.lit(float(b[j])).alias("b"), F.lit(float(cov[j, j])).alias("v")) for j in range(1, len(one))])

    def spread(e):
        first = F.aggregate("_n", F.lit(0.0), lambda t, n: t + n["w"] * n["d"] * (e["b"] + e["c"] * n["xi"]))
        rest = F.greatest(e["v"] - e["c"] * e["c"], F.lit(0.0))
        second = F.aggregate("_n", F.lit(0.0), lambda t, n: t + n["w"] * n["d"] * n["d"] * ((e["b"] + e["c"] * n["xi"]) * (e["b"] + e["c"] * n["xi"]) + rest))
        return e["x"] * F.sqrt(F.greatest(second - first * first, F.lit(0.0)))

    mean = F.aggregate(F.transform(parts, spread), F.lit(0.0), lambda t, x: t + x) / len(names)
    return df.withColumn("attr_unc", mean).drop("_mu", "_s", "_n", "_c")


def sweep(df: DataFrame, row_id: str, names: list[str], b: np.ndarray, cov: np.ndarray, limits: DataFrame, width: float = 2.5, points: int = 101, least: float = 0.8, most_change: float | None = None) -> DataFrame:
    """Every row, feature and grid point within the feature's observed limits, with p there and its posterior deviation and 95 % interval (p_std, ci_lo,
    ci_hi), the feature's contributions to the logit and the probability there (logit, logit_std, prob, prob_std), and whether the output is preserved.

    limits: (feature, low, high), a row for each feature. Preserved: the class stays, the posterior agrees with it by at least
    `least` and, if most_change is given, p moves no more than that. A step changes one feature, so mean and
    variance of the logit follow from the row's own by a rank-one update.
    """
    one = [F.lit(1.0), *[F.col(c) for c in names]]
    df = df.withColumn("_mu", linear(names, b)).withColumn("_v", quadratic(names, cov))
    parts = []
    for j, c in enumerate(names, 1):
        cx = sum((one[i] * float(cov[i, j]) for i in range(1, len(one))), one[0] * float(cov[0, j]))
        parts.append(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x"), F.lit(float(b[j])).alias("bj"), cx.alias("cx"), F.lit(float(cov[j, j])).alias("cjj")))
    rows = df.select(row_id, "_mu", "_v", F.explode(F.array(*parts)).alias("e")).select(row_id, "_mu", "_v", "e.*")
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("index"), (i * (2 * width / (points - 1)) - width).alias("offset")))
    rows = rows.join(limits, "feature").withColumn("g", F.explode(grid)).select("*", "g.*").drop("g").withColumn("z", F.col("x") + F.col("offset")).filter("z >= low AND z <= high")
    mu = F.col("_mu") + F.col("bj") * F.col("offset")
    v = F.greatest(F.col("_v") + 2 * F.col("offset") * F.col("cx") + F.col("offset") * F.col("offset") * F.col("cjj"), F.lit(0.0))
    rows = rows.withColumn("mu", mu).withColumn("s", F.sqrt(v))
    base, now = F.col("_mu") >= 0, F.col("mu") >= 0
    nodes = F.array(*[F.struct(F.lit(float(x)).alias("xi"), F.lit(float(w)).alias("w")) for x, w in zip(NODES, WEIGHTS, strict=True)])
    total = lambda of: F.aggregate(nodes, F.lit(0.0), lambda t, n: t + n["w"] * of(n["xi"]))
    mean = lambda m, s: total(lambda xi: rules.sigmoid(m + s * xi))
    p, p0 = mean(F.col("mu"), F.col("s")), mean(F.col("_mu"), F.sqrt(F.greatest("_v", F.lit(0.0))))
    ok = (base == now) & (F.col("agreement") >= least)
    rows = rows.withColumn("agreement", agreement(F.col("mu"), F.col("s"), base)).withColumn("p", p).withColumn("change", F.col("p") - p0)
    ok = ok & (F.abs("change") <= most_change) if most_change is not None else ok
    rows = rows.withColumn("preserved", ok)
    at = lambda xi: rules.sigmoid(F.col("mu") + F.col("s") * xi)
    bend = lambda xi: at(xi) * (1 - at(xi))
    deviation = lambda square, first: F.sqrt(F.greatest(square - first * first, F.lit(0.0)))
    # given the logit, the coefficient is normal about bj + share * xi
    rows = rows.withColumn("share", F.when(F.col("s") > 0, (F.col("cx") + F.col("offset") * F.col("cjj")) / F.col("s")).otherwise(0.0))
    left = F.greatest(F.col("cjj") - F.col("share") * F.col("share"), F.lit(0.0))
    slope = lambda xi: F.col("bj") + F.col("share") * xi
    rows = rows.withColumns(
        {
            "p_std": deviation(total(lambda xi: at(xi) * at(xi)), F.col("p")),
            "ci_lo": rules.sigmoid(F.col("mu") - INTERVAL * F.col("s")),
            "ci_hi": rules.sigmoid(F.col("mu") + INTERVAL * F.col("s")),
            "logit": F.col("bj") * F.col("z"),
            "logit_std": F.abs("z") * F.sqrt("cjj"),
            "_first": total(lambda xi: bend(xi) * slope(xi)),
            "_square": total(lambda xi: bend(xi) * bend(xi) * (slope(xi) * slope(xi) + left)),
        }
    )
    rows = rows.withColumns({"prob": F.col("z") * F.col("_first"), "prob_std": F.abs("z") * deviation(F.col("_square"), F.col("_first"))})
    return rows.select(row_id, "feature", "index", "offset", "z", "p", "p_std", "ci_lo", "ci_hi", "logit", "logit_std", "prob", "prob_std", "change", "agreement", "preserved")


def preserving_ranges(swept: DataFrame, row_id: str, scale: DataFrame | None = None) -> DataFrame:
    """(row, feature, min_z, max_z, width, points): where the output is preserved; width 0 where it never is.

    scale: (feature, mean, sd), a row for each feature of the model; adds the range and the width in the features' own units (low, high, own_width).
    """
    ok = F.when(F.col("preserved"), F.col("z"))
    out = swept.groupBy(row_id, "feature").agg(F.min(ok).alias("min_z"), F.max(ok).alias("max_z"), F.count_if("preserved").alias("points"))
    out = out.withColumn("width", F.coalesce(F.col("max_z") - F.col("min_z"), F.lit(0.0)))
    if scale is None:
        return out
    own = lambda z: F.col("mean") + F.col(z) * F.col("sd")
    return out.join(scale, "feature").withColumns({"low": own("min_z"), "high": own("max_z"), "own_width": F.col("width") * F.col("sd")}).drop("mean", "sd")


def ranges_by_feature(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("feature").agg(F.avg("width").alias("width_mean"), F.stddev_samp("width").alias("width_std"), F.median("width").alias("width_med"), F.avg(F.abs("width")).alias("width_abs"))


def surface(swept: DataFrame, measure: str, points: list[int]) -> DataFrame:
    """One row for each feature, a column for each grid point: the mean of a measure."""
    out = swept.groupBy("feature").pivot("index", points).agg(F.avg(measure))
    return out.select("feature", *[F.col(f"`{i}`").alias(f"i{i}") for i in points])
