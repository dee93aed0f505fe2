"""Weighted Bayesian logistic models: many fits at once, posterior scores, draws.

All fits of a job take their steps together: each pass over the data sums gradient and Hessian of
every fit that hasn't converged, and only those sums, (p + 1)^2 numbers a fit, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules, stats


@dataclass(frozen=True)
class Prior:
    sd: float = 0.5
    intercept_sd: float | None = 20.0  # None: flat
    jitter: float = 1e-6
    max_iter: int = 200
    tol: float = 1e-6


@dataclass
class Fit:
    b: np.ndarray
    cov: np.ndarray
    iterations: int
    converged: bool
    grad_norm: float = field(default=0.0)


def _packed(batches: Iterator[pa.RecordBatch], theta: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        key = np.array(batch.column("key").to_pylist(), object)
        y, w = batch.column("y").to_numpy(zero_copy_only=False).astype(float), batch.column("w").to_numpy(zero_copy_only=False).astype(float)
        x = batch.column("x")
        values = x.flatten().to_numpy().reshape(len(key), -1)
        for k in np.unique(key):
            if k not in theta:
                continue
            own = key == k
            a = np.column_stack([np.ones(own.sum()), values[own]])
            p = 1 / (1 + np.exp(-np.clip(a @ theta[k], -40, 40)))
            g = a.T @ (w[own] * (p - y[own]))
            h = (a * np.maximum(w[own] * p * (1 - p), 1e-8)[:, None]).T @ a
            old = sums.setdefault(k, [np.zeros_like(g), np.zeros_like(h)])
            old[0] += g
            old[1] += h
    for k, (g, h) in sums.items():
        flat = np.concatenate([g, h[np.triu_indices(len(g))]])
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(flat)), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["key", "i", "v"])


def fit_logistic(rows: DataFrame, n_features: int, keys: list[str], prior: Prior = Prior()) -> dict[str, Fit]:
    """Newton steps for all keys together on rows (key string, x array<double>, y, w): MAP and Laplace covariance.

    From zero until the step is below tol * (1 + norm) or max_iter is reached. A key without rows gives the prior.
    """
    m = n_features + 1
    penalty = np.full(m, 1 / prior.sd**2)
    penalty[0] = 1 / prior.intercept_sd**2 if prior.intercept_sd else 0.0
    theta = {k: np.zeros(m) for k in keys}
    done: dict[str, Fit] = {}
    rows = rows.select(F.col("key").cast("string").alias("key"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    upper = np.triu_indices(m)
    for it in range(1, prior.max_iter + 1):
        now = {k: b for k, b in theta.items() if k not in done}
        if not now:
            break
        part = rows.mapInArrow(_step(now), "key string, i int, v double")
        sums = {k: np.zeros(m + len(upper[0])) for k in now}
        for r in part.groupBy("key", "i").agg(F.sum("v").alias("v")).collect():  # (p + 1)(p + 4) / 2 numbers a fit
            sums[r["key"]][r["i"]] = r["v"]
        for k, s in sums.items():
            g = s[:m] + penalty * theta[k]
            h = np.zeros((m, m))
            h[upper] = s[m:]
            h = h + h.T - np.diag(np.diag(h)) + np.diag(penalty) + prior.jitter * np.eye(m)
            step = np.linalg.solve(h, g)
            theta[k] = theta[k] - step
            small = np.linalg.norm(step) < prior.tol * (1 + np.linalg.norm(theta[k]))
            if small or it == prior.max_iter:
                done[k] = Fit(theta[k], np.linalg.inv(h), it, bool(small), float(np.linalg.norm(g)))
    return done


def _step(now: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, now)

    return run


def draws(fit: Fit, n: int, seed: int) -> np.ndarray:
    """n draws from the posterior, by Cholesky with as much jitter as it needs."""
    z = np.random.default_rng(seed).standard_normal((n, len(fit.b)))
    for jitter in (0.0, 1e-10, 1e-8, 1e-6, 1e-4):
        try:
            return fit.b + z @ np.linalg.cholesky(fit.cov + jitter * np.eye(len(fit.b))).T
        except np.linalg.LinAlgError:
            continue
    return fit.b + z * np.sqrt(np.maximum(np.diag(fit.cov), 0))


#: Gauss-Hermite nodes and weights for a standard normal, by numpy's rule.
NODES, WEIGHTS = np.polynomial.hermite_e.hermegauss(20)
WEIGHTS = WEIGHTS / WEIGHTS.sum()


#: Standard deviations to either side of the mean that hold 95 % of a normal distribution.
INTERVAL = 1.959963984540054


def linear(names: list[str], b: np.ndarray) -> Column:
    """Intercept plus the weighted sum of columns."""
    return sum((F.col(c) * float(w) for c, w in zip(names, b[1:], strict=True)), F.lit(float(b[0])))


def quadratic(names: list[str], cov: np.ndarray) -> Column:
    """x' C x with a leading 1 in x."""
    one = [F.lit(1.0), *[F.col(c) for c in names]]
    terms = [one[i] * one[j] * float(cov[i, j] * (1 if i == j else 2)) for i in range(len(one)) for j in range(i, len(one))]
    return sum(terms[1:], terms[0])


def score_gaussian(df: DataFrame, names: list[str], b: np.ndarray, cov: np.ndarray) -> DataFrame:
    """df with p, p_std, ci_lo, ci_hi and entropy of the posterior predictive.

    Under normal draws the logit of a row is normal, so its mean and variance give all of them: quadrature for the
    moments of p, the ends of the interval through the sigmoid. No draw is made and no Python runs.
    """
    df = df.withColumn("_mu", linear(names, b)).withColumn("_s", F.sqrt(F.greatest(quadratic(names, cov), F.lit(0.0))))
    at = [rules.sigmoid(F.col("_mu") + F.col("_s") * float(x)) for x in NODES]
    mean = sum((a * float(w) for a, w in zip(at[1:], WEIGHTS[1:], strict=True)), at[0] * float(WEIGHTS[0]))
    square = sum((a * a * float(w) for a, w in zip(at[1:], WEIGHTS[1:], strict=True)), at[0] * at[0] * float(WEIGHTS[0]))
    df = df.withColumn("p", mean).withColumn("p_std", F.sqrt(F.greatest(square - F.col("p") * F.col("p"), F.lit(0.0))))
    low, high = (rules.sigmoid(F.col("_mu") + z * F.col("_s")) for z in (-INTERVAL, INTERVAL))
    return df.withColumns({"ci_lo": low, "ci_hi": high, "entropy": rules.entropy(F.col("p"))}).drop("_mu", "_s")


def agreement(mu: Column, s: Column, positive: Column) -> Column:
    """Share of the posterior on the given side of 0.5."""
    z = F.when(s > 0, mu / s).otherwise(F.signum(mu) * 40.0)
    return stats.normal_cdf(F.when(positive, z).otherwise(-z))


def score_draws(df: DataFrame, names: list[str], sample: np.ndarray) -> DataFrame:
    """The same by Monte Carlo: blocks of rows times all draws, reduced in the task."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("p", "p_std", "ci_lo", "ci_hi", "entropy")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.column_stack([np.ones(part.num_rows), *[part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]])
                p = 1 / (1 + np.exp(-np.clip(x @ sample.T, -40, 40)))
                m = p.mean(axis=1)
                q = np.clip(m, 1e-12, 1 - 1e-12)
                low, high = np.quantile(p, [0.025, 0.975], axis=1, method="hazen")
                new = [m, p.std(axis=1, ddof=1), low, high, -(q * np.log(q) + (1 - q) * np.log(1 - q))]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, new)], names=schema.names)

    return df.mapInArrow(run, schema)


def coefficient_summary(spark, names: list[str], fit: Fit) -> DataFrame:
    """(feature, mean, sd, ci_lo, ci_hi, abs_z, p_positive, direction) of the posterior; the interval holds 95 % of it."""
    rows = [(n, float(fit.b[i + 1]), float(np.sqrt(max(fit.cov[i + 1, i + 1], 0)))) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "feature string, mean double, sd double")
    z = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0)
    df = df.withColumns({"ci_lo": F.col("mean") - INTERVAL * F.col("sd"), "ci_hi": F.col("mean") + INTERVAL * F.col("sd")})
    df = df.withColumn("abs_z", F.abs(z)).withColumn("p_positive", stats.normal_cdf(z))
    return df.withColumn("direction", rules.direction(F.col("p_positive")))


def score_fits(rows: DataFrame, fits: dict[str, Fit], columns: list[str]) -> DataFrame:
    """(key, columns, p, p_std, ci_lo, ci_hi, entropy, attr_unc) of rows (key, x array, columns) by the fit of their key; rows without a fit are left out.

    attr_unc: the standard deviation of p(1-p) b_j x_j over the posterior, averaged over features. Given the logit a
    coefficient is normal, so one sum over the logit's quadrature is left.
    """
    models = {k: (f.b, f.cov) for k, f in fits.items()}
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.array(batch.column("key").to_pylist(), object)
            for k in np.unique(key):
                if k not in models:
                    continue
                own = pa.array(np.flatnonzero(key == k))
                b, cov = models[k]
                x = np.column_stack([np.ones(len(own)), batch.column("x").take(own).flatten().to_numpy().reshape(len(own), -1)])
                new = predictive(x, b, cov)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(own), *[batch.column(c).take(own) for c in columns], *new], names=["key", *columns, *SCORES])

    return rows.select(*dict.fromkeys(["key", "x", *columns])).mapInArrow(run, f"key string, {kinds}, {', '.join(f'{c} double' for c in SCORES)}")


def predictive(x: np.ndarray, b: np.ndarray, cov: np.ndarray) -> list[pa.Array]:
    """The columns SCORES for rows x (with a leading 1) under a normal posterior, by quadrature over the logit."""
    mu, s = x @ b, np.sqrt(np.maximum(((x @ cov) * x).sum(axis=1), 0))
    p = 1 / (1 + np.exp(-np.clip(mu[:, None] + s[:, None] * NODES, -40, 40)))
    m = p @ WEIGHTS
    sd = np.sqrt(np.maximum((p * p) @ WEIGHTS - m * m, 0))
    low, high = (1 / (1 + np.exp(-np.clip(mu + z * s, -40, 40))) for z in (-INTERVAL, INTERVAL))
    q = np.clip(m, 1e-12, 1 - 1e-12)
    return list(map(pa.array, (m, sd, low, high, -(q * np.log(q) + (1 - q) * np.log(1 - q)), _attribution_spread(x, p, s, b, cov))))


SCORES = ["p", "p_std", "ci_lo", "ci_hi", "entropy", "attr_unc"]


def _attribution_spread(x: np.ndarray, p: np.ndarray, s: np.ndarray, b: np.ndarray, cov: np.ndarray) -> np.ndarray:
    share = (x @ cov)[:, 1:] / np.maximum(s, 1e-9)[:, None]  # how each coefficient moves with the logit
    rest = np.maximum(np.diag(cov)[1:] - share**2, 0)
    d = p * (1 - p) * 1.0
    at = b[1:, None] + share[:, :, None] * NODES
    first = (d[:, None, :] * at) @ WEIGHTS
    second = ((d * d)[:, None, :] * (at**2 + rest[:, :, None])) @ WEIGHTS
    return (np.abs(x[:, 1:]) * np.sqrt(np.maximum(second - first**2, 0))).mean(axis=1)


def rank_coefficients(summary: DataFrame, stability: DataFrame | None = None) -> DataFrame:
    """Coefficients by falling stability (where given), then abs_z, then name."""
    if stability is None:
        return summary.orderBy(F.col("abs_z").desc_nulls_last(), "feature")
    return summary.join(stability, "feature", "left").orderBy(F.col("stability").desc_nulls_last(), F.col("abs_z").desc_nulls_last(), "feature")
