"""Other classifiers of the benchmark: each takes (key, x array, y, w) and scores rows with p."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x"))


def ridge(train: DataFrame, test: DataFrame, strength: float = 1e-4) -> DataFrame:
    """Weighted logistic regression with a small ridge."""
    model = LogisticRegression(labelCol="y", weightCol="w", regParam=strength, standardization=False).fit(_vectors(train))
    return model.transform(_vectors(test)).withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p")


def forest(train: DataFrame, test: DataFrame, trees: int = 100, depth: int = 6, seed: int = 1) -> DataFrame:
    """Bagged trees."""
    model = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(_vectors(train))
    return model.transform(_vectors(test)).withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p")


def margin(train: DataFrame, test: DataFrame) -> DataFrame:
    """Linear margin classifier whose scores a logistic curve turns into probabilities."""
    svc = LinearSVC(labelCol="y", weightCol="w", maxIter=50, regParam=1e-3).fit(_vectors(train))
    raw = lambda d: svc.transform(_vectors(d)).withColumn("m", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")
    curve = LogisticRegression(labelCol="y", weightCol="w", featuresCol="mv").fit(raw(train).withColumn("mv", array_to_vector(F.array("m"))))
    out = curve.transform(raw(test).withColumn("mv", array_to_vector(F.array("m"))))
    return out.withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p")


def discriminant(train: DataFrame, test: DataFrame, n_features: int) -> DataFrame:
    """Linear discriminant: one pass sums weights, means and products of both classes, the score is an expression.

    The pooled covariance is inverted as a pseudo-inverse.
    """
    x = [F.get("x", F.lit(i)) for i in range(n_features)]
    one = lambda c, v: F.sum(F.when(F.col("y") == c, F.col("w") * v).otherwise(0.0))
    aggs = [one(c, F.lit(1.0)).alias(f"n{c}") for c in (0, 1)] + [one(c, x[i]).alias(f"s{c}_{i}") for c in (0, 1) for i in range(n_features)]
    aggs += [F.sum(F.col("w") * x[i] * x[j]).alias(f"p{i}_{j}") for i in range(n_features) for j in range(i, n_features)]
    r = train.agg(*aggs).head()
    n = [r["n0"] or 1e-12, r["n1"] or 1e-12]
    mean = [np.array([r[f"s{c}_{i}"] / n[c] for i in range(n_features)]) for c in (0, 1)]
    prod = np.zeros((n_features, n_features))
    for i in range(n_features):
        for j in range(i, n_features):
            prod[i, j] = prod[j, i] = r[f"p{i}_{j}"]
    cov = (prod - sum(n[c] * np.outer(mean[c], mean[c]) for c in (0, 1))) / sum(n)
    inverse = np.linalg.pinv(cov)
    b = inverse @ (mean[1] - mean[0])
    b0 = -0.5 * (mean[1] @ inverse @ mean[1] - mean[0] @ inverse @ mean[0]) + np.log(n[1] / n[0])
    z = sum((x[i] * float(b[i]) for i in range(n_features)), F.lit(float(b0)))
    return test.withColumn("p", rules.sigmoid(z))
