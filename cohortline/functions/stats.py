"""Statistics whose definitions differ from Spark's own, as aggregates that scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of up to so many values are sorted whole; larger ones only near the percentile.
WHOLE = 10_000


def finite(c: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def hazen_of_sorted(a: Column, p: float, below: Column | None = None, n: Column | None = None) -> Column:
    """Hazen's percentile (position n * p + 0.5, linear) of a sorted array, which may begin after `below` of all n values."""
    n = F.size(a) if n is None else n
    below = F.lit(0) if below is None else below
    r = F.least(F.greatest(n * p + 0.5, F.lit(1.0)), n.cast("double"))
    k = F.floor(r)
    at = lambda i: F.try_element_at(a, F.greatest(i - below, F.lit(1)).cast("int"))
    x, y = at(k), at(F.least(k + 1, n))
    return F.when(n > 0, x + (y - x) * (r - k))


def counted_percentile(cells: Column, n: Column, p: float) -> Column:
    """Hazen's percentile of n values, given as a sorted array of (v, c), each value with its number."""
    r = F.least(F.greatest(n * p + 0.5, F.lit(1.0)), n.cast("double"))
    k = F.floor(r)
    none = F.lit(None).cast("double")

    def take(a: Column, e: Column) -> Column:
        seen = a["seen"] + e["c"]
        first = lambda c, at: F.coalesce(a[c], F.when(seen >= at, e["v"])).alias(c)
        return F.struct(seen.alias("seen"), first("x", k), first("y", F.least(k + 1, n)))

    at = F.aggregate(cells, F.struct(F.lit(0).cast("long").alias("seen"), none.alias("x"), none.alias("y")), take)
    return F.when(n > 0, at["x"] + (at["y"] - at["x"]) * (r - k))


def counted_cells(rows: DataFrame, keys: list[str], v: str, slots: list[tuple[str, str]], counts: list[Column]) -> DataFrame:
    """(keys, cells): a sorted array of (v, counts) of each key. Rows within the slots (columns of their lower and upper ends) are counted by
    value, so ties are one cell; all others in one cell for each gap between slots, under their smallest value. Nothing is copied."""
    x = F.col(v)
    inside = F.lit(False)
    for low, high in slots:
        inside = inside | F.coalesce((x >= F.col(low)) & (x <= F.col(high)), F.lit(False))
    gap = sum((F.coalesce((F.col(low) > x).cast("int"), F.lit(0)) for low, _ in slots), F.lit(0))
    cells = rows.groupBy(*keys, F.when(~inside, gap).alias("_gap"), F.when(inside, x).alias("_at")).agg(F.min(x).alias("v"), *counts)
    names = [c for c in cells.columns if c not in {*keys, "_gap", "_at"}]
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("cells"))


def hazen_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], whole: int = WHOLE) -> DataFrame:
    """Exact Hazen percentiles of the non-null values of each key, named by ps.

    A first pass finds bounds about each percentile (of groups over `whole` values; smaller ones
    are taken whole), a second counts the values between them, each different value once, and what lies outside. So no task
    holds more than a thousandth of the different values of a large group, however many are alike. Keys without any value give no row.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    eps = 0.0005
    near = lambda p: F.percentile_approx("_v", min(max(p, 0.0), 1.0), 20_000)
    bounds = [F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    bounds += [x for k, p in ps.items() for x in (near(p - eps).alias(f"_lo_{k}"), near(p + eps).alias(f"_hi_{k}"))]
    limits = rows.groupBy(*keys).agg(*bounds)
    small = F.col("_n") <= whole
    for k, p in ps.items():
        limits = limits.withColumn(f"_lo_{k}", F.when(small | (F.lit(p) <= eps), F.col("_min")).otherwise(F.col(f"_lo_{k}")))
        limits = limits.withColumn(f"_hi_{k}", F.when(small | (F.lit(p) >= 1 - eps), F.col("_max")).otherwise(F.col(f"_hi_{k}")))
    joined = rows.join(limits, keys) if keys else rows.crossJoin(F.broadcast(limits))
    out = counted_cells(joined, keys, "_v", [(f"_lo_{k}", f"_hi_{k}") for k in ps], [F.count("*").alias("c")])
    n = F.aggregate("cells", F.lit(0).cast("long"), lambda a, e: a + e["c"])
    out = out.withColumn("_n", n).filter("_n > 0")
    return out.select(*keys, *[counted_percentile(F.col("cells"), F.col("_n"), p).alias(k) for k, p in ps.items()])


def sample_std(c) -> Column:
    """Sample standard deviation; 0 for a single value."""
    return F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))


#: Coefficients of the rational approximation of the normal distribution (error below 1e-7).
NORMAL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a rational approximation."""
    x = F.abs(z)
    t = 1 / (1 + NORMAL[0] * x)
    poly = t * (NORMAL[1] + t * (NORMAL[2] + t * (NORMAL[3] + t * (NORMAL[4] + t * NORMAL[5]))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(z: str) -> str:
    """The same for DuckDB."""
    a, b, c, d, e, f = NORMAL
    t = f"(1 / (1 + {a} * abs({z})))"
    tail = f"(exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * ({t} * ({b} + {t} * ({c} + {t} * ({d} + {t} * ({e} + {t} * {f}))))))"
    return f"(CASE WHEN ({z}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def hash_order(seed: int, c: Column) -> Column:
    """A value by whose order rows are in a random order that the seed fixes."""
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))
