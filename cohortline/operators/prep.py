"""Preprocessing whose parameters come from training folds only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, stats
from ..sources.shared import checkpointed


def training_sets(long: DataFrame, k: int) -> DataFrame:
    """Each row (seed, fold, ...) once for every fold that it is trained on: `train` is the fold held out."""
    other = F.explode(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda f: f != F.col("fold")))
    return long.withColumn("train", other)


#: Steps of the grid of approximate quantiles that bounds an order statistic, and its accuracy.
GRID, NEAR = 1000, 20_000
#: Percentiles that are wanted of the training values, with missing ones filled by their median for the limits.
MEDIAN, LOW, HIGH = 0.5, 0.01, 0.99
#: A deviation up to this is that of a constant, left by rounding.
SMALLEST = 1e-12


def _ranks(n: int, m: int, winsor: bool) -> list[int]:
    """Ranks among n values that the median and, with m medians more, both limits may need."""
    out = []
    for p, more in ((MEDIAN, 0), *(((LOW, m), (HIGH, m)) if winsor else ())):
        k = int(np.floor(min(max((n + more) * p + 0.5, 1), max(n + more, 1))))
        out += [k, k + 1, k - more, k + 1 - more]
    return [k for k in dict.fromkeys(out) if 1 <= k <= n]


def _bounds(rows: pa.Table, keys: list[str], k: int, winsor: bool, whole: int) -> pa.Table:
    """One row for the folds of a key: the slots in which its order statistics lie, whichever fold is left out.

    A quantile of several folds together lies between the smallest and the largest of theirs.
    """
    n, m = np.zeros(k + 1, np.int64), np.zeros(k + 1, np.int64)
    grids = {}
    for r in rows.select(["fold", "_n", "_m", "_min", "_max", "_grid"]).to_pylist():
        if not 1 <= r["fold"] <= k:
            raise ValueError(f"fold {r['fold']} of {k}")
        n[r["fold"]], m[r["fold"]] = r["_n"], r["_m"]
        if r["_n"]:
            grids[r["fold"]] = (r["_min"], r["_max"], r["_grid"])
    low, high = [], []
    if grids and n.sum() <= whole:
        low, high = [min(g[0] for g in grids.values())], [max(g[1] for g in grids.values())]
    elif grids:
        for t in range(1, k + 1):
            others = [g for f, g in grids.items() if f != t]
            size = int(n.sum() - n[t])
            for rank in _ranks(size, int(m.sum() - m[t]), winsor) if others else []:
                at = rank / size * GRID
                down, up = int(np.floor(at)) - 2, int(np.ceil(at)) + 2
                low.append(min(g[2][down] if down > 0 else g[0] for g in others))
                high.append(max(g[2][up] if up < GRID else g[1] for g in others))
    order = np.argsort(low, kind="stable")
    slots: list[list[float]] = []
    for i in order:  # slots that meet are one
        if slots and low[i] <= slots[-1][1]:
            slots[-1][1] = max(slots[-1][1], high[i])
        else:
            slots.append([low[i], high[i]])
    return pa.table({**{c: rows[c][:1] for c in keys}, "_missing": pa.array([m[1:].tolist()], pa.list_(pa.int64())), "_mins": pa.array([[grids[f][0] if f in grids else None for f in range(1, k + 1)]], pa.list_(pa.float64())), "_slots": pa.array([[{"low": a, "high": b} for a, b in slots]], pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())])))})


def _statistics(k: int, winsor: bool, kinds: bool):
    """(train, med, least, low, high) of each key from the counts of its cells, in every fold: a training set is the whole less its fold."""

    def transformed(v: float, kind: str, least: float | None) -> float:
        if kind == "atanh":
            return float(np.arctanh(min(max(v, -0.999), 0.999)))
        return float(np.log(max(v, 0.0) + rules.EPS)) if kind == "log" and least is not None and least >= 0 else v

    def of_key(r: dict) -> list[tuple]:
        cells = r["cells"] or []
        v = np.array([c["v"] for c in cells], float)
        counts = np.array([[c[f"c{f}"] for f in range(1, k + 1)] for c in cells], np.int64).reshape(len(cells), k)
        missing = np.array(r["_missing"], np.int64)
        kind = rules.transform_kind(r["feature"]) if kinds else "none"
        out = []
        for t in range(1, k + 1):
            c = counts.sum(axis=1) - counts[:, t - 1]
            n, m = int(c.sum()), int(missing.sum() - missing[t - 1])
            if not n + m:
                continue
            upto = np.cumsum(c)
            least = min((x for f, x in enumerate(r["_mins"], 1) if f != t and x is not None), default=None)
            at = lambda rank: v[np.searchsorted(upto, rank)] if 1 <= rank <= n else np.inf if rank > n else -np.inf  # noqa: B023, E731

            def percentile(p: float, more: int, fill: float, name: str) -> float | None:
                size = n + more  # noqa: B023
                if not size:
                    return None
                place = min(max(size * p + 0.5, 1), size)
                low = int(np.floor(place))
                own = [transformed(min(max(fill, at(x - more)), at(x)) if more else at(x), name, least) for x in (low, min(low + 1, size))]  # noqa: B023
                return float(own[0] + (own[1] - own[0]) * (place - low))

            med = percentile(MEDIAN, 0, 0.0, "none") if n else 0.0
            low, high = (percentile(p, m, med, kind) for p in (LOW, HIGH)) if winsor else (None, None)
            out.append((t, med, least, low, high))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of_key(r) for r in batch.select(["feature", "cells", "_missing", "_mins"]).to_pylist()]
            names = ["train", "med", "least", "low", "high"]
            each = pa.struct([(c, pa.int32() if c == "train" else pa.float64()) for c in names])
            sets = pa.array([[dict(zip(names, x, strict=True)) for x in row] for row in found], pa.list_(each))
            others = [i for i, c in enumerate(batch.schema.names) if c not in ("cells", "_missing", "_mins")]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in others], sets], names=[*[batch.schema.names[i] for i in others], "sets"])

    return run


def fold_parameters(long: DataFrame, k: int, log: bool = False, winsor: bool = False, kinds: bool = False, by: list[str] | None = None, whole: int = stats.WHOLE) -> DataFrame:
    """(by, seed, train, feature, med, low, high, mean, sd, least) of the training rows of each fold.

    long: (by, seed, fold from 1 to k, feature, value). Order of the steps: median, then winsor by the 1st and 99th
    percentile and signed log (log), or first log or atanh by the feature's name, then winsor (kinds). sd of a constant is 1.

    No row is copied for the sets that it trains: values are counted by fold within narrow bounds of the percentiles (of keys with over
    `whole` values), each different value once, and the counts of a training set are those of all folds less its own. Means and
    deviations of all sets are conditional aggregates of one pass.
    """
    keys = [*(by or []), "seed", "feature"]
    rows = long.select(*keys, "fold", stats.finite(F.col("value").cast("double")).alias("value"))
    grid = F.percentile_approx("value", [i / GRID for i in range(GRID + 1)], NEAR)
    per = rows.groupBy(*keys, "fold").agg(F.count("value").alias("_n"), F.count_if(F.col("value").isNull()).alias("_m"), F.min("value").alias("_min"), F.max("value").alias("_max"), grid.alias("_grid"))
    of_keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    limits = per.groupBy(*keys).applyInArrow(lambda t: _bounds(t, keys, k, winsor, whole), f"{of_keys}, _missing array<long>, _mins array<double>, _slots array<struct<low double, high double>>")
    limits = checkpointed(limits)  # a row for each feature and repeat
    most = limits.agg(F.max(F.size("_slots")).alias("m")).head()["m"] or 0
    slots = [(f"_low{i}", f"_high{i}") for i in range(most)]
    named = limits.select(*keys, *[F.get("_slots", F.lit(i))[c].alias(x) for i, s in enumerate(slots) for c, x in zip(("low", "high"), s, strict=True)])
    counts = [F.count_if(F.col("fold") == f).alias(f"c{f}") for f in range(1, k + 1)]
    cells = stats.counted_cells(rows.filter("value IS NOT NULL").join(named, keys), keys, "value", slots, counts)
    counted = limits.select(*keys, "_missing", "_mins").join(cells, keys, "left")
    sets = counted.mapInArrow(_statistics(k, winsor, kinds), f"{of_keys}, sets array<struct<train: int, med: double, least: double, low: double, high: double>>")
    sets = checkpointed(sets)
    of = F.map_from_entries(F.transform("sets", lambda s: F.struct(s["train"].alias("key"), s.alias("value"))))
    joined = rows.join(sets.select(*keys, of.alias("_of")), keys)
    moments = []
    for t in range(1, k + 1):
        own = F.try_element_at("_of", F.lit(t))
        x = _prepared_value(F.col("feature"), F.col("value"), own, log, kinds)
        mine = F.when(F.col("fold") != t, x)
        moments.append(F.struct(F.lit(t).alias("train"), F.avg(mine).alias("mean"), stats.sample_std(mine).alias("sd")).alias(f"_s{t}"))
    found = joined.groupBy(*keys).agg(*moments).select(*keys, F.inline(F.array(*[f"_s{t}" for t in range(1, k + 1)])))
    out = sets.select(*keys, F.inline("sets")).join(found, [*keys, "train"])
    return out.withColumn("sd", F.when(F.col("sd") > SMALLEST, F.col("sd")).otherwise(1.0))


def _prepared_value(feature: Column, value: Column, own: Column, log: bool, kinds: bool) -> Column:
    """A value after all steps before the scaling, by the struct of parameters of a training set."""
    x = F.coalesce(value, own["med"])
    x = by_kind(feature, x, own["least"]) if kinds else x
    x = F.when(own["low"].isNotNull(), rules.clamp(x, own["low"], own["high"])).otherwise(x)
    return rules.signed_log(x) if log and not kinds else x


def by_kind(feature, value, least):
    """log or atanh by the name of the feature."""
    log, tanh = feature.rlike("|".join(rules.LOG_PARTS)), feature.rlike("|".join(rules.ATANH_PARTS))
    return F.when(tanh, rules.log_or_atanh(value, "atanh")).when(log, rules.log_or_atanh(value, "log", least)).otherwise(value)


def apply_parameters(long: DataFrame, parameters: DataFrame, log: bool = False, kinds: bool = False) -> DataFrame:
    """Every row with every training set of its seed: train, x and whether the row is held out of it."""
    rows = long.withColumn("value", stats.finite(F.col("value"))).join(parameters, ["seed", "feature"])
    x = F.coalesce("value", "med")
    x = by_kind(F.col("feature"), x, F.col("least")) if kinds else x
    x = F.when(F.col("low").isNotNull(), rules.clamp(x, F.col("low"), F.col("high"))).otherwise(x)
    x = rules.signed_log(x) if log and not kinds else x
    held = F.col("fold") == F.col("train")
    return rows.withColumn("x", (x - F.col("mean")) / F.col("sd")).withColumn("held_out", held).drop("med", "low", "high", "mean", "sd", "least")


def class_weights(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """(keys, y, weight): inverse class frequency, n / (2 * n of the class)."""
    per = df.groupBy(*keys, y).agg(F.count("*").alias("n_c"))
    whole = per.groupBy(*keys).agg(F.sum("n_c").alias("n"))
    joined = per.join(whole, keys) if keys else per.crossJoin(F.broadcast(whole))
    return joined.select(*keys, y, (F.col("n") / (2 * F.col("n_c"))).alias("weight"))
