"""Benchmark of classifiers over repeats, folds, preprocessing and feature sets; a failed run is a row that says so."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batch, bayes, forest, metrics
from ..sources import tables
from ..sources.shared import checkpointed
from .validation import TRANSFORMS, Design, Wide, add_splits, chosen_features, splits_of, wide_rows

#: The ridge's strength, the margin's, and how near to 0 and 1 a probability may come.
RIDGE, MARGIN, CLIP = 1e-4, 1.0, 1e-6
MODELS = ("bayes", "ridge", "discriminant", "margin", "forest")
SHOWN = ["accuracy", "balanced_accuracy", "macro_f1", "auc", "brier", "nll", "recall0", "recall1", "precision0", "precision1", "p_std_mean"]


def _linear(w: Wide, splits: list[batch.Split], specs: list[batch.Spec], models: list[str]) -> tuple[list[batch.Spec], list[bayes.Fit]]:
    """Specs as they are scored, and their fits: Newton steps of the Bayesian, ridge and margin models together, one pass for all discriminants, then curves for the margins."""
    found = [w.moments[s.name] for s in splits]
    out: list[bayes.Fit | None] = [None] * len(specs)
    scored = list(specs)
    of = lambda *kinds: [i for i, m in enumerate(models) if m in kinds]
    steps = of("bayes", "ridge", "margin")
    for i, fit in zip(steps, batch.fit_many(w.rows, splits, [specs[i] for i in steps], found, bayes.Prior(max_iter=50)) if steps else [], strict=True):
        out[i] = fit
    if plain := of("discriminant"):
        for i, fit in zip(plain, batch.discriminants(w.rows, splits, [specs[i] for i in plain], found), strict=True):
            out[i] = fit
    if margins := of("margin"):
        curves = [replace(specs[i], loss="logistic", precision=1e-3, intercept_precision=0.0, over=out[i].b) for i in margins]
        for i, spec, fit in zip(margins, curves, batch.fit_many(w.rows, splits, curves, found, bayes.Prior(max_iter=50)), strict=True):
            scored[i], out[i] = spec, fit
    return scored, out


def _spec(model: str, name: str, split: int, columns: tuple[int, ...], n: float) -> batch.Spec:
    kinds = {
        "bayes": {"precision": 4.0, "posterior": True},
        "ridge": {"precision": RIDGE * n},
        "margin": {"loss": "hinge", "precision": MARGIN},
        "discriminant": {},
        "forest": {},
    }
    return batch.Spec(f"{name}|{model}", split, columns, **kinds[model])


def _runs(w: Wide, preprocessing: list[str], sets: dict[str, Design], models: list[str], trees: int) -> DataFrame:
    """One row for each repeat, fold, preprocessing, feature set and model over the rows of w."""
    spark = w.rows.sparkSession
    designs = {(p, s): replace(d, log=TRANSFORMS[p][0], winsor=TRANSFORMS[p][1], kinds=TRANSFORMS[p][2]) for p in preprocessing for s, d in sets.items()}
    add_splits(w, list(designs.values()))
    splits = list(w.splits.values())
    place = {s.name: i for i, s in enumerate(splits)}
    specs, kinds, tags = [], [], []
    for (p, set_), d in designs.items():
        whole = {(w.deals[s.deal][1], s.train): s for (t, _, _, _), s in w.splits.items() if t == d.transform}
        good = {s.name for _, s in splits_of(w, d, "")}
        for (seed, fold), s in whole.items():
            n = w.moments[s.name].n
            columns = chosen_features(w, s, d) if s.name in good else ()
            for m in models:
                about = (seed, fold, p, set_, m, len(columns), int(n.sum()), ",".join(w.names[i] for i in columns))
                if columns:
                    tags.append((len(specs), *about, None))
                    specs.append(_spec(m, f"{p}|{set_}|{seed}|{fold}", place[s.name], columns, float(n.sum())))
                    kinds.append(m)
                else:
                    tags.append((None, *about, "FAILED: training rows of one class" if s.name not in good else "FAILED: no features"))
    lines = [i for i, m in enumerate(kinds) if m != "forest"]
    woods = [i for i, m in enumerate(kinds) if m == "forest"]
    scored = None
    if lines:
        own, fits = _linear(w, splits, [specs[i] for i in lines], [kinds[i] for i in lines])
        scored = _named(batch.score_many(w.rows, splits, own, fits, held_out=None).select("spec", "row_id", "y", "held_out", "p", "p_std"), lines)
    if woods:
        own = [specs[i] for i in woods]
        grown, whys = forest.fit_forests(w.rows, splits, own, [w.moments[s.name] for s in splits], trees)
        found = _named(forest.score_forests(w.rows, splits, own, grown), woods).withColumn("p_std", F.lit(None).cast("double"))
        scored = found if scored is None else scored.unionByName(found)
        reason = {i: f"FAILED: {why}" for i, why in zip(woods, whys, strict=True) if why}
        tags = [(*t[:-1], reason[t[0]]) if t[0] in reason else t for t in tags]
    of = spark.createDataFrame(tags, "spec int, seed int, fold int, preprocessing string, feature_set string, model string, n_features int, n_train int, features string, failed string")
    if scored is None:
        scored = spark.createDataFrame([], "spec int, row_id int, y int, held_out boolean, p double, p_std double")
    scored = checkpointed(scored.withColumn("p", F.least(F.greatest("p", F.lit(CLIP)), F.lit(1 - CLIP))))
    cut = metrics.best_threshold(scored.filter("NOT held_out"), ["spec"])
    test = scored.filter("held_out").join(F.broadcast(checkpointed(cut)), "spec")  # a number a fit
    out = metrics.evaluate(test, ["spec"], F.col("threshold"))
    sizes = test.groupBy("spec").agg(F.first("threshold").alias("threshold"), F.count("*").cast("int").alias("n_test"), F.sum("y").cast("int").alias("n_test_pos"))
    out = of.join(sizes.join(out, "spec"), "spec", "left").withColumn("status", F.coalesce("failed", F.lit("OK")))
    return out.select("seed", "fold", "preprocessing", "feature_set", "model", "n_features", "features", "n_train", "n_test", "n_test_pos", "threshold", *SHOWN, "status")


def _named(scored: DataFrame, places: list[int]) -> DataFrame:
    """Scores whose spec is the place in a larger list."""
    at = F.array(*map(F.lit, places))
    return scored.withColumn("spec", F.element_at(at, F.col("spec") + 1)) if places != list(range(len(places))) else scored


def benchmark(
    df: DataFrame, record: str, subject: str, names: list[str], preprocessing: list[str], top_ks: list[int | None], kinds: list[str], seeds: tuple[int, ...] = (42,), k: int = 3, fixed: tuple[str, ...] | None = None, trees: int = 100, path: str | None = None
) -> DataFrame:
    """One row for each repeat, fold, preprocessing, feature set and model: selected features, threshold, sizes, metrics and status.

    top_ks: how many of the best features by effect in the training rows, None for all; fixed: names of one more set. kinds: of MODELS. The threshold is the one
    with the best balanced accuracy among the training predictions, metrics are those of the held-out rows at it. All fits of a job take their
    passes together; a fit that can't be made is a row whose status says why. With path, each repeat is written there when it is done, and repeats that
    are there already aren't run again.
    """
    sets = {f"top{t}" if t is not None else "all": Design(seeds=seeds, k=k, top_k=t) for t in top_ks}
    if fixed is not None:
        sets[f"fixed{len(fixed)}"] = Design(seeds=seeds, k=k, top_k=None, fixed=fixed)
    w = wide_rows(df, record, subject, names, list(sets.values()))
    for why in w.failed.values():
        raise ValueError(why)
    if path is None:
        return _runs(w, preprocessing, sets, kinds, trees)
    spark = df.sparkSession
    try:
        done = {r["seed"] for r in spark.read.parquet(path).select("seed").distinct().collect()}  # a number a repeat
    except AnalysisException:  # nothing is there yet
        done = set()
    for seed in [s for s in seeds if s not in done]:
        own = replace(w, rows=w.rows, deals=w.deals, splits={}, moments={}, auc={})
        own.deals = [(n, s) if s == seed else (0, s) for n, s in w.deals]  # the other repeats' folds have no design
        tables.write(_runs(own, preprocessing, {c: replace(d, seeds=(seed,)) for c, d in sets.items()}, kinds, trees), path, append=True)
    return spark.read.parquet(path)


def summary(runs: DataFrame) -> DataFrame:
    """Mean and spread of each metric by preprocessing, feature set and model; failed runs don't count."""
    return metrics.summarize(runs, ["preprocessing", "feature_set", "model"], SHOWN, "status")
