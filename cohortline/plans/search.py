"""Evolutionary search for compact feature subsets: every generation is one batched evaluation on Spark."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import batch, metrics
from ..sources.shared import checkpointed
from .validation import Design, Wide, add_splits, prior_precisions, splits_of, wide_rows


@dataclass(frozen=True)
class Settings:
    population: int = 24
    generations: int = 12
    children: int = 15
    elite: int = 3
    tournament: int = 3
    smallest: int = 4
    largest: int = 14
    seed: int = 7
    boost: float = 1.0
    diversity: float = 0.35


def evaluate_subsets(w: Wide, subsets: dict[str, list[str]], design: Design, redundancy: np.ndarray) -> DataFrame:
    """(individual, n_features, features, metrics, means of uncertainty, redundancy) of feature subsets by cross-validation, pooled over folds and repeats.

    All subsets and folds are fits of one job over the same rows; subsets of all sizes take their steps together. redundancy: absolute correlations of all pairs of features.
    """
    spark = w.rows.sparkSession
    place = {f: i for i, f in enumerate(w.names)}
    splits = list(w.splits.values())
    at = {s.name: i for i, s in enumerate(splits)}
    specs, own = [], []
    for i, fs in subsets.items():
        for _, s in splits_of(w, design, ""):
            specs.append(batch.Spec(i, at[s.name], tuple(sorted(place[f] for f in fs)), posterior=True, **prior_precisions(design.prior)))
            own.append((len(own), i))
    fits = batch.fit_many(w.rows, splits, specs, [w.moments[s.name] for s in splits], design.prior) if specs else []
    scored = batch.score_many(w.rows, splits, specs, fits).join(F.broadcast(spark.createDataFrame(own, "spec int, individual string")), "spec")  # a row a fit
    out = metrics.evaluate(checkpointed(scored.drop("spec", "held_out")), ["individual"])
    listed = [(i, len(fs), ",".join(sorted(fs)), mean_of_pairs(redundancy, [place[f] for f in fs])) for i, fs in subsets.items()]
    return spark.createDataFrame(listed, "individual string, n_features int, features string, redundancy double").join(out, "individual", "left")


def mean_of_pairs(r: np.ndarray, own: list[int]) -> float:
    """Mean of the entries of all pairs of places; 0 for fewer than two."""
    part = r[np.ix_(own, own)][np.triu_indices(len(own), 1)]
    return float(part.mean()) if len(part) else 0.0


def fitness(kind: str):
    """Fitness as a column: 'decline', 'maintain' or 'balanced'; a missing AUC counts as 0.5, under two features as minus infinity.

    The weights and scales are fixed values. A specialist pays for the uncertainty of the records of its own class only.
    """
    own_class = {"decline": "1", "maintain": "0"}.get(kind, "")
    r0, r1 = F.coalesce("recall0", F.lit(0.0)), F.coalesce("recall1", F.lit(0.0))
    auc, ba, f1 = F.coalesce("auc", F.lit(0.5)), F.coalesce("balanced_accuracy", F.lit(0.0)), F.coalesce("macro_f1", F.lit(0.0))
    if kind == "balanced":
        base = 0.35 * ba + 0.25 * auc + 0.20 * f1 + 0.20 * F.least(r0, r1)
    else:
        own, other = (r1, r0) if kind == "decline" else (r0, r1)
        base = 0.45 * own + 0.20 * auc + 0.20 * ba + 0.15 * f1 - 0.25 * F.greatest(0.45 - other, F.lit(0.0))
    within = lambda c, by: F.least(F.coalesce(F.col(c), F.lit(0.0)) / by, F.lit(2.0))
    cost = 0.08 * within(f"p_std_mean{own_class}", 0.15) + 0.07 * within(f"attr_unc_mean{own_class}", 0.05) + 0.025 * within("n_features", 14) + 0.035 * within("redundancy", 0.60)
    return F.when(F.col("n_features") < 2, float("-inf")).otherwise(base - cost)


def rank_candidates(results: DataFrame, n: int) -> DataFrame:
    """The best row of each subset by fitness, balanced accuracy, AUC, fewer features and the name; ranked, the first n."""
    order = [F.col("fitness").desc_nulls_last(), F.col("balanced_accuracy").desc_nulls_last(), F.col("auc").desc_nulls_last(), F.col("n_features"), F.col("individual")]
    best = results.withColumn("_r", F.row_number().over(Window.partitionBy("features").orderBy(*order))).filter("_r = 1").drop("_r")
    return best.orderBy(*order).limit(n)


def generation_log(results: DataFrame) -> DataFrame:
    """(phase, generation): best, mean and spread of the fitness, and the best row's subset and metrics."""
    more = [c for c in ("n_features", "balanced_accuracy", "recall0", "recall1", "auc") if c in results.columns]
    of_best = lambda c: F.max_by(c, F.struct("fitness", "individual")).alias(f"best_{c}")
    return results.groupBy("phase", "generation").agg(F.max("fitness").alias("best"), F.avg("fitness").alias("mean"), F.stddev_samp("fitness").alias("std"), of_best("features"), *map(of_best, more))


def elite_frequency(results: DataFrame, elite: int) -> DataFrame:
    """How often each feature is among the best individuals of each phase."""
    order = [F.col("fitness").desc_nulls_last(), "generation", "individual"]
    salted = results.withColumn("_s", F.pmod(F.xxhash64("individual"), F.lit(64)))  # first the best of each part of a phase
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("phase", "_s").orderBy(*order))).filter(F.col("_r") <= elite)
    top = few.withColumn("_r", F.row_number().over(Window.partitionBy("phase").orderBy(*order))).filter(F.col("_r") <= elite)
    return top.select("phase", F.explode(F.split("features", ",")).alias("feature")).groupBy("phase", "feature").agg((F.count("*") / elite).alias("share"))


def boosted(guide: dict[str, dict[str, float]], elites: dict[str, list[list[str]]], boost: float = 1.0) -> dict[str, dict[str, float]]:
    """The guide (mode -> feature -> score) after the specialists: scores rise by how often the best of a phase have the feature, then are scaled to [0, 1]."""
    share = lambda phase, f: sum(f in e for e in elites[phase]) / max(len(elites[phase]), 1)
    out = {}
    for mode, scores in guide.items():
        more = {f: share("decline", f) + share("maintain", f) if mode == "balanced" else share(mode, f) for f in scores}
        raw = {f: v + boost * (0.5 if mode == "balanced" else 1.0) * more[f] for f, v in scores.items()}
        low, high = min(raw.values()), max(raw.values())
        out[mode] = {f: (v - low) / (high - low) if high > low else 0.0 for f, v in raw.items()}
    return out


def _child(a: list[str], b: list[str], names: list[str], guide: dict[str, float], groups: dict[str, str], s: Settings, rng: random.Random) -> list[str]:
    """Features of both parents, half of those of one, and a change or two by the guide; features of groups the child lacks weigh more."""
    child = set(a) & set(b) | {f for f in sorted(set(a) ^ set(b)) if rng.random() < 0.5}
    weight = {f: (0.05 + max(guide.get(f, 0.0), 0.0)) * (1.0 if groups.get(f) in {groups.get(c) for c in child} else 1.0 + s.diversity) for f in names}
    if rng.random() < 0.6:
        rest = [f for f in names if f not in child]
        child |= set(rng.choices(rest, [weight[f] for f in rest])) if rest else set()
    if len(child) > s.smallest and rng.random() < 0.4:
        child.remove(rng.choice(sorted(child)))
    while len(child) < s.smallest:
        child.add(rng.choices(names, [weight[f] for f in names])[0])
    while len(child) > s.largest:
        child.remove(rng.choice(sorted(child)))
    return sorted(child)


@dataclass
class _Population:
    """A phase of the search: its own random numbers, who is alive, and what was best so far."""

    phase: str
    rng: random.Random
    alive: list[list[str]]
    seen: list[tuple[float, str, list[str]]]

    def best(self, n: int) -> list[list[str]]:
        return [fs for _, _, fs in sorted(self.seen, key=lambda x: x[:2])[:n]]


def search(df: DataFrame, record: str, subject: str, names: list[str], guide: dict[str, dict[str, float]], s: Settings, design: Design, groups: dict[str, str] | None = None) -> DataFrame:
    """Results of all individuals (phase, generation, individual, metrics, fitness, features).

    guide: scores of the features for each of 'decline', 'maintain' and 'balanced'. Two specialist populations evolve, each by its own
    scores; the guide then rises by what their best have, and a third population grows from pairs of one best of each. groups:
    the group of each feature. The driver holds the subsets (some dozens of names). Rows, folds and correlations are made once for the
    whole search; a generation of both specialists is one job, and a subset that was evaluated before isn't again.
    """
    groups = groups or {}
    w = wide_rows(df, record, subject, names, [design])
    for why in w.failed.values():
        raise ValueError(why)
    add_splits(w, [design])
    redundancy = batch.correlations(w.rows, len(names), list(w.splits.values()))
    known: dict[str, dict] = {}
    parts: list[DataFrame] = []

    def random_subset(rng: random.Random, scores: dict[str, float]) -> list[str]:
        weights = [0.05 + max(scores.get(f, 0.0), 0.0) for f in names]
        return sorted(set(rng.choices(names, weights, k=rng.randint(s.smallest, min(s.largest, len(names))))) | set(rng.sample(names, s.smallest)))

    def evaluate(populations: list[_Population], g: int) -> None:
        """Results of generation g, as a part of the table and in each population's `seen`."""
        subsets = {(p.phase, f"{p.phase}-{g}-{i}"): fs for p in populations for i, fs in enumerate(p.alive)}
        new = sorted({",".join(fs) for fs in subsets.values()} - set(known))
        if new:
            found = evaluate_subsets(w, {f: f.split(",") for f in new}, design, redundancy)
            known.update({r["individual"]: r for r in found.withColumns({f"_{k}": fitness(k) for k in ("decline", "maintain", "balanced")}).collect()})  # a row a subset
            kinds.setdefault("schema", found.schema)
        schema = T.StructType([*kinds["schema"].fields, T.StructField("fitness", T.DoubleType()), T.StructField("phase", T.StringType()), T.StructField("generation", T.IntegerType())])
        rows = []
        for (phase, i), fs in subsets.items():
            r = known[",".join(fs)].asDict()
            rows.append(tuple(i if c == "individual" else r[c] for c in kinds["schema"].names) + (r[f"_{phase}"], phase, g))
        parts.append(w.rows.sparkSession.createDataFrame(rows, schema))
        for p in populations:
            p.seen += [(-known[",".join(fs)][f"_{p.phase}"], f"{p.phase}-{g}-{i}", fs) for i, fs in enumerate(p.alive)]

    def grow(p: _Population, elites: dict[str, list[list[str]]]) -> None:
        """The next generation: the best of this one, then children of parents that win tournaments or, in the last phase, mostly of specialists."""
        now = sorted(p.seen[-len(p.alive) :], key=lambda x: x[:2])
        rng = p.rng
        pick = lambda: min(rng.sample(now, min(s.tournament, len(now))), key=lambda x: x[:2])[2]
        p.alive = [fs for _, _, fs in now[: s.elite]]
        while len(p.alive) < s.population:
            mode = rng.choices(["decline", "maintain", "balanced"], [0.35, 0.35, 0.30])[0] if p.phase == "balanced" else p.phase
            both = (rng.choice(elites["decline"]), rng.choice(elites["maintain"])) if p.phase == "balanced" and rng.random() < 0.75 else (pick(), pick())
            p.alive.append(_child(*both, names, guide[mode], groups, s, rng))

    kinds: dict = {}
    random_of = lambda phase: random.Random(f"{s.seed}|{phase}")
    specialists = [_Population(k, (r := random_of(k)), [random_subset(r, guide[k]) for _ in range(s.population)], []) for k in ("decline", "maintain")]
    for g in range(s.generations):
        evaluate(specialists, g)
        if g + 1 < s.generations:
            for p in specialists:
                grow(p, {})
    elites = {p.phase: p.best(s.elite) for p in specialists}
    guide = boosted(guide, elites, s.boost)
    rng = random_of("balanced")
    children = _Population("balanced", rng, [_child(rng.choice(elites["decline"]), rng.choice(elites["maintain"]), names, guide["balanced"], groups, s, rng) for _ in range(s.population)], [])
    for g in range(s.children):
        evaluate([children], g)
        if g + 1 < s.children:
            grow(children, elites)
    return reduce(DataFrame.unionByName, parts)
