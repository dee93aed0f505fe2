"""Validation by repeated subject-level folds: everything is fitted on training folds, all fits of a grid together."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import batch, bayes, features, folds, metrics, prep
from ..sources import tables
from ..sources.shared import checkpointed

#: Named transforms: signed log, winsor limits, log or atanh by the name of the feature.
TRANSFORMS = {"zscore": (False, False, False), "winsor": (False, True, False), "log": (True, False, False), "winsor_log": (True, True, False), "names": (False, False, True), "winsor_names": (False, True, True)}
#: So many fits share their passes at most; their parameters go to the tasks with the job.
TOGETHER = 4_000


@dataclass(frozen=True)
class Design:
    """seeds: one for each repeat. top_k: None takes all features, of fixed where given. rank: 'effect' or 'auc'. log, winsor, kinds: steps of the preprocessing."""

    seeds: tuple[int, ...] = (42, 43)
    k: int = 3
    top_k: int | None = 5
    log: bool = False
    winsor: bool = False
    prior: bayes.Prior = bayes.Prior()
    kinds: bool = False
    rank: str = "effect"
    fixed: tuple[str, ...] | None = None

    @property
    def transform(self) -> tuple[bool, bool, bool]:
        return self.log, self.winsor, self.kinds


@dataclass
class Wide:
    """Rows of all tasks (task, row_id, y, folds, values), the deals (folds, seed), the number of folds of each (task, folds) and why others have none."""

    rows: DataFrame
    names: list[str]
    deals: list[tuple[int, int]]
    folds: dict[tuple[str, int], int]
    failed: dict[tuple[str, int], str]
    splits: dict[tuple, batch.Split] = field(default_factory=dict)
    moments: dict[str, batch.Moments] = field(default_factory=dict)
    auc: dict[str, np.ndarray] = field(default_factory=dict)


Task = tuple[str, str, list[str], list[str]]


def wide_rows(df: DataFrame, record: str, subject: str, names: list[str], designs: list[Design], tasks: list[Task] | None = None, least: int = 1) -> Wide:
    """The rows of a grid, each once for every task that it belongs to, with its fold in all deals.

    A record without a subject is a subject of its own. Folds are as folds.dealt_folds deals them: with both classes, maybe fewer. A task with under `least`
    records of a class fails. Without tasks, y is a column of df.
    """
    deals = sorted({(d.k, s) for d in designs for s in d.seeds})
    df = folds.with_own_subjects(df, subject, record)
    rows, found, failed = None, {}, {}
    values = F.array(*[F.col(c).cast("double") for c in names])
    for task in tasks or [("", "", [], [])]:
        own = features.pick_task(df, task[1], task[2], task[3], ("0", "1")).drop("task_class") if tasks else df
        own = checkpointed(own.select(F.col(record).alias("row_id"), F.col(subject).alias("_s"), "y", values.alias("values")))
        sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two numbers
        joined = own
        for k in sorted({k for k, _ in deals}):
            try:
                if min(sizes.get(0, 0), sizes.get(1, 0)) < least:
                    raise ValueError(f"classes of {sizes.get(0, 0)} and {sizes.get(1, 0)} records; {least} are needed")
                f, found[task[0], k] = folds.dealt_folds(own, "_s", "y", k, [s for n, s in deals if n == k])
            except ValueError as e:
                failed[task[0], k] = str(e)
                joined = joined.withColumn(f"_f{k}", F.lit(None).cast("map<int,int>"))
                continue
            of = f.groupBy(F.col("subject").alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("seed", "fold"))).alias(f"_f{k}"))  # an entry a repeat
            joined = joined.join(of, "_s", "left")
        dealt = F.array(*[F.coalesce(F.try_element_at(f"_f{k}", F.lit(s)), F.lit(-1)) for k, s in deals])
        joined = joined.select(F.lit(task[0]).alias("task"), "row_id", F.col("y").cast("int").alias("y"), dealt.alias("folds"), "values")
        rows = joined if rows is None else rows.unionByName(joined)
    return Wide(checkpointed(rows), names, deals, found, failed)


def add_splits(w: Wide, designs: list[Design]) -> None:
    """Splits of the transforms and folds of designs, with their moments, where w has none yet; one job for each transform and number of folds, one pass for all moments."""
    new = []
    for transform, k in sorted({(d.transform, d.k) for d in designs if any(d.k == n for _, n in w.folds)}):
        if any(t == transform and w.deals[i][0] == k for t, _, i, _ in w.splits):
            continue
        log, winsor, kinds = transform
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.col("folds")[i].alias("fold")) for i, (n, _) in enumerate(w.deals) if n == k])).alias("d")
        long = w.rows.select("task", "values", at).filter("d.fold > 0").select("task", "d.seed", "d.fold", F.posexplode("values").alias("i", "value"))
        feature = F.element_at(F.array(*map(F.lit, w.names)), F.col("i") + 1)
        found = prep.fold_parameters(long.withColumn("feature", feature).drop("i"), k, log=log, winsor=winsor, kinds=kinds, by=["task"]).collect()  # a row for each feature and fold
        place = {f: i for i, f in enumerate(w.names)}
        arrays: dict[tuple, dict[str, np.ndarray]] = {}
        for r in found:
            if r["train"] > w.folds[r["task"], k]:
                continue
            a = arrays.setdefault((r["task"], r["seed"], r["train"]), {c: np.full(len(w.names), np.nan if c in ("low", "high") else 0.0) for c in ("med", "least", "low", "high", "mean", "sd")})
            for c, v in a.items():
                if r[c] is not None:
                    v[place[r["feature"]]] = r[c]
        kind = tuple(map(rules.transform_kind, w.names)) if kinds else None
        for (task, deal, train), a in sorted(arrays.items()):
            a["sd"][a["sd"] == 0] = 1.0
            key = (transform, task, deal, train)
            w.splits[key] = batch.Split("|".join(map(str, key)), task, deal, train, batch.Scaling(**a, log=log, kinds=kind))
            new.append(w.splits[key])
    if new:
        w.moments |= {s.name: m for s, m in zip(new, batch.moments(w.rows, new), strict=True)}


def add_auc(w: Wide, splits: list[batch.Split]) -> None:
    """|AUC - 0.5| of each scaled feature over the training rows of the splits that have none yet; scores are counted by value, over all tasks."""
    splits = [s for s in splits if s.name not in w.auc]
    if not splits:
        return

    def run(batches):
        for record in batches:
            if not record.num_rows:
                continue
            b = batch.Batch.of(record)
            for i, s in enumerate(splits):
                at = b.of_split(s, False)
                x = s.scaling.apply(b.values[at])
                p = (0.5 + x / (1 + np.abs(x)) / 2).ravel()  # in the order of x, within [0, 1]
                n, d = x.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n * d, i, np.int32)), pa.array(np.tile(np.arange(d, dtype=np.int32), n)), pa.array(np.repeat(b.y[at].astype(np.int32), d)), pa.array(p)], names=["s", "f", "y", "p"])

    scored = w.rows.mapInArrow(run, "s int, f int, y int, p double")
    out = np.zeros((len(splits), len(w.names)))
    for r in metrics.area_under_roc(scored, ["s", "f"]).collect():  # a number for each feature and split
        out[r["s"], r["f"]] = abs(r["auc"] - 0.5) if r["auc"] is not None else 0.0
    w.auc |= {s.name: v for s, v in zip(splits, out, strict=True)}


def ranked(w: Wide, split: batch.Split, rank: str) -> list[int]:
    """Places of the features by falling score, then by name: all numbers of best features are its beginnings."""
    score = w.auc[split.name] if rank == "auc" else np.abs(w.moments[split.name].cohens_d())
    return sorted(range(len(w.names)), key=lambda i: (-score[i], w.names[i]))


def chosen_features(w: Wide, split: batch.Split, d: Design) -> tuple[int, ...]:
    """Places of the features that a design takes on a split, in the order of their names."""
    if d.fixed is not None:
        own = [i for i, n in enumerate(w.names) if n in d.fixed]
    elif d.top_k is None or d.top_k >= len(w.names):
        own = list(range(len(w.names)))
    else:
        own = ranked(w, split, d.rank)[: d.top_k]
    return tuple(sorted(own, key=lambda i: w.names[i]))


def splits_of(w: Wide, d: Design, task: str) -> list[tuple[int, batch.Split]]:
    """(seed, split) of a design and task whose training rows have both classes."""
    out = [(w.deals[i][1], s) for (t, own, i, _), s in w.splits.items() if t == d.transform and own == task and w.deals[i][0] == d.k and w.deals[i][1] in d.seeds]
    return [(seed, s) for seed, s in out if w.moments[s.name].n.min() > 0]


def prior_precisions(p: bayes.Prior) -> dict[str, float]:
    return {"precision": 1 / p.sd**2, "intercept_precision": 1 / p.intercept_sd**2 if p.intercept_sd else 0.0}


def fit_designs(w: Wide, parts: list[tuple[str, str, Design]]) -> tuple[DataFrame, DataFrame]:
    """Predictions (task, design, seed, fold, row_id, y, p, ...) of held-out rows, and the features selected for each fold, of (task, name, design).

    All fits take their steps together. Folds whose training rows lack a class are left out.
    """
    spark = w.rows.sparkSession
    designs = [d for _, _, d in parts]
    add_splits(w, designs)
    add_auc(w, list({s.name: s for task, _, d in parts if d.rank == "auc" and d.top_k is not None and d.fixed is None for _, s in splits_of(w, d, task)}.values()))
    splits = list(w.splits.values())
    place = {s.name: i for i, s in enumerate(splits)}
    specs, tags, selected = [], [], []
    for task, name, d in parts:
        for seed, s in splits_of(w, d, task):
            columns = chosen_features(w, s, d)
            if columns:
                tags.append((len(specs), task, name, seed, s.train))
                selected.append((task, name, seed, s.train, [w.names[i] for i in columns]))
                specs.append(batch.Spec(f"{task}|{name}|{seed}|{s.train}", place[s.name], columns, posterior=True, **prior_precisions(d.prior)))
    fits = batch.fit_many(w.rows, splits, specs, [w.moments[s.name] for s in splits], designs[0].prior) if specs else []
    scored = batch.score_many(w.rows, splits, specs, fits).drop("held_out")
    of = F.broadcast(spark.createDataFrame(tags, "spec int, task string, design string, seed int, fold int"))  # a row a fit
    kept = spark.createDataFrame(selected, "task string, design string, seed int, fold int, features array<string>")
    return scored.join(of, "spec").select("task", "design", "seed", "fold", "row_id", "y", *bayes.SCORES), kept


def validate(df: DataFrame, record: str, subject: str, names: list[str], d: Design) -> tuple[DataFrame, DataFrame]:
    """Predictions (seed, fold, row_id, y, p and the columns of its uncertainty) of held-out records, and (seed, train, features) selected for each fold.

    df has one row for each record with y (0 or 1). Folds whose training rows lack a class are left out; too few subjects of a class for two folds are an error.
    """
    w = wide_rows(df, record, subject, names, [d])
    for why in w.failed.values():
        raise ValueError(why)
    predictions, selected = fit_designs(w, [("", "", d)])
    return predictions.drop("task", "design"), selected.select("seed", F.col("fold").alias("train"), "features")


def prepared(df: DataFrame, record: str, subject: str, names: list[str], d: Design) -> DataFrame:
    """(seed, train, record, feature, y, x, held_out): every record with every training set, scaled by it, one row for each feature.

    Folds are as in wide_rows; too few subjects of a class for two folds are an error.
    """
    df = folds.with_own_subjects(df, subject, record)
    f, k = folds.dealt_folds(df, subject, "y", d.k, list(d.seeds))
    long = features.to_long(df, [record, subject, "y"], names)
    long = long.join(f.select("seed", F.col("subject").alias(subject), "fold"), subject).drop(subject)
    parameters = prep.fold_parameters(long, k, log=d.log, winsor=d.winsor, kinds=d.kinds)
    return prep.apply_parameters(long, parameters, log=d.log, kinds=d.kinds).select("seed", "train", record, "feature", "y", "x", "held_out")


def pooled_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics of each repeat over all its folds."""
    return metrics.evaluate(predictions, ["seed"])


def fold_then_repeat(predictions: DataFrame, names: list[str]) -> DataFrame:
    """Mean over repeats of the mean over folds of each metric."""
    per_fold = metrics.evaluate(predictions, ["seed", "fold"])
    per_repeat = per_fold.groupBy("seed").agg(*[F.avg(c).alias(c) for c in names])
    return per_repeat.agg(F.count("*").alias("runs"), *[x for c in names for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])


def grid_designs(transforms: list[str], top_ks: list[int | None], ks: list[int], seeds: tuple[int, ...], prior: bayes.Prior = bayes.Prior(), ranks: tuple[str, ...] = ("effect",), fixed: tuple[str, ...] | None = None) -> dict[str, Design]:
    """A design for each combination, by a name such as 'winsor|top5|k3' or 'zscore|auc5|k3'; all features and the fixed ones come once a transform, whatever the ranks."""
    out = {}
    for t, k in product(transforms, ks):
        log, winsor, kinds = TRANSFORMS[t]
        common = {"seeds": seeds, "k": k, "log": log, "winsor": winsor, "kinds": kinds, "prior": prior}
        for top, rank in product(top_ks, ranks):
            if top is None:
                out[f"{t}|topall|k{k}"] = Design(top_k=None, **common)
            else:
                out[f"{t}|{'top' if rank == 'effect' else rank}{top}|k{k}"] = Design(top_k=top, rank=rank, **common)
        if fixed is not None:
            out[f"{t}|fixed{len(fixed)}|k{k}"] = Design(top_k=None, fixed=fixed, **common)
    return out


def run_grid(df: DataFrame, record: str, subject: str, names: list[str], tasks: list[Task], designs: dict[str, Design], path: str, least: int = 1) -> DataFrame:
    """Predictions (task, design, status, seed, fold, row_id, y, p, ...) of all tasks and designs, kept in a folder with the features selected for each fold.

    All fits share rows, folds, rankings and passes, up to TOGETHER of them; each such part of the grid is one write. Tasks and designs that are there already aren't
    computed again, so a job that broke off is taken up where it stopped. A task without folds for a design (such as too few
    subjects of a class, or under `least` records of one) is one row whose status says why.
    """
    spark, where = df.sparkSession, f"{path}/predictions"
    try:
        done = {(r["task"], r["design"]) for r in spark.read.parquet(where).select("task", "design").distinct().collect()}  # the grid's parts
    except AnalysisException:  # nothing is there yet
        done = set()
    left = [(t[0], name, d) for t in tasks for name, d in designs.items() if (t[0], name) not in done]
    if left:
        w = wide_rows(df, record, subject, names, [d for _, _, d in left], [t for t in tasks if any(t[0] == x for x, _, _ in left)], least)
        failed = [(t, n, f"FAILED: {w.failed[t, d.k]}") for t, n, d in left if (t, d.k) in w.failed]
        going = [(t, n, d) for t, n, d in left if (t, d.k) not in w.failed]
        while going:
            part, size = [], 0
            while going and (not part or size + len(going[0][2].seeds) * going[0][2].k <= TOGETHER):
                part.append(going.pop(0))
                size += len(part[-1][2].seeds) * part[-1][2].k
            found, selected = fit_designs(w, part)
            tables.write(selected, f"{path}/selected", append=True)
            tables.write(found.withColumn("status", F.lit("OK")), where, append=True)
        if failed:
            kinds = ", ".join(f"{c} double" for c in bayes.SCORES)
            none = spark.createDataFrame([], f"task string, design string, seed int, fold int, row_id {df.schema[record].dataType.simpleString()}, y int, {kinds}, status string")
            tables.write(none.unionByName(spark.createDataFrame(failed, "task string, design string, status string"), allowMissingColumns=True), where, append=True)
    return spark.read.parquet(where)


def grid_selection(spark, path: str) -> DataFrame:
    """(task, design, seed, fold, features) of a grid that run_grid keeps in a folder."""
    return spark.read.parquet(f"{path}/selected")


def grid_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics of each task, design and repeat, over its folds, of the runs that did not fail."""
    return metrics.evaluate(predictions.filter("status = 'OK'"), ["task", "design", "seed"])
