"""Many small models over one wide table, fitted and scored in shared passes.

A row has (task, row_id, y, folds, values): folds has the fold of the row in each deal of folds, values all features. A split is
a training set, all rows of a task but those of one fold of a deal, with the scaling that was fitted on it; a spec is a model of
some features on a split. So a grid of many thousand fits reads each row once a pass, without a copy for each
fold or fit: every task scales its rows for each split once and adds up what all models of the split need. Models of one split
are padded to one size and handled as one array; their sums are added up, and their steps solved, in the tasks of a
second stage, so only parameters reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import bayes

#: Models that are padded to one size together, and sums of partitions that one task adds up.
TOGETHER, ADDED = 64, 64


@dataclass(frozen=True, eq=False)
class Scaling:
    """What a training set says about each feature; low and high may be NaN (no limits), kinds has 'log', 'atanh' or 'none' for each."""

    med: np.ndarray
    least: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    log: bool = False
    kinds: tuple[str, ...] | None = None

    def apply(self, values: np.ndarray) -> np.ndarray:
        """Scaled values: medians for what isn't finite, then limits and signed log, or first log or atanh by kind, then limits."""
        x = np.where(np.isfinite(values), values, self.med)
        if self.kinds is not None:
            x = self._by_kind(x)
        limited = np.where(np.isnan(self.low), x, np.clip(x, np.nan_to_num(self.low, nan=-np.inf), np.nan_to_num(self.high, nan=np.inf)))
        if self.log and self.kinds is None:
            limited = np.sign(limited) * np.log1p(np.abs(limited))
        return (limited - self.mean) / self.sd

    def _by_kind(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        kinds = np.array(self.kinds)
        tanh, log = kinds == "atanh", (kinds == "log") & (self.least >= 0)
        x[:, tanh] = np.arctanh(np.clip(x[:, tanh], -0.999, 0.999))
        x[:, log] = np.log(np.maximum(x[:, log], 0) + rules.EPS)
        return x


@dataclass(frozen=True, eq=False)
class Split:
    name: str
    task: str
    deal: int
    train: int
    scaling: Scaling


@dataclass(frozen=True, eq=False)
class Spec:
    """A model: features by place, the loss ('logistic' or 'hinge', squared), precisions of the slopes and the intercept.

    over: coefficients (intercept first) of another model on the same features, whose score is then the one feature. posterior: scores come with their uncertainty.
    """

    name: str
    split: int
    columns: tuple[int, ...]
    loss: str = "logistic"
    precision: float = 4.0
    intercept_precision: float = 0.0
    over: np.ndarray | None = None
    posterior: bool = False

    @property
    def size(self) -> int:
        return 2 if self.over is not None else len(self.columns) + 1


@dataclass
class Batch:
    """Rows as arrays."""

    record: pa.RecordBatch
    task: np.ndarray
    y: np.ndarray
    folds: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Batch:
        n = b.num_rows
        wide = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        return cls(b, np.array(b.column("task").to_pylist(), object), b.column("y").to_numpy(zero_copy_only=False).astype(float), wide("folds"), wide("values").astype(float))

    def of_split(self, s: Split, held_out: bool | None) -> np.ndarray:
        """Places of the rows that are trained on (False), held out (True), or either."""
        fold = self.folds[:, s.deal]
        own = (self.task == s.task) & (fold > 0)
        return np.flatnonzero(own if held_out is None else own & ((fold == s.train) == held_out))


def summed(rows: DataFrame, parts: Callable[[Batch], Iterable[tuple[int, np.ndarray]]], then: Callable[[int, np.ndarray], dict[str, list]], schema: str) -> DataFrame:
    """What `then` makes of each id and the sum of all arrays that `parts` gives for it; ids are added up in tasks, in two levels where there are many partitions."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for i, v in parts(Batch.of(b)):
                    sums[i] = sums[i] + v if i in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["id", "v"])

    def added(t: pa.Table) -> np.ndarray:
        return t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(axis=0)

    def some(t: pa.Table) -> pa.Table:
        return pa.table({"id": t["id"][:1].combine_chunks(), "v": pa.array([added(t).tolist()], pa.list_(pa.float64()))})

    def whole(t: pa.Table) -> pa.Table:
        return pa.table(then(t["id"][0].as_py(), added(t)))

    out = rows.mapInArrow(local, "id int, v array<double>")
    if rows.rdd.getNumPartitions() > ADDED:
        out = out.groupBy("id", F.pmod(F.spark_partition_id(), F.lit(ADDED)).alias("part")).applyInArrow(some, "id int, v array<double>")
    return out.groupBy("id").applyInArrow(whole, schema)


def _row(**values) -> dict[str, list]:
    kinds = {"b": pa.float64(), "cov": pa.float64(), "small": pa.bool_(), "v": pa.float64()}
    return {k: pa.array([v.tolist()], pa.list_(kinds[k])) if isinstance(v, np.ndarray) else pa.array([v], pa.int32()) for k, v in values.items()}


@dataclass(frozen=True, eq=False)
class Moments:
    """Of the scaled training values of a split: rows of both classes, and sums and sums of squares of each feature in both."""

    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    def weights(self) -> np.ndarray:
        """Inverse class frequencies."""
        return self.n.sum() / (2 * np.maximum(self.n, 1))

    def cohens_d(self) -> np.ndarray:
        """Difference of the means by the pooled standard deviation; 0 where it isn't defined."""
        n = self.n[:, None]
        with np.errstate(all="ignore"):
            mean = self.sums / n
            var = np.maximum(self.squares - n * mean**2, 0) / (n - 1)
            pooled = np.sqrt(((n - 1) * var).sum(axis=0) / (n.sum() - 2))
            d = (mean[1] - mean[0]) / pooled
        return np.where(np.isfinite(d) & (self.n.min() >= 2) & (pooled > 1e-12), d, 0.0)


def moments(rows: DataFrame, splits: list[Split]) -> list[Moments]:
    """Moments of all splits in one pass."""

    def parts(b: Batch) -> Iterator[tuple[int, np.ndarray]]:
        for i, s in enumerate(splits):
            own = b.of_split(s, False)
            x, y = s.scaling.apply(b.values[own]), b.y[own]
            of = [x[y == c] for c in (0, 1)]
            yield i, np.concatenate([[len(o) for o in of], *[o.sum(axis=0) for o in of], *[(o * o).sum(axis=0) for o in of]])

    found = {r["id"]: np.array(r["v"]) for r in summed(rows, parts, lambda i, v: _row(id=i, v=v), "id int, v array<double>").collect()}  # a few numbers a feature and split
    d = len(splits[0].scaling.med) if splits else 0
    out = []
    for i in range(len(splits)):
        v = found.get(i, np.zeros(2 + 4 * d))
        out.append(Moments(v[:2], v[2 : 2 + 2 * d].reshape(2, d), v[2 + 2 * d :].reshape(2, d)))
    return out


def _blocks(specs: list[Spec]) -> list[list[int]]:
    """Places of specs of one split, of alike sizes, at most so many together."""
    order = sorted(range(len(specs)), key=lambda i: (specs[i].split, specs[i].over is not None, specs[i].size))
    out: list[list[int]] = []
    for i in order:
        last = specs[out[-1][0]] if out else None
        if last is None or last.split != specs[i].split or (last.over is None) != (specs[i].over is None) or len(out[-1]) >= TOGETHER or specs[i].size > 2 * last.size + 8:
            out.append([])
        out[-1].append(i)
    return out


def _designs(x: np.ndarray, specs: list[Spec]) -> np.ndarray:
    """An array (spec, row, feature) whose first feature is 1; features beyond those of a spec are 0."""
    n, m = len(x), max(s.size for s in specs)
    wide = np.column_stack([np.ones(n), x, np.zeros(n)])
    if specs[0].over is None:
        at = np.full((len(specs), m), wide.shape[1] - 1)
        for k, s in enumerate(specs):
            at[k, : s.size] = [0, *[c + 1 for c in s.columns]]
        return np.ascontiguousarray(wide[:, at].transpose(1, 0, 2))
    return np.stack([np.column_stack([np.ones(n), wide[:, [0, *[c + 1 for c in s.columns]]] @ s.over]) for s in specs])


def _sums(a: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray, hinge: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of each spec over the rows, as one array (spec, m + m * m)."""
    z = np.matmul(a, b[:, :, None])[:, :, 0]
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    slope, bend = w * (p - y), np.maximum(w * p * (1 - p), 1e-8)
    if hinge.any():
        t = 2 * y - 1
        short = np.maximum(1 - t * z, 0)
        slope = np.where(hinge[:, None], -2 * w * t * short, slope)
        bend = np.where(hinge[:, None], 2 * w * (short > 0), bend)
    g = np.matmul(slope[:, None, :], a)[:, 0]
    h = np.matmul((a * bend[:, :, None]).transpose(0, 2, 1), a)
    return np.concatenate([g, h.reshape(len(a), -1)], axis=1)


def fit_many(rows: DataFrame, splits: list[Split], specs: list[Spec], found: list[Moments], prior: bayes.Prior = bayes.Prior()) -> list[bayes.Fit]:
    """Newton steps of all specs together, from zero until a step is below tol * (1 + norm) or max_iter is reached; rows are weighted by inverse class frequency.

    found: the moments of the splits. Each pass sums gradients and Hessians of the specs that haven't converged, and solves their steps in its
    second stage. Specs need both classes among their training rows.
    """
    blocks = _blocks(specs)
    sizes = [max(specs[i].size for i in block) for block in blocks]
    weights = [m.weights() for m in found]
    penalties, state = [], []
    for block, m in zip(blocks, sizes, strict=True):
        penalty = np.ones((len(block), m))  # padded places: their gradients are 0
        for k, i in enumerate(block):
            penalty[k, : specs[i].size] = specs[i].precision
            penalty[k, 0] = specs[i].intercept_precision
        penalties.append(penalty)
        state.append(np.zeros((len(block), m)))
    out: list[bayes.Fit | None] = [None] * len(specs)
    for it in range(1, prior.max_iter + 1):
        going = {k: state[k] for k, block in enumerate(blocks) if any(out[i] is None for i in block)}
        if not going:
            break
        for r in _newton(rows, splits, specs, blocks, going, penalties, weights, prior).collect():  # parameters of the models
            k = r["id"]
            shape = state[k].shape
            b, cov = np.array(r["b"]).reshape(shape), np.array(r["cov"]).reshape(*shape, shape[1])
            for j, i in enumerate(blocks[k]):
                if out[i] is None:
                    state[k][j] = b[j]
                    if r["small"][j] or it == prior.max_iter:
                        s = specs[i].size
                        out[i] = bayes.Fit(b[j, :s].copy(), cov[j, :s, :s].copy(), it, bool(r["small"][j]))
    return out


def _newton(rows, splits, specs, blocks, state, penalties, weights, prior) -> DataFrame:
    of_split: dict[int, list[int]] = {}
    for k in state:
        of_split.setdefault(specs[blocks[k][0]].split, []).append(k)
    own = {k: [specs[i] for i in blocks[k]] for k in state}
    hinges = {k: np.array([s.loss == "hinge" for s in own[k]]) for k in state}
    prior_of = {k: penalties[k] for k in state}
    used = {i: splits[i] for i in of_split}

    def parts(b: Batch) -> Iterator[tuple[int, np.ndarray]]:
        for i, ks in of_split.items():
            at = b.of_split(used[i], False)
            if not len(at):
                continue
            x, y = used[i].scaling.apply(b.values[at]), b.y[at]
            w = weights[i][y.astype(int)]
            for k in ks:
                yield k, _sums(_designs(x, own[k]), y, w, state[k], hinges[k]).ravel()

    def then(k: int, total: np.ndarray) -> dict[str, list]:
        b, penalty = state[k], prior_of[k]
        n, m = b.shape
        total = total.reshape(n, m + m * m)
        g = total[:, :m] + penalty * b
        h = total[:, m:].reshape(n, m, m) + penalty[:, :, None] * np.eye(m) + prior.jitter * np.eye(m)
        step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        new = b - step
        small = np.linalg.norm(step, axis=1) < prior.tol * (1 + np.linalg.norm(new, axis=1))
        return _row(id=k, b=new.ravel(), small=small, cov=np.linalg.inv(h).ravel())

    return summed(rows, parts, then, "id int, b array<double>, small array<boolean>, cov array<double>")


def discriminants(rows: DataFrame, splits: list[Split], specs: list[Spec], found: list[Moments]) -> list[bayes.Fit]:
    """Linear discriminants of all specs from one pass: weighted means and products of all features of a split hold those of every subset.

    The pooled covariance is inverted as a pseudo-inverse. The score is the logit; there is no covariance of the coefficients.
    """
    weights = [m.weights() for m in found]
    of_split: dict[int, list[int]] = {}
    for i, s in enumerate(specs):
        of_split.setdefault(s.split, []).append(i)
    used = {i: splits[i] for i in of_split}

    def parts(b: Batch) -> Iterator[tuple[int, np.ndarray]]:
        for i, s in used.items():
            at = b.of_split(s, False)
            x, y = s.scaling.apply(b.values[at]), b.y[at]
            w = weights[i][y.astype(int)]
            of = [(w * (y == c))[:, None] for c in (0, 1)]
            yield i, np.concatenate([[o.sum() for o in of], *[(o * x).sum(axis=0) for o in of], ((w[:, None] * x).T @ x).ravel()])

    columns = {i: [list(specs[k].columns) for k in ks] for i, ks in of_split.items()}

    def then(i: int, v: np.ndarray) -> dict[str, list]:
        n = np.maximum(v[:2], 1e-12)
        d = int((np.sqrt(4 + 4 * (len(v) - 2)) - 2) / 2)
        mean = v[2 : 2 + 2 * d].reshape(2, d) / n[:, None]
        prod = v[2 + 2 * d :].reshape(d, d)
        cov = (prod - sum(n[c] * np.outer(mean[c], mean[c]) for c in (0, 1))) / n.sum()
        out = []
        for c in columns[i]:
            inverse = np.linalg.pinv(cov[np.ix_(c, c)])
            b = inverse @ (mean[1, c] - mean[0, c])
            first = -0.5 * (mean[1, c] @ inverse @ mean[1, c] - mean[0, c] @ inverse @ mean[0, c]) + np.log(n[1] / n[0])
            out += [first, *b]
        return _row(id=i, b=np.array(out))

    out: list[bayes.Fit | None] = [None] * len(specs)
    for r in summed(rows, parts, then, "id int, b array<double>").collect():  # parameters of the models
        b, at = np.array(r["b"]), 0
        for k in of_split[r["id"]]:
            m = specs[k].size
            out[k] = bayes.Fit(b[at : at + m], np.zeros((m, m)), 1, True)
            at += m
    return out


def score_many(rows: DataFrame, splits: list[Split], specs: list[Spec], fits: list[bayes.Fit | None], held_out: bool | None = True) -> DataFrame:
    """(spec, row_id, y, held_out, p and the columns of its uncertainty) of the held-out rows (True), the training rows (False) or both of each spec that has a fit.

    spec is the place among specs. The uncertainty of a spec without posterior is null.
    """
    of_split: dict[int, list[int]] = {}
    for i, s in enumerate(specs):
        if fits[i] is not None:
            of_split.setdefault(s.split, []).append(i)
    sent = rows.sparkSession.sparkContext.broadcast((of_split, {i: splits[i] for i in of_split}, {i: specs[i] for ks in of_split.values() for i in ks}, {i: (fits[i].b, fits[i].cov) for ks in of_split.values() for i in ks}))  # parameters of the models
    kind = rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_split, used, own, models = sent.value
        for record in batches:
            if not record.num_rows:
                continue
            batch = Batch.of(record)
            for i, ks in of_split.items():
                at = batch.of_split(used[i], held_out)
                if not len(at):
                    continue
                x, row, y = used[i].scaling.apply(batch.values[at]), record.column("row_id").take(pa.array(at)), batch.y[at].astype(np.int32)
                out = batch.folds[at, used[i].deal] == used[i].train
                for k in ks:
                    b, cov = models[k]
                    values = bayes.predictive(_designs(x, [own[k]])[0], b, cov) if own[k].posterior else _plain(_designs(x, [own[k]])[0] @ b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), row, pa.array(y), pa.array(out), *values], names=["spec", "row_id", "y", "held_out", *bayes.SCORES])

    return rows.mapInArrow(run, f"spec int, row_id {kind}, y int, held_out boolean, {', '.join(f'{c} double' for c in bayes.SCORES)}")


def _plain(z: np.ndarray) -> list[pa.Array]:
    return [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))), *[pa.nulls(len(z), pa.float64())] * (len(bayes.SCORES) - 1)]


def correlations(rows: DataFrame, d: int, splits: list[Split]) -> np.ndarray:
    """Absolute correlations of all pairs of scaled features over the held-out rows of all splits, 0 where there is none: one pass over products."""

    def parts(b: Batch) -> Iterator[tuple[int, np.ndarray]]:
        for s in splits:
            x = s.scaling.apply(b.values[b.of_split(s, True)])
            x = np.column_stack([np.ones(len(x)), x])
            yield 0, (x.T @ x).ravel()

    got = summed(rows, parts, lambda i, v: _row(id=i, v=v), "id int, v array<double>").collect()  # one number a pair of features
    if not got:
        return np.zeros((d, d))
    g = np.array(got[0]["v"]).reshape(d + 1, d + 1)
    n, s = g[0, 0], g[0, 1:]
    cov = g[1:, 1:] / n - np.outer(s, s) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(all="ignore"):
        r = np.abs(cov / np.outer(sd, sd))
    return np.where(np.isfinite(r), r, 0.0)
