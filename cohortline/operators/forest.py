"""Bagged trees for many splits and feature subsets: a task grows all trees of a split from its training sample."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import batch

#: A tree: feature (-1 in a leaf), threshold, places of both children, share of class 1.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
PARENT = 10


def grow(x: np.ndarray, y: np.ndarray, most: int, rng: np.random.Generator) -> Tree:
    """A tree of at most so many splits, level by level, each the best by Gini's index of a random square root of the features; nodes of under PARENT rows stay whole."""
    d = x.shape[1]
    tried = max(1, round(d**0.5))
    feature, threshold, left, right, value = [-1], [0.0], [-1], [-1], [float(y.mean())]
    todo, splits = deque([(0, np.arange(len(y)))]), 0
    while todo and splits < most:
        node, own = todo.popleft()
        if len(own) < PARENT or y[own].min() == y[own].max():
            continue
        columns = rng.choice(d, tried, replace=False)
        order = np.argsort(x[np.ix_(own, columns)], axis=0, kind="stable")
        values, ones = np.take_along_axis(x[np.ix_(own, columns)], order, 0), y[own][order]
        n = np.arange(1, len(own))[:, None]
        a = np.cumsum(ones, axis=0)[:-1]
        b, m = ones.sum(axis=0) - a, len(own) - n
        impurity = a * (n - a) / n + b * (m - b) / m
        impurity = np.where(values[1:] > values[:-1], impurity, np.inf)
        at, k = np.unravel_index(np.argmin(impurity), impurity.shape)
        whole = ones[:, 0].sum()
        if not impurity[at, k] < whole * (len(own) - whole) / len(own) - 1e-12:
            continue
        cut = (values[at, k] + values[at + 1, k]) / 2
        low = x[own, columns[k]] <= cut
        feature[node], threshold[node], left[node], right[node] = int(columns[k]), float(cut), len(feature), len(feature) + 1
        for part in (own[low], own[~low]):
            todo.append((len(feature), part))
            for c, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, float(y[part].mean()))):
                c.append(v)
        splits += 1
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def bagged(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int, seed: int) -> list[Tree]:
    """Trees of samples drawn by weight, as many rows as there are; a tree has at most a fifth of the rows, 20 and at least 2 splits."""
    rng = np.random.default_rng(seed)
    most = max(2, min(20, len(y) // 5))
    out = []
    for _ in range(trees):
        own = rng.choice(len(y), len(y), p=w / w.sum())
        out.append(grow(x[own], y[own], most, rng))
    return out


def share(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Mean over the trees of the share of class 1 in the leaf of each row."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), int)
        while (going := feature[at] >= 0).any():
            low = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(going, np.where(low, left[at], right[at]), at)
        total += value[at]
    return total / max(len(trees), 1)


def fit_forests(rows: DataFrame, splits: list[batch.Split], specs: list[batch.Spec], found: list[batch.Moments], trees: int = 100, max_rows: int = 20_000) -> tuple[list[list[Tree] | None], list[str]]:
    """Trees of each spec, None where growing failed, and the reason ('' if there is none). One group of rows a split.

    Trees learn from max_rows training rows of a split at most, chosen by the hash of the id; that bounds a task and isn't a limit of what is scored.
    """
    of_split: dict[int, list[int]] = {}
    for i, s in enumerate(specs):
        of_split.setdefault(s.split, []).append(i)
    used = {i: splits[i] for i in of_split}
    rates = {i: min(1.0, max_rows / max(found[i].n.sum(), 1)) for i in of_split}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            if not record.num_rows:
                continue
            b = batch.Batch.of(record)
            for i, s in used.items():
                at = b.of_split(s, False)
                if rates[i] < 1:
                    ids = record.column("row_id").take(pa.array(at)).to_pylist()
                    at = at[[zlib.crc32(f"{i}|{x}".encode()) < rates[i] * 2**32 for x in ids]]
                if len(at):
                    x = s.scaling.apply(b.values[at])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(b.y[at]), pa.array(list(x), pa.list_(pa.float64()))], names=["split", "y", "x"])

    own = {i: [(k, specs[k].name, list(specs[k].columns)) for k in ks] for i, ks in of_split.items()}
    weights = {i: found[i].weights() for i in of_split}

    def fit(t: pa.Table) -> pa.Table:
        i = t["split"][0].as_py()
        y = t["y"].to_numpy()
        x = t["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        order = np.lexsort(x.T[::-1])  # the same trees, however rows come
        x, y = x[order], y[order]
        out = {"spec": [], "why": [], "tree": [], "feature": [], "threshold": [], "left": [], "right": [], "value": []}
        for k, name, columns in own[i]:
            try:
                grown, why = bagged(x[:, columns], y, weights[i][y.astype(int)], trees, zlib.crc32(name.encode())), ""
            except ValueError as e:
                grown, why = [], str(e)
            for n, tree in enumerate(grown or [tuple(np.zeros(0) for _ in range(5))]):
                for c, v in zip(("spec", "why", "tree"), (k, why, n), strict=True):
                    out[c].append(v)
                for c, v in zip(("feature", "threshold", "left", "right", "value"), tree, strict=True):
                    out[c].append(v.astype(float).tolist())
        kinds = {"spec": pa.int32(), "why": pa.string(), "tree": pa.int32()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.list_(pa.float64()))) for c, v in out.items()})

    schema = "spec int, why string, tree int, feature array<double>, threshold array<double>, left array<double>, right array<double>, value array<double>"
    out: list[list[Tree] | None] = [None] * len(specs)
    whys = ["no training rows"] * len(specs)
    fitted = rows.mapInArrow(sample, "split int, y double, x array<double>").groupBy("split").applyInArrow(fit, schema)
    for r in sorted(fitted.collect(), key=lambda r: (r["spec"], r["tree"])):  # at most 41 nodes a tree
        whys[r["spec"]] = r["why"]
        if not r["why"]:
            out[r["spec"]] = out[r["spec"]] or []
            out[r["spec"]].append((np.array(r["feature"], int), np.array(r["threshold"]), np.array(r["left"], int), np.array(r["right"], int), np.array(r["value"])))
    return out, whys


def score_forests(rows: DataFrame, splits: list[batch.Split], specs: list[batch.Spec], forests: list[list[Tree] | None]) -> DataFrame:
    """(spec, row_id, y, held_out, p) of all rows of each spec that has trees, as batch.score_many gives them."""
    of_split: dict[int, list[int]] = {}
    for i, s in enumerate(specs):
        if forests[i]:
            of_split.setdefault(s.split, []).append(i)
    sent = rows.sparkSession.sparkContext.broadcast((of_split, {i: splits[i] for i in of_split}, {k: (list(specs[k].columns), forests[k]) for ks in of_split.values() for k in ks}))  # trees of the models
    kind = rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_split, used, models = sent.value
        for record in batches:
            if not record.num_rows:
                continue
            b = batch.Batch.of(record)
            for i, ks in of_split.items():
                at = b.of_split(used[i], None)
                if not len(at):
                    continue
                x, row = used[i].scaling.apply(b.values[at]), record.column("row_id").take(pa.array(at))
                out = b.folds[at, used[i].deal] == used[i].train
                for k in ks:
                    columns, trees = models[k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), row, pa.array(b.y[at].astype(np.int32)), pa.array(out), pa.array(share(trees, x[:, columns]))], names=["spec", "row_id", "y", "held_out", "p"])

    return rows.mapInArrow(run, f"spec int, row_id {kind}, y int, held_out boolean, p double")
