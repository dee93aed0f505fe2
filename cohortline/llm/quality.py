"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Every feature has a weight and a short vector; each pair of features interacts by the
product of their vectors. The sum over pairs is half of (square of the sum - sum of the
squares) for each vector coordinate, so a text is scored in time linear in its features.

The model is trained on a bounded sample of the labelled rows. Each of a few partitions takes
steps on its own part, then the models are averaged, and so on for some rounds; only models,
whose size is fixed, pass through the driver. All texts are then scored where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Words, slices, space_words, tidied
from .tables import fold, rows_with, small_batches, written

WORD_BITS = 14
LEVELS = 11
#: Kinds of bytes whose shares are features.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".,;:", "!?", "|", "#$%&*@^~", "<>{}[]()/\\=_+\"'-`"]


@dataclass(frozen=True)
class Settings:
    """rank: length of the vectors. max_rows: at most about so many labelled rows are learned from."""

    rank: int = 8
    max_rows: int = 20_000
    partitions: int = 8
    rounds: int = 3
    epochs: int = 4
    batch: int = 32
    rate: float = 0.08
    decay: float = 1e-5
    seed: int = 5


def n_features(n_meta: int) -> int:
    return (1 << WORD_BITS) + (len(KINDS) + 7 + n_meta) * LEVELS


def _kind_table() -> np.ndarray:
    table = np.full(256, len(KINDS), np.int64)
    for i, chars in enumerate(KINDS):
        table[list(chars.encode())] = i
    return table


def _share(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return top / np.maximum(bottom, 1)


def features(texts: pa.Array, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and the count of features for each text, in the order of the texts."""
    n = len(texts)
    words = Words(texts, space_words())
    data, offsets = words.data, words.offsets
    size = np.diff(offsets)
    key = np.repeat(np.arange(n), np.diff(words.bounds)) << WORD_BITS | (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    owner, bucket = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(owner, minlength=n)
    value = (1 + np.log(count)) / np.sqrt(distinct[owner])

    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * (len(KINDS) + 1) + _kind_table()[data], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    not_newline = np.ones(256, bool)
    not_newline[10] = False
    lines = Words(texts, not_newline)
    line_key = np.unique(np.stack([lines.text.astype(np.uint64), lines.hash]), axis=1)[0].astype(np.int64) if len(lines) else np.zeros(0, np.int64)
    again = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])  # a word right after itself
    repeats = np.bincount(words.text[1:][again], minlength=n)
    n_lines, n_words = lines.counts(), words.counts()
    stats = [_share(kinds[:, i], size) for i in range(len(KINDS) + 1)]
    stats += [_share(distinct, n_words), _share(n_lines - np.bincount(line_key, minlength=n), n_lines), np.log1p(n_words) / 16, np.log1p(n_lines) / 16, _share(size - n_words, 20 * n_words), _share(repeats, n_words)]
    stats += [np.log1p(np.maximum(np.nan_to_num(m), 0)) / 16 for m in meta]
    table = np.stack(stats, axis=1)
    level = np.clip(np.log2(1 + table * (2**LEVELS - 2)), 0, LEVELS - 1).astype(np.int64)
    extra = (1 << WORD_BITS) + np.arange(table.shape[1]) * LEVELS + level
    number = np.concatenate([bucket, extra.ravel()])
    values = np.concatenate([value, np.full(extra.size, 1.0)])
    owners = np.concatenate([owner, np.repeat(np.arange(n), table.shape[1])])
    order = np.argsort(owners, kind="stable")
    return number[order], values[order].astype(np.float32), np.bincount(owners, minlength=n)


class Machine:
    """Weights and vectors; scores and gradient steps on batches of sparse rows."""

    def __init__(self, body: np.ndarray, rank: int):
        self.rank, self.bias = rank, body[:1]
        table = body[1:].reshape(-1, rank + 1)
        self.w, self.v, self.body = table[:, 0], table[:, 1:], body

    @classmethod
    def fresh(cls, n: int, rank: int, seed: int) -> Machine:
        body = np.zeros(1 + n * (rank + 1), np.float32)
        made = cls(body, rank)
        made.v[:] = np.random.default_rng(seed).normal(0, 0.02, made.v.shape)
        return made

    def margins(self, number: np.ndarray, value: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        vx = self.v[number] * value[:, None]
        total = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), at)
        linear = np.add.reduceat(self.w[number] * value, at)
        return self.bias[0] + linear + 0.5 * ((total * total).sum(axis=1) - squares), total

    def probabilities(self, number: np.ndarray, value: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.margins(number, value, counts)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings, seed: int) -> None:
        """Adaptive gradient steps over small batches, in a random order that the seed fixes."""
        past = np.full(self.body.shape, 1e-4, np.float32)
        past_w, past_v = past[1:].reshape(-1, self.rank + 1)[:, 0], past[1:].reshape(-1, self.rank + 1)[:, 1:]
        rng = np.random.default_rng(seed)
        for _ in range(s.epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), s.batch):
                part = [rows[i] for i in order[at : at + s.batch]]
                number, value = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
                counts = np.array([len(r[0]) for r in part])
                z, total = self.margins(number, value, counts)
                error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - np.array([r[2] for r in part])) / len(part)
                by = np.repeat(error, counts) * value
                own = np.repeat(np.arange(len(part)), counts)
                used, where = np.unique(number, return_inverse=True)
                order_of = np.argsort(where, kind="stable")
                cut = np.searchsorted(where[order_of], np.arange(len(used)))
                gw = np.add.reduceat(by[order_of], cut) + s.decay * self.w[used]
                gv = np.add.reduceat((by[:, None] * (total[own] - self.v[number] * value[:, None]))[order_of], cut, axis=0) + s.decay * self.v[used]
                past_w[used] += gw * gw
                past_v[used] += gv * gv
                self.w[used] -= s.rate * gw / np.sqrt(past_w[used])
                self.v[used] -= s.rate * gv / np.sqrt(past_v[used])
                g = error.sum()
                past[0] += g * g
                self.bias[0] -= s.rate * g / np.sqrt(past[0])


def _featured(df: DataFrame, text: str, meta: list[str]) -> DataFrame:
    """df's id and y with number array<int> and value array<float>."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                number, value, counts = features(part.column(text), [part.column(m).to_numpy(zero_copy_only=False).astype(np.float64) for m in meta])
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), pa.ListArray.from_arrays(at, pa.array(number, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))], names=["_id", "_y", "number", "value"])

    return df.mapInArrow(run, "_id string, _y int, number array<int>, value array<float>")


def _learner(body: np.ndarray, s: Settings, seed: int) -> Callable[[pa.Table], pa.Table]:
    def learn(rows: pa.Table) -> pa.Table:
        """A copy of the model after some epochs over the group's rows, in the order of their ids."""
        rows = rows.sort_by("_id").combine_chunks()
        number, value = rows["number"].chunk(0), rows["value"].chunk(0)
        found = [(number[i].values.to_numpy(), value[i].values.to_numpy(), y) for i, y in enumerate(rows["_y"].to_pylist())]
        own = Machine(body.copy(), s.rank)
        own.learn(found, s, seed)
        return pa.table({"body": pa.array([own.body.tobytes()], pa.binary()), "n": pa.array([len(found)], pa.int64())})

    return learn


def train(rows: DataFrame, text: str, label: str, id_col: str, meta: list[str], s: Settings = Settings()) -> np.ndarray:
    """The body of a machine that has learned the label (0 or 1) of rows.

    Rows with a null label or id are left out. Of more than about max_rows rows those with
    the smallest hashes of their ids are taken. Without any row the machine gives 0.5.
    """
    rows = rows.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    n = rows.count()
    share = min(1.0, s.max_rows / max(n, 1))
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 62)) < int(share * (1 << 62)))
    rows = rows.select(F.col(id_col).cast("string").alias("_id"), F.col(label).cast("int").alias("_y"), F.col(text), *meta)
    part = F.pmod(F.xxhash64("_id"), F.lit(s.partitions)).alias("part")
    data = written(_featured(rows, text, meta).select("*", part), "features")
    machine = Machine.fresh(n_features(len(meta)), s.rank, s.seed)
    for r in range(s.rounds):
        parts = data.groupBy("part").applyInArrow(_learner(machine.body, s, s.seed + r), "body binary, n long").collect()  # s.partitions models at most
        if not parts:
            break
        total = sum(p["n"] for p in parts)
        machine = Machine(sum(np.frombuffer(p["body"], np.float32) * np.float32(p["n"] / total) for p in sorted(parts, key=lambda p: bytes(p["body"]))), s.rank)
    return machine.body


def score_quality(df: DataFrame, body: np.ndarray, text: str = "text", meta: list[str] | None = None, rank: int = Settings.rank, out: str = "score") -> DataFrame:
    """df with the probability of label 1 (double) for each whole text.

    Null and empty texts are scored by their structure alone; a null in a metadata column
    counts as 0. A column named like the output is replaced; an empty table stays empty.
    """
    meta = meta or []
    if out in (text, *meta):
        raise ValueError(f"{out!r} is an input")
    small_batches(df.sparkSession)
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(body, rank)
        for batch in batches:
            for part in slices(batch, text):
                number, value, counts = features(part.column(text), [part.column(m).to_numpy(zero_copy_only=False).astype(np.float64) for m in meta])
                p = machine.probabilities(number, value, counts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", meta: tuple[str, ...] = ("n_chars",), threshold: float = 0.3, folds: int = 5, s: Settings = Settings()) -> DataFrame:
    """docs with held_out (boolean), score (double) and predicted (int).

    Learns only from labelled rows whose fold isn't 0; rows in fold 0 are held out. Rows
    with a null id are scored, aren't learned from and aren't held out. Of several
    labels of an id the mean decides, 0.5 counting as 1. Labels are no inputs of a score, nor are any columns
    but the text and the metadata columns named. Columns named like an output are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != 0))
    known = known.groupBy(id_col).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    picked = rows_with(docs.select(id_col, text, *meta), known.select(id_col), id_col).join(known, id_col)
    body = train(picked, text, "_label", id_col, list(meta), s)
    scored = score_quality(docs, body, text, list(meta), s.rank)
    return scored.select(
        *docs.columns,
        F.coalesce(fold(id_col, folds) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
