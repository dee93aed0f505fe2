"""Hashed maximum-entropy language model with a class-factored softmax.

P(token | history) = P(class | history) * P(token | class, history). Classes are word endings, of frequent
and of other words apart, and the end.

The class factor is a softmax with hashed features: the token before (bigram), the one before that
(skip) and both together (trigram); the number of hashed rows follows the training tokens. It is trained by
distributed gradient updates: every task takes adaptive gradient steps over its texts, a batch of tokens at a time, then the
tasks' weights are averaged, each row by how often the tasks met it, and so on for some rounds (one, where a
task has some million tokens).

The factor of frequent words is a softmax over the words of one class with the features class of the token before (bigram) and
class of the one before that (skip), so its normalising sums are one table. Its gradient needs only counts
of (class before, word) and of runs of three classes, which all training texts are counted for; each class of words
is then trained in a task of its own until the gradient is small. All other words of an ending share their class by count plus one.

Counts cover all training texts. Counts of the more frequent words (a fixed number at most)
go to all tasks; those of the rest are joined to the texts they occur in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Words, mix, seeded, slices, space_words, tidied
from .tables import fold, no_text, written

_U = np.uint64
GROUPS = 24
END_CLASS = 2 * GROUPS
CLASSES = 2 * GROUPS + 1
START = CLASSES  # the class before the first token
END, START1, START2 = seeded(3, 97)
BLOCKS = 16
CHUNK = 8_192
FAN_IN = 64


@dataclass(frozen=True)
class Settings:
    """frequent: words with a place of their own in the model. sent: words at most whose counts go to all tasks.

    least_rows, most_rows, tokens_a_row: each kind of feature has so many hashed rows, a power of two, about one for
    tokens_a_row training tokens; most_rows is what a task's memory holds (588 bytes a row, and as much again for the squared gradients).
    rounds: averaged passes of gradient steps over the class factor. rate: their length. settled: squared gradient that every weight
    begins with, so that n-grams met a few times hardly move their weights (the prior of the class factor).
    steps: gradient steps of the word factor at most. prior: strength of the pull of its weights to 0.
    """

    frequent: int = 1 << 14
    sent: int = 1_000_000
    least_rows: int = 1 << 12
    most_rows: int = 1 << 16
    tokens_a_row: int = 128
    rounds: int = 1
    rate: float = 0.5
    settled: float = 3.0
    steps: int = 20
    prior: float = 8.0

    def rows(self, tokens: int) -> int:
        wanted = self.least_rows
        while wanted < self.most_rows and wanted * self.tokens_a_row < tokens:
            wanted *= 2
        return wanted


class Tokens:
    """Tokens of a slice: all words of each text, then its end."""

    _groups = (mix(np.arange(1 << 16, dtype=_U) + _U(5)) % _U(GROUPS)).astype(np.int64)

    def __init__(self, texts: pa.Array):
        w = Words(texts, space_words())
        n = len(texts)
        self.n_texts, total = n, len(w) + n
        self.text = np.repeat(np.arange(n), w.counts() + 1)
        ends = w.bounds[1:] + np.arange(n)
        place = np.arange(len(w)) + w.text
        self.hash = np.empty(total, _U)
        self.hash[place], self.hash[ends] = w.hash, END
        low = np.arange(256)
        low[65:91] += 32
        last = low[w.data[w.ends - 1]] if len(w) else np.zeros(0, np.int64)
        second = np.where(w.ends - w.starts > 1, low[w.data[np.maximum(w.ends - 2, 0)]], 0) if len(w) else last
        self.group = np.zeros(total, np.int64)
        self.group[place] = self._groups[second * 256 + last]
        self.is_end = np.zeros(total, bool)
        self.is_end[ends] = True
        self.first = np.concatenate([[0], ends[:-1] + 1]) if n else np.zeros(0, np.int64)

    def before(self, back: int, fill: list) -> np.ndarray:
        """The hash of the token `back` places before in the same text, or the fill for places before its start."""
        out = np.empty_like(self.hash)
        out[back:] = self.hash[:-back]
        for j in range(back):
            at = self.first + j
            at = at[at < len(out)]
            at = at[self.text[at] == self.text[np.maximum(at - j, 0)]]
            out[at] = fill[back - 1 - j]
        return out


class Lookup:
    """Numbers of known hashes; -1 for others."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.slot = np.full(1 << self.BITS, -1, np.int32)
        self.slot[hashes >> _U(64 - self.BITS)] = np.arange(len(hashes), dtype=np.int32)
        self.hashes = hashes

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = self.slot[h >> _U(64 - self.BITS)].astype(np.int64)
        miss = np.flatnonzero((at >= 0) & (self.hashes[at] != h))
        if len(miss):  # words that share a slot
            i = np.minimum(np.searchsorted(self.sorted, h[miss]), len(self.sorted) - 1)
            at[miss] = np.where(self.sorted[i] == h[miss], self.order[i], -1)
        return at


class Model:
    """Counts of known words, class weights and word tables; all of bounded size."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, groups: np.ndarray, tail: np.ndarray, share: np.ndarray, n: int, v: int, s: Settings):
        """hashes: the end, then the most frequent words first; tail: tokens + words + 1 of each tail class; share: of each class; n, v: training tokens and distinct ones."""
        self.s, self.counts, self.n, self.v, self.rows = s, counts, n, v, s.rows(n)
        self.hashes, self.frequent = hashes, min(s.frequent, len(hashes))
        self.log_tail = np.log10(np.maximum(tail, 1))
        self.word_class = np.where(hashes[: self.frequent] == END, END_CLASS, groups[: self.frequent]).astype(np.int64)
        self.bias = np.log(share).astype(np.float32)
        self.w = np.zeros((3 * self.rows, CLASSES), np.float32)
        words = max(self.frequent, 1)
        #: Of frequent words: the log of their share of their class, and weights after each class and after each class but one.
        self.own, self.after = np.zeros(words), np.zeros((2, CLASSES + 1, words), np.float32)
        #: The log of the normalising sums, by class, class before and class before that.
        self.log_sum = np.zeros((CLASSES, CLASSES + 1, CLASSES + 1), np.float32)

    def __getstate__(self) -> dict:
        """What goes to the tasks: weights in half precision, none at all before they are trained."""
        return {**self.__dict__, "w": self.w.astype(np.float16) if self.w.any() else self.w.shape}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.w = np.zeros(self.w, np.float32) if isinstance(self.w, tuple) else self.w.astype(np.float32)

    def without_weights(self) -> Model:
        """The same but for the weights of the class factor, for tasks that don't use them."""
        out = copy(self)
        out.w = np.zeros_like(self.w)
        return out

    def prepare(self) -> None:
        """In a task: the table of known words, which isn't sent."""
        self.lookup = Lookup(self.hashes)

    def read(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens, their classes, the two classes before each (the nearer one first), and the rows of its three features."""
        number = self.lookup(t.hash)
        known = (number >= 0) & (number < self.frequent)
        cls = np.where(t.is_end, END_CLASS, np.where(known, t.group, GROUPS + t.group))
        before = np.full((2, len(cls)), START, np.int64)
        before[0, 1:] = cls[:-1]
        before[0, t.first] = START
        before[1, 1:] = before[0, :-1]
        before[1, t.first] = START
        one, two = t.before(1, [START1, START2]), t.before(2, [START1, START2])
        r = _U(self.rows)
        with np.errstate(over="ignore"):
            rows = np.stack([one % r, two % r + r, mix(one * _U(3) + two) % r + r + r], axis=1).astype(np.int64)
        return number, cls, before, rows

    def _logits(self, rows: np.ndarray) -> np.ndarray:
        """Logits of the classes less the largest one."""
        z = self.w.take(rows[:, 0], axis=0)
        z += self.w.take(rows[:, 1], axis=0)
        z += self.w.take(rows[:, 2], axis=0)
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        return z

    def log_softmax(self, rows: np.ndarray) -> np.ndarray:
        z = self._logits(rows)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def softmax(self, rows: np.ndarray) -> np.ndarray:
        z = self._logits(rows)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def observe(self, texts: pa.Array, sums: dict[str, np.ndarray]) -> None:
        """Add up what the word factor learns from: words after each class and after each class but one, and runs of three classes."""
        number, cls, before, _ = self.read(Tokens(texts))
        mine = (number >= 0) & (number < self.frequent)
        words = self.own.size
        for j in range(2):
            np.add.at(sums[f"after{j}"], before[j][mine] * words + number[mine], 1)
        sums["runs"] += np.bincount((cls * (CLASSES + 1) + before[0]) * (CLASSES + 1) + before[1], minlength=sums["runs"].size)

    def gradient(self, rows: np.ndarray, cls: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind of feature: the rows that occur, and the gradient of the negative log probability of the classes for each."""
        error = self.softmax(rows)
        error[np.arange(len(cls)), cls] -= 1
        by_class = error.T.astype(np.float64)
        out = []
        for j in range(3):
            of_kind = rows[:, j] - j * self.rows
            used = np.flatnonzero(np.bincount(of_kind, minlength=self.rows))
            number = np.empty(self.rows, np.int64)
            number[used] = np.arange(len(used))
            at = number[of_kind]
            sums = np.empty((CLASSES, len(used)), np.float32)
            for c in range(CLASSES):
                sums[c] = np.bincount(at, by_class[c], len(used))
            out.append((used + j * self.rows, np.ascontiguousarray(sums.T)))
        return out

    def learn(self, texts: pa.Array, past: np.ndarray, met: np.ndarray) -> None:
        """Adaptive gradient steps over the tokens, a batch at a time; met counts how often each row occurs."""
        _, cls, _, rows = self.read(Tokens(texts))
        met += np.bincount(rows.ravel(), minlength=len(met))
        for at in range(0, len(cls), CHUNK):
            for r, g in self.gradient(rows[at : at + CHUNK], cls[at : at + CHUNK]):
                seen = past.take(r, axis=0)
                seen += g * g
                past[r] = seen
                np.sqrt(seen, out=seen)
                g /= seen
                g *= np.float32(self.s.rate)
                w = self.w.take(r, axis=0)
                w -= g
                self.w[r] = w

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Sums for each text, but for the counts of tokens that aren't sent; those tokens and how often each occurs."""
        t = Tokens(texts)
        number, cls, before, rows = self.read(t)
        log_p = np.empty(len(number))
        for at in range(0, len(number), CHUNK):
            z = self.log_softmax(rows[at : at + CHUNK])
            log_p[at : at + CHUNK] = z[np.arange(len(z)), cls[at : at + CHUNK]]
        sent = number >= 0
        own = np.zeros(len(number))
        own[sent] = np.log10(self.counts[number[sent]] + 1.0)
        mine = sent & (number < self.frequent)
        w, (b1, b2) = number[mine], before[:, mine]
        log_p[mine] += self.own[w] + self.after[0, b1, w] + self.after[1, b2, w] - self.log_sum[cls[mine], b1, b2]
        log_p /= np.log(10)
        other = ~mine & ~t.is_end
        log_p[other] += own[other] - self.log_tail[cls[other] - GROUPS]
        n = t.n_texts
        add = lambda x: np.bincount(t.text, weights=x, minlength=n)
        size = np.bincount(t.text, minlength=n)
        rare = np.flatnonzero(~sent)
        order = rare[np.lexsort((t.hash[rare], t.text[rare]))]
        text, h = t.text[order], t.hash[order]
        cut = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(order) else order
        return {
            "n_tokens": size,
            "n_known": add(sent.astype(float)).astype(np.int64),
            "base_score": add(own) - size * np.log10(self.n + self.v + 1.0),
            "score": add(log_p),
            "rare": h[cut].view(np.int64),
            "times": np.diff(np.append(cut, len(order))),
            "of": text[cut],
        }


def fit_words(own: np.ndarray, after: np.ndarray, runs: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the words of one class after each class and after each class but one, and the logs of the normalising sums.

    own: logs of the words' shares. after: how often each word (column) follows each class (row), at both distances. runs: how
    often the class follows each two classes. Steps go along the gradient, each weight's divided by how often it is expected.
    """
    contexts = np.stack(np.nonzero(runs), axis=1)
    times = runs[contexts[:, 0], contexts[:, 1]].astype(np.float32)
    w = np.zeros(after.shape, np.float32)
    starts = [np.argsort(contexts[:, j], kind="stable") for j in range(2)]
    for _ in range(s.steps if len(contexts) else 0):
        z = own.astype(np.float32) + w[0, contexts[:, 0]] + w[1, contexts[:, 1]]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z *= (times / z.sum(axis=1))[:, None]
        largest = 0.0
        for j in range(2):
            c = contexts[starts[j], j]
            cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            expected = np.zeros(after.shape[1:], np.float32)
            expected[c[cut]] = np.add.reduceat(z[starts[j]], cut, axis=0)
            gradient = after[j] - expected - s.prior * w[j]
            step = np.clip(0.5 * gradient / (expected + s.prior), -2, 2)
            w[j] += step
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-3:
            break
    log_sum = np.zeros(runs.shape, np.float32)
    for a in range(runs.shape[0]):
        z = own + w[0, a] + w[1]
        high = z.max(axis=1)
        log_sum[a] = high + np.log(np.exp(z - high[:, None]).sum(axis=1))
    return w, log_sum


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> list[tuple[np.ndarray, ...]]:
        h, g, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h, g, c = h[order], g[order], c[order]
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return [(h[cut], g[cut], np.add.reduceat(c, cut))]

    for batch in batches:
        for part in slices(batch, "text"):
            t = Tokens(part.column("text"))
            h, at, c = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((h, t.group[at].astype(np.int8), c))
            if len(held) >= 32:
                held = merged()
                if len(held[0][0]) > 1_000_000:
                    yield _count_rows(held.pop())
    if held:
        yield _count_rows(merged()[0])


def _count_rows(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2], pa.int64())], names=["h", "g", "c"])


def _sum(bodies: Iterator[bytes]) -> bytes:
    total = np.zeros(0)
    for b in bodies:
        x = np.frombuffer(b, np.float32)
        total = x.astype(np.float64) if not len(total) else total + x
    return total.astype(np.float32).tobytes()


def _combined(parts: DataFrame, tasks: int, combine: Callable[[Iterator[bytes]], bytes]) -> list[tuple[str, bytes]]:
    """(k, body) by block of what tasks give out as rows (k, block, part, body), combined FAN_IN tasks at a time; BLOCKS rows for each k come back."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"k": table["k"].slice(0, 1), "block": table["block"].slice(0, 1), "part": table["part"].slice(0, 1), "body": pa.array([combine(b.as_py() for b in table["body"])], pa.binary())})

    while True:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(tasks)).cast("int")).groupBy("k", "block", "part").applyInArrow(run, PARTS)
        if tasks <= 1:
            break
    return [(r["k"], r["body"]) for r in sorted(parts.collect(), key=lambda r: (r["k"], r["block"]))]


def _added(parts: DataFrame, tasks: int) -> dict[str, np.ndarray]:
    """Sums of the arrays that tasks give out."""
    out: dict[str, list] = {}
    for k, body in _combined(parts, tasks, _sum):
        out.setdefault(k, []).append(np.frombuffer(body, np.float32))
    return {k: np.concatenate(x) for k, x in out.items()}


PARTS = "k string, block int, part int, body binary"


def _in_blocks(k: str, x: np.ndarray, part: int) -> pa.RecordBatch:
    cut = np.array_split(x.astype(np.float32).ravel(), BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array([k] * BLOCKS), pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array([p.tobytes() for p in cut], pa.binary())], names=["k", "block", "part", "body"])


def _train_classes(rows: DataFrame, tasks: int, model: Model) -> None:
    """One round: steps in every task from the same weights, then averages of the rows by how often each task met them."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.prepare()
        model.w = model.w.copy()
        past, met, part = np.full(model.w.shape, model.s.settled, np.float32), np.zeros(len(model.w)), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                part = piece.column("part")[0].as_py()
                model.learn(piece.column("text"), past, met)
        del past
        bodies = [_packed(w, m) for w, m in zip(np.array_split(model.w, BLOCKS), np.array_split(met, BLOCKS), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(["w"] * BLOCKS), pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array(bodies, pa.binary())], names=["k", "block", "part", "body"])

    found = [_unpacked(b) for _, b in _combined(rows.mapInArrow(run, PARTS), tasks, _average)]
    if found:
        w, met = (np.concatenate(x) for x in zip(*found, strict=True))
        model.w[met > 0] = w[met > 0]


def _packed(w: np.ndarray, met: np.ndarray) -> bytes:
    """Weights of rows in half precision, and how often each row was met."""
    return met.astype(np.float32).tobytes() + w.astype(np.float16).tobytes()


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(body) // (4 + 2 * CLASSES)
    return np.frombuffer(body, np.float16, offset=4 * n).reshape(n, CLASSES).astype(np.float32), np.frombuffer(body, np.float32, n)


def _average(bodies: Iterator[bytes]) -> bytes:
    """Averages of rows by how often each was met."""
    total = met = np.zeros(0, np.float32)
    for b in bodies:
        w, m = _unpacked(b)
        total, met = (w * m[:, None], m) if not len(met) else (total + w * m[:, None], met + m)
    return _packed(total / np.maximum(met, 1)[:, None], met)


def _train_words(rows: DataFrame, tasks: int, model: Model) -> None:
    """Counts over all texts, then a task for each class of frequent words."""
    what = {"after0": model.after[0].size, "after1": model.after[1].size, "runs": model.log_sum.size}
    bare = model.without_weights()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare.prepare()
        sums, part = {k: np.zeros(n, np.float32 if k != "runs" else np.int64) for k, n in what.items()}, 0
        for batch in batches:
            for piece in slices(batch, "text"):
                part = piece.column("part")[0].as_py()
                bare.observe(piece.column("text"), sums)
        for k, x in sums.items():
            yield _in_blocks(k, x, part)

    found = _added(rows.mapInArrow(run, PARTS), tasks)
    if not found or not model.frequent:
        return
    after = np.stack([found[f"after{j}"].reshape(CLASSES + 1, -1) for j in range(2)])
    runs = found["runs"].reshape(model.log_sum.shape)
    whole = np.bincount(model.word_class, weights=model.counts[: model.frequent] + 1.0, minlength=CLASSES)
    model.own[: model.frequent] = np.log((model.counts[: model.frequent] + 1.0) / whole[model.word_class])
    of = [(c, np.flatnonzero(model.word_class == c)) for c in range(GROUPS)]
    of = [(c, at) for c, at in of if len(at)]
    if not of:
        return
    body = lambda x: np.ascontiguousarray(x, np.float32).tobytes()
    table = pa.table({"c": pa.array([c for c, _ in of], pa.int32()), "own": [body(model.own[at]) for _, at in of], "after": [body(after[:, :, at]) for _, at in of], "runs": [body(runs[c]) for c, _ in of]})
    s = model.s

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = np.frombuffer(r["own"], np.float32)
                w, log_sum = fit_words(own, np.frombuffer(r["after"], np.float32).reshape(2, CLASSES + 1, len(own)), np.frombuffer(r["runs"], np.float32).reshape(CLASSES + 1, CLASSES + 1), s)
                yield pa.RecordBatch.from_arrays([pa.array([r["c"]], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([log_sum.tobytes()], pa.binary())], names=["c", "w", "log_sum"])

    classes = rows.sparkSession.createDataFrame(table).repartition(len(of), "c")  # GROUPS rows of bounded size
    for r in classes.mapInArrow(fit, "c int, w binary, log_sum binary").collect():
        at = next(at for c, at in of if c == r["c"])
        model.after[:, :, at] = np.frombuffer(r["w"], np.float32).reshape(2, CLASSES + 1, len(at))
        model.log_sum[r["c"]] = np.frombuffer(r["log_sum"], np.float32).reshape(CLASSES + 1, CLASSES + 1)


def least_count(counts: DataFrame, most: int, bins: int = 1_024) -> int:
    """The smallest c such that at most `most` rows of counts (c) have that or more: bins of counts, then bins of the one in question."""
    low, high, above = 1, int(counts.agg(F.coalesce(F.max("c"), F.lit(0)).alias("c")).head()["c"]) + 1, 0
    while low < high:
        width = -(-(high - low) // bins)
        found = counts.filter((F.col("c") >= low) & (F.col("c") < high)).groupBy(F.floor((F.col("c") - low) / width).alias("b")).agg(F.count("*").alias("n")).collect()  # bins rows
        fits = True
        for r in sorted(found, key=lambda r: -r["b"]):
            if above + r["n"] > most:
                low, high, fits = low + r["b"] * width, min(high, low + (r["b"] + 1) * width), False
                break
            above += r["n"]
        if fits:
            return low
        if high - low == 1:
            return high
    return low


def train(training: DataFrame, s: Settings = Settings()) -> tuple[Model, DataFrame, Column]:
    """The model of training texts (text, part), counts (h, g, c) of all their tokens, and which of these the model has itself.

    part: the number of the row's partition.
    """
    counts = training.mapInArrow(_counter, "h long, g byte, c long").groupBy("h").agg(F.first("g").alias("g"), F.sum("c").alias("c"))
    counts = written(counts, "counts")
    whole = counts.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # GROUPS rows
    n, v = sum(r["n"] for r in whole), sum(r["v"] for r in whole)
    in_model = (F.col("c") >= least_count(counts, s.sent)) | (F.col("h") == int(END.view(np.int64)))  # the end always has its own class
    sent = counts.filter(in_model).toArrow()  # s.sent rows and the end at most
    h, g, c = sent["h"].to_numpy().view(_U), sent["g"].to_numpy().astype(np.int64), sent["c"].to_numpy()
    order = np.lexsort((h, -c, h != END))
    h, g, c = h[order], g[order], c[order]
    ends = int(c[:1].sum()) if len(h) and h[0] == END else 0
    tail, share = np.ones(GROUPS), np.ones(CLASSES)
    for r in whole:
        tail[r["g"]] += r["n"] + r["v"]
        share[GROUPS + r["g"]] += r["n"]
    k = min(s.frequent, len(h))
    mine = np.flatnonzero(h[:k] != END)
    np.subtract.at(tail, g[mine], c[mine] + 1)
    if ends:
        tail[g[0]] -= ends + 1
        share[GROUPS + g[0]] -= ends
        share[END_CLASS] += ends
    np.add.at(share, g[mine], c[mine])
    np.subtract.at(share, GROUPS + g[mine], c[mine])
    model = Model(h, c, g, tail, share / share.sum(), n, v, s)
    tasks = int(training.agg(F.coalesce(F.max("part"), F.lit(0)).alias("p")).head()["p"]) + 1 if n else 1
    if n:
        for _ in range(s.rounds):
            _train_classes(training, tasks, model)
        _train_words(training, tasks, model)
    return model, counts, in_model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, s: Settings = Settings()) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Tokens are words parted by white space, A-Z as a-z, then one end. Rows whose fold is `held`
    are held out; the model learns from all others but those with a null id. base_score: the sum of
    log10((c + 1) / (N + V + 1)), c being the token's training count, N all of them and V the distinct
    tokens. score: the model's log10 probability of the text. n_known: tokens with c above 0. Null texts count as
    empty: their end alone is scored. Repeated rows are scored and counted each. Without any training rows the counts are 0.
    """
    rows = docs.select(F.col(id_col).alias("id"), no_text(text).alias("text"), F.coalesce(fold(id_col, folds) == held, F.lit(False)).alias("held_out"))
    training = rows.filter("NOT held_out AND id IS NOT NULL").select("text", F.spark_partition_id().alias("part"))
    model, counts, in_model = train(training, s)
    n = model.n

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.prepare()
        for batch in batches:
            for part in slices(batch, "text"):
                x = model.score(part.column("text"))
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(x["of"], minlength=part.num_rows))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x["rare"], pa.int64())), pa.ListArray.from_arrays(at, pa.array(x["times"], pa.int32()))]
                plain = [pa.array(x["n_tokens"], pa.int64()), pa.array(x["n_known"], pa.int64()), pa.array(x["base_score"]), pa.array(x["score"])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), *plain, *lists], names=names)

    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"]
    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    found = rare.join(counts.filter(~in_model), "h").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    out = scored.join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
