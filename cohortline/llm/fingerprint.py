"""Document fingerprints by consistent weighted sampling.

Every term of a text has a weight, how often it occurs. For each coordinate a term draws
r and c from Gamma(2, 1) and b from the unit interval; t = floor(log(weight) / r + b) and
log(a) = log(c) - r * (t - b + 1). The term with the smallest a and its t are the sample of the
coordinate. Two texts have the same sample with a probability of their generalised
Jaccard similarity, sum of smaller weights over sum of larger ones.

The draws stand in a fixed pool; a hash of the term and the coordinate says which one it takes,
so all texts agree on them and drawing costs a look-up.

Terms are 5-word shingles for texts of every length (white space parts words, A-Z count as a-z; fewer words are
one term). Each code point of a script without spaces is a word, and so is each one of a word
of over 64 bytes. That rule looks at a word alone, so equal passages have equal terms in all texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import SLICE_BYTES, Words, mix, slices, space_words, tidied, with_text_columns

_U = np.uint64
COORDINATES = 128
POOL_BITS = 18
LONGEST = 64
BLOCK = 4096


class Sampler:
    """The pool of draws and the samples of weighted terms."""

    def __init__(self, coordinates: int = COORDINATES, seed: int = 41):
        rng = np.random.default_rng(seed)
        n = 1 << POOL_BITS
        self.k = np.arange(coordinates, dtype=np.uint32)[:, None]
        self.r = rng.gamma(2, 1, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.b = rng.random(n, np.float32)
        self.single = self.log_c - self.r * (1 - self.b)  # log(a) for the weight 1

    def samples(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 16-bit sample for each coordinate; without terms all are 0."""
        if not len(terms):
            return np.zeros(len(self.k), np.uint16)
        first, step = terms.astype(np.uint32), (terms >> _U(32)).astype(np.uint32) | np.uint32(1)
        least = np.full(len(self.k), np.inf, np.float32)
        pick, steps = np.zeros(len(self.k), _U), np.zeros(len(self.k), np.int64)
        for at in range(0, len(terms), BLOCK):
            f, s, w = first[at : at + BLOCK], step[at : at + BLOCK], weights[at : at + BLOCK]
            place = f + self.k * s  # mixed, so that no two terms share their draws in a row
            place ^= place >> np.uint32(15)
            place *= np.uint32(0x2C1B3C6D)
            place ^= place >> np.uint32(12)
            place >>= np.uint32(32 - POOL_BITS)
            a = self.single[place]
            many = np.flatnonzero(w > 1)
            if len(many):
                sub = place[:, many]
                r, b = self.r[sub], self.b[sub]
                t = np.floor(np.log(w[many]).astype(np.float32) / r + b)
                a[:, many] = self.log_c[sub] - r * (t - b + 1)
            best = a.argmin(axis=1)
            rows = np.arange(len(best))
            better = a[rows, best] < least
            least = np.where(better, a[rows, best], least)
            pick = np.where(better, terms[at + best], pick)
            p = place[rows, best]
            steps = np.where(better, np.floor(np.log(w[best]).astype(np.float32) / self.r[p] + self.b[p]).astype(np.int64), steps)
        with np.errstate(over="ignore"):
            return mix(pick + steps.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1)).astype(np.uint16)


def weighted_terms(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The terms of each text, in ascending order, with their weights."""
    hashes, owner = Words(pa.array(texts, pa.string()), space_words(), longest=LONGEST).shingles(5)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        yield np.unique(hashes[ends[i] : ends[i + 1]], return_counts=True)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < SLICE_BYTES // 2):
            size += len(texts[to])
            to += 1
        yield texts[at:to]
        at = to


def fingerprint_texts(texts: list[str], sampler: Sampler) -> np.ndarray:
    """A row of samples for each text."""
    rows = [sampler.samples(*x) for g in _groups(texts) for x in weighted_terms(g)]
    return np.array(rows, np.uint16).reshape(len(texts), len(sampler.k))


def as_hex(samples: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in samples]


def add_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", coordinates: int = COORDINATES) -> DataFrame:
    """df with the fingerprint (hex, 4 digits a coordinate) of each whole text; null counts as empty."""

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        sampler = Sampler(coordinates)
        return lambda texts: [pa.array(as_hex(fingerprint_texts([t or "" for t in texts.to_pylist()], sampler)), pa.string())]

    return with_text_columns(df, text, [T.StructField(out, T.StringType())], make)


def likeness(a: str, b: str):
    """The share of coordinates in which two fingerprint columns agree (double); null if one is null."""
    n = F.length(a) / 4
    same = F.expr(f"size(filter(sequence(0, CAST(length(`{a}`) / 4 AS INT) - 1), i -> substr(`{a}`, 4 * i + 1, 4) = substr(`{b}`, 4 * i + 1, 4)))")
    return same / n


#: Ranges of ids at most; a number and an id of each pass through the driver.
RANGES = 20_000


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part_chars: int = 16_000_000, coordinates: int = COORDINATES) -> DataFrame:
    """Fingerprints of each document and of its edited text, held against each other and the next document's.

    The edited text: the last half of the code points (rounded down) replaced by the first as
    many of the next document by ascending id, or all if it has fewer; the first document follows the
    last one. Returns the id, n_chars (long), edited_sha256 (of its UTF-8 bytes), fingerprint, edited_fingerprint, near_edited and near_next.
    Null texts count as empty; empty and blank texts have equal fingerprints, of zeros. Null ids come first; rows
    of one id follow each other by their texts. One document alone is followed by itself. No rows give none.

    Documents are dealt to ranges of ids of about part_chars characters (RANGES of them at most), in one shuffle; the first
    of each range goes to the range before it too. A task reads its ranges in order and holds a slice of them at a time.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(-(1 << 63)))
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).head()
    parts = max(1, min(size["n"], -(-size["c"] // part_chars), RANGES))
    ids = docs.select(key.alias("key"))
    splits = np.unique(np.array(ids.withColumn("d", F.col("key").cast("double")).approxQuantile("d", [i / parts for i in range(1, parts)], max(0.2 / parts, 1e-5)), np.float64)) if parts > 1 else np.zeros(0)
    splits = np.sort(splits).astype(np.int64)

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, k.to_numpy(), "right").astype(np.int32))

    firsts = {r["p"]: r["k"] for r in ids.groupBy(part_of("key").alias("p")).agg(F.min("key").alias("k")).collect()}  # one row for each range
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        p = np.searchsorted(splits, k.to_numpy(), "right")
        return pd.Series([[x, -1 - before[x]] if firsts[x] == y else [x] for x, y in zip(p.tolist(), k.tolist(), strict=True)])

    dealt = docs.withColumn("to", F.explode(places(key))).select("id", "text", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part"), (F.col("to") < 0).alias("guest"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("id").asc_nulls_first(), "text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(coordinates)
        held: tuple[int, int | None, str, np.ndarray] | None = None  # the last row seen that has no next one yet
        for batch in batches:
            for piece in slices(batch, "text"):
                part, guest, ids, texts = (piece.column(c).to_pylist() for c in ("part", "guest", "id", "text"))
                new = fingerprint_texts(texts, sampler)
                rows, edited = [], []
                for i, t in enumerate(texts):
                    if held is not None and held[0] == part[i]:
                        u = held[2]
                        rows.append((held[1], len(u), held[3], new[i]))
                        edited.append(u[: len(u) - len(u) // 2] + t[: len(u) // 2])
                        held = None
                    if not guest[i]:
                        held = (part[i], ids[i], t, new[i])
                if rows:
                    yield _compared(rows, edited, sampler, id_col)

    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("part", "guest", "id", "text").mapInArrow(run, schema)


def _compared(rows: list[tuple[int | None, int, np.ndarray, np.ndarray]], edited: list[str], sampler: Sampler, id_col: str) -> pa.RecordBatch:
    """Output rows from (id, code points, fingerprint, the next one's) and the edited texts."""
    changed = fingerprint_texts(edited, sampler)
    own, following = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    columns = {
        id_col: pa.array([r[0] for r in rows], pa.int64()),
        "n_chars": pa.array([r[1] for r in rows], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array(as_hex(own), pa.string()),
        "edited_fingerprint": pa.array(as_hex(changed), pa.string()),
        "near_edited": pa.array((own == changed).mean(axis=1), pa.float64()),
        "near_next": pa.array((own == following).mean(axis=1), pa.float64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
