"""Sharding: a uniform shuffle into shards of exact sizes.

Every input partition learns how many of its rows go to every cell (a cell is a bounded
stretch of a shard). These counts are one draw of the multivariate hypergeometric
matrix, so that all permutations of the table are equally likely and every cell gets
exactly its share. Rows are permuted within their partition, dealt to cells by the
counts, exchanged once, and permuted again within their cell.

No task needs the whole matrix. The partitions are the leaves of a binary tree; each node
splits the counts of its parent between its two halves by hypergeometric draws whose
seed belongs to the node, so each task finds its own row of the matrix by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws without replacement are good: exact for populations of any size.

    Rejection under a flat top with exponential tails, which lies over every log-concave
    distribution whose mode has the probability that the top is scaled by.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    lg = math.lgamma
    whole = lg(good + 1) + lg(bad + 1) + lg(draws + 1) + lg(good + bad - draws + 1) - lg(good + bad + 1)

    def log_p(k: int) -> float:
        return whole - lg(k + 1) - lg(good - k + 1) - lg(draws - k + 1) - lg(bad - draws + k + 1)

    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    at_mode = math.exp(log_p(mode))
    half = 1 + at_mode / 2
    while True:
        if rng.random() <= half / (1 + half):
            y, height = rng.random() * half / at_mode, 1.0
        else:
            e = rng.standard_exponential()
            y, height = (half + e) / at_mode, math.exp(-e)
        k = mode + int(math.floor(y + 0.5)) * (1 if rng.random() < 0.5 else -1)
        if low <= k <= high and rng.random() * height <= math.exp(log_p(k) - math.log(at_mode)):
            return k


def draw_many(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Independent draws: those from populations that numpy takes at once, larger ones one by one."""
    out = np.zeros(len(good), np.int64)
    small = np.maximum(good, bad) < 10**9
    out[small] = rng.hypergeometric(good[small], bad[small], draws[small])
    for i in np.flatnonzero(~small).tolist():
        out[i] = draw_hypergeometric(rng, int(good[i]), int(bad[i]), int(draws[i]))
    return out


def split_counts(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw from rows of several kinds: from halves of the kinds, then halves of these, and so on."""
    levels = [np.pad(counts, (0, (1 << max(len(counts) - 1, 0).bit_length()) - len(counts)))]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][::2] + levels[-1][1::2])
    want = np.array([draws], np.int64)
    for level in reversed(levels[:-1]):
        left = draw_many(rng, level[::2], level[1::2], want)
        want = np.stack([left, want - left], axis=1).ravel()
    return want[: len(counts)]


def matrix_row(rows: np.ndarray, cells: np.ndarray, at: int, seed: int) -> np.ndarray:
    """The counts of partition `at` for all cells: its row of the communication matrix."""
    total = np.concatenate([[0], np.cumsum(rows)])
    low, high, counts = 0, len(rows), cells
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = split_counts(rng, counts, int(total[mid] - total[low]))
        low, high, counts = (low, mid, left) if at < mid else (mid, high, counts - left)
    return counts


def cell_sizes(n_rows: int, n_shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each cell and the cells before each shard; shards differ by one row at most."""
    sizes, starts = [], [0]
    for s in range(n_shards):
        rows = n_rows // n_shards + (s < n_rows % n_shards)
        n = max(1, -(-rows // cell_rows))
        sizes += [rows // n + (i < rows % n) for i in range(n)]
        starts.append(len(sizes))
    return np.array(sizes, np.int64), np.array(starts, np.int64)


def shuffle_to_shards(df: DataFrame, n_shards: int, seed: int = 0, cell_rows: int = 20_000, min_cells: int = 8) -> DataFrame:
    """df with `shard` (int, from 0) and `slot` (long, gapless from 0 within a shard).

    All rows are kept, repeated ones and those with nulls too. Shard sizes differ by one
    at most, for any number of rows; an empty table gives no rows. Columns of df named
    shard or slot are replaced. The order of rows in a partition doesn't matter, as they
    are sorted by a hash of their contents first; the rows that a partition holds must be
    the same whenever it is computed, as they are for files and checkpoints. A task that
    finds another number of rows than was counted fails.
    cell_rows: rows of a cell at most; a shard has min_cells of them at least, if it has rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    df = df.drop("shard", "slot")
    own = df.columns
    counted = df.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one number for each partition
    rows = np.zeros(max((r["p"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        rows[r["p"]] = r["count"]
    n_rows = int(rows.sum())
    cell_rows = max(1, min(cell_rows, n_rows // (n_shards * min_cells)))
    cells, starts = cell_sizes(n_rows, n_shards, cell_rows)
    before = np.concatenate([[0], np.cumsum(cells)])
    shard_of = np.repeat(np.arange(n_shards, dtype=np.int32), np.diff(starts))
    offset = before[:-1] - before[starts[shard_of]] if n_rows else np.zeros(len(cells), np.int64)

    @F.pandas_udf("cell int, shard int, offset long")
    def deal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        upto, seen, at = None, 0, -1
        for p, i in batches:
            if upto is None and len(p):
                at = int(p.iloc[0])
                upto = np.cumsum(matrix_row(rows, cells, at, seed))
                if upto[-1] != rows[at]:
                    raise RuntimeError("the counts of a partition don't add up")
            if upto is not None and len(i) and int(i.iloc[-1]) >= upto[-1]:
                raise RuntimeError(f"partition {at} has more rows than were counted; checkpoint the input first")
            cell = np.searchsorted(upto, i.to_numpy(), "right") if len(i) else np.zeros(0, np.int64)
            seen += len(i)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "shard": shard_of[cell], "offset": offset[cell]})
        if upto is not None and seen != upto[-1]:
            raise RuntimeError(f"partition {at} has fewer rows than were counted; checkpoint the input first")

    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in own])
    dealt = (
        df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("r"), key.alias("k"))
        .sortWithinPartitions("k")
        .select("r", "k", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"))
        .select("r", "k", deal("p", "i").alias("to"))
        .select("r", "to.*", F.xxhash64(F.lit(seed + 1), "k").alias("k"))
    )
    place = F.row_number().over(Window.partitionBy("cell").orderBy("k")) - 1
    return dealt.select("r", "shard", (F.col("offset") + place).alias("slot")).select("r.*", "shard", "slot")
