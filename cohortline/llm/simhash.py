"""Near-duplicate documents by SimHash: fingerprints, candidate blocks, a table of distances to reference fingerprints, components.

Two fingerprints that differ in few bits have nearly the same distance to any third one: by no more than those bits. Each task
works out the distances of its fingerprints to many fixed references (pivots), sorts by the first of them, and
discards every pair for which some distance differs by more; what survives all pivots is compared itself.

Which fingerprints meet in a task at all is settled by blocks of bits: with m blocks and at most d differing bits, m - d blocks
agree, so one row for each choice of m - d blocks brings every pair together at least once. m grows with the number of
different fingerprints, so such buckets stay small unless their members are alike. Equal fingerprints are one node from the
start. Large buckets are dealt into tiles, each pair of tiles to a task; a task gives out only as many links as join what it found joined.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Words, seeded, space_words, with_text_columns
from .tables import components, join_spread, often, written

SEED, SHINGLE, BITS = 42, 4, 4
PIVOTS = 32
#: Rows of a bucket that one task compares with each other, and rows of a pack of buckets.
TILE, PACK = 4096, 50_000
#: Pairs looked at together, and shingles whose bits are counted together.
CHUNK, STEP = 1 << 20, 1 << 16


def shingle_hashes(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all runs of k words of each text, joined by a space, and the text of each; fewer words, but not none, are one run."""
    words = Words(texts, space_words())
    n, size = len(words), words.ends - words.starts
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    at = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)  # each word's place among words parted by one space
    out = np.full(at[-1], 0x20, np.uint8)
    if n:
        i = np.arange(size.sum())
        before = np.concatenate([[0], np.cumsum(size)[:-1]])
        out[i + np.repeat(np.arange(n), size)] = table[words.data[i + np.repeat(words.starts - before, size)]]
    count = words.counts()
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    first = words.bounds[owner] + nth
    last = first + np.minimum(count[owner], k)
    body, hashed = out.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((hashed(body[s:e], SEED) for s, e in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)), np.uint64, len(owner)), owner


def fingerprints(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The bits that are set in over half of each text's hashes; 0 without any. owner is ascending."""
    counts = np.zeros((n, 64), np.int64)
    for at in range(0, len(hashes), STEP):
        own = owner[at : at + STEP]
        bits = np.unpackbits(hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts[own[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    most = 2 * counts > np.bincount(owner, minlength=n)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def with_simhash(df: DataFrame, text: str = "text", out: str = "simhash", k: int = SHINGLE) -> DataFrame:
    """df with the 64-bit fingerprint (long, the highest bit is its sign) of each whole text's k-word shingles, repeats included.

    Words are parted by white space, A-Z count as a-z. A text without words, also null, has 0. Rows keep their columns; one named like the output is replaced.
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda texts: [pa.array(fingerprints(*shingle_hashes(texts, k), len(texts)).view(np.int64))]

    return with_text_columns(df, text, [T.StructField(out, T.LongType())], make)


def block_masks(nodes: int, bits: int) -> list[int]:
    """Masks of which at least one is the same in two fingerprints that differ in at most so many bits.

    Blocks are as few as leave about sixteen other nodes at most in a bucket, were fingerprints random.
    """
    for m in range(bits + 2, 65):
        edges = [64 * i // m for i in range(m + 1)]
        if nodes <= 16 << ((64 // m) * (m - bits)) or m == 2 * bits:
            break
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    return [sum(c) for c in combinations(blocks, m - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(prints: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of fingerprints to the reference fingerprints, a row for each reference."""
    return np.stack([np.bitwise_count(prints ^ p) for p in seeded(pivots, 31)]).astype(np.int8)


def close_pairs(group: np.ndarray, prints: np.ndarray, bits: int, ok: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
    """Pairs of places of the same group whose fingerprints differ in at most so many bits, in chunks; ok says which pairs to look at.

    Within a group places are sorted by the distance to the first pivot, and partners lie within `bits` of it; the other
    pivots discard pairs one by one, before fingerprints are compared.
    """
    table = pivot_table(prints)
    key = group.astype(np.int64) * 256 + table[0]
    order = np.argsort(key, kind="stable")
    key, table, prints = key[order], table[:, order], prints[order]
    ends = np.searchsorted(key, key + bits, "right")
    width = ends - np.arange(1, len(key) + 1)  # partners after each place
    total = np.concatenate([[0], np.cumsum(width)])
    at = 0
    while at < len(key):
        to = max(int(np.searchsorted(total, total[at] + CHUNK, "right")) - 1, at + 1)
        a = np.repeat(np.arange(at, to), width[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[at:to] - total[at], width[at:to])
        if ok is not None:
            keep = ok(order[a], order[b])
            a, b = a[keep], b[keep]
        for row in table[1:]:
            if not len(a):
                break
            keep = np.abs(row[a] - row[b]) <= bits
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(prints[a] ^ prints[b]) <= bits
        yield order[a[keep]], order[b[keep]]
        at = to


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (of each node the smallest one it is joined with) after the links (a, b)."""
    while True:
        x, y = label[a], label[b]
        new = x != y
        if not new.any():
            return label
        a, b, x, y = a[new], b[new], x[new], y[new]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _joiner(bits: int) -> Callable[[pa.Table], pa.Table]:
    def compute(rows: pa.Table) -> pa.Table:
        mask, key, i, j, side, node, prints = (rows[c].to_numpy() for c in ("mask", "key", "i", "j", "side", "node", "simhash"))
        place = np.stack([mask, key, i, j])
        order = np.lexsort(place)
        new = np.append(True, (place[:, order[1:]] != place[:, order[:-1]]).any(axis=0))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new)
        names, at = np.unique(node, return_inverse=True)
        label = np.arange(len(names))

        def ok(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return ((side[a] != side[b]) | (side[a] == 2)) & (label[at[a]] != label[at[b]])

        for a, b in close_pairs(group, prints.view(np.uint64), bits, ok):
            label = _merge(label, at[a], at[b])
        joined = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": pa.array(names[label[joined]], pa.int64()), "b": pa.array(names[joined], pa.int64())})

    return compute


def close_links(nodes: DataFrame, bits: int = BITS, tile: int | None = None) -> DataFrame:
    """(a, b): links between nodes (node, simhash), distinct fingerprints, that join all that differ in at most so many bits; each such pair is linked or joined by links."""
    spark, tile = nodes.sparkSession, tile or TILE
    masks = block_masks(nodes.count(), bits)
    choice = F.explode(F.array(*[F.struct(F.lit(c).alias("mask"), F.col("simhash").bitwiseAND(F.lit(_signed(m))).alias("key")) for c, m in enumerate(masks)])).alias("k")
    keys = nodes.select("node", "simhash", choice).select("node", "simhash", "k.mask", "k.key")
    sizes = written(keys.groupBy("mask", "key").agg(F.count("*").alias("c")).filter("c > 1"), "buckets")
    many = often(sizes)
    q = F.ceil(F.col("c") / tile).cast("int")
    placed = join_spread(keys, sizes, ["mask", "key"], "node", many).withColumn("q", q).withColumn("t", F.pmod(F.xxhash64("node"), F.col("q")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    side = F.when(F.col("t") == F.col("o"), 2).when(F.col("t") < F.col("o"), 0).otherwise(1)
    placed = placed.select("mask", "key", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), side.alias("side"), "node", "simhash")
    rows = sizes.agg(F.coalesce(F.sum(F.col("c") * F.ceil(F.col("c") / tile)), F.lit(0)).alias("n")).head()["n"]
    packs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows) // PACK + 1)
    return placed.groupBy(F.pmod(F.xxhash64("mask", "key", "i", "j"), F.lit(packs)).alias("pack")).applyInArrow(_joiner(bits), "a long, b long").distinct()


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(id, simhash, component_id) for each row of docs.

    Rows whose fingerprints differ in at most so many bits are linked, those without words (null, empty or blank texts,
    fingerprint 0) like any other; component_id is the smallest id reachable by links, the row's own included. Rows that share an
    id should share their text; otherwise each has the component of its own fingerprint. A row whose id is null isn't linked and has a
    null component. Other columns aren't read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = written(with_simhash(docs, "text", k=k).drop("text"), "simhash")
    nodes = written(signed.filter("id IS NOT NULL").groupBy("simhash").agg(F.min("id").alias("node"), F.count("*").alias("c")), "prints")
    links = close_links(nodes.select("node", "simhash"), bits)
    found = components(links)
    of = nodes.join(found, "node", "left").select("simhash", "c", F.coalesce("component", "node").alias("component"))
    out = join_spread(signed.filter("id IS NOT NULL"), of.drop("c"), ["simhash"], "id", often(nodes.select("simhash", "c")))
    out = out.select("id", "simhash", "component").unionByName(signed.filter("id IS NULL").select("id", "simhash", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("id").alias(id_col), "simhash", F.col("component").alias("component_id"))


def hex_digits(c: str) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
