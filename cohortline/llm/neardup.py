"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has a fixed number of coordinates (bins). In each of the first rounds every
shingle is thrown into one hashed bin; in the same number of later rounds every shingle is
thrown into the one bin that is the round's own, so that no bin stays empty. A bin keeps its
smallest value, and values of earlier rounds are smaller than those of later ones. Two
sketches agree in a coordinate with the Jaccard similarity as probability, and as all
coordinates of one round share the throws, the agreement is concentrated about it.

Equal sets are one node from the start. Nodes whose sketches agree in a band meet in
a bucket. Instead of all pairs of a bucket, its members are first compared with its hub, the
member that meets the most others over all bands (where copies were made of one original,
that is the original). Members of buckets that confirmed links leave unconnected are then
compared pair by pair, unless they are connected already: in groups of nodes that such buckets
join, large groups tile by tile, a few pairs of tiles in a task that gives out only links it
has confirmed. Tiles of a group's largest component aren't paired with each other. A link counts if the
full shingle sets confirm it by two independent hashes, so the components are those of all links between texts that share a band.

Joins in which one key may have a large share of the rows deal it over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Words, list_array, mix, seeded, slices, space_words, tidied, with_text_columns
from .tables import components, join_spread, often, rows_with, written

_U = np.uint64
BANDS, ROWS = 32, 5
TILE = 512


def sketches(hashes: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The sketch of each of n sets, given as distinct hashes with their owners; empty sets have no value below the maximum."""
    out = np.full(n * bins, np.iinfo(np.uint64).max, _U)
    seeds = seeded(2 * bins, 11)
    low = _U((1 << 48) - 1)
    for i in range(2 * bins):
        if not len(hashes):
            break
        with np.errstate(over="ignore"):
            h = mix(hashes + seeds[i])
        own = owner * bins
        place = own + ((h >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64) if i < bins else own + (i - bins)
        np.minimum.at(out, place, (h & low) | _U(i << 48))
        open_ = (out.reshape(n, bins) == np.iinfo(np.uint64).max).any(axis=1)[owner]
        hashes, owner = hashes[open_], owner[open_]
    return out.reshape(n, bins)


def distinct_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, hashes of the same shingles by another seed, and their texts."""
    hashes, owner = words.shingles(k)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], words.shingles(k, 1)[0][order[new]], owner[new]


def similar(one: np.ndarray, other: np.ndarray, per_cent: int) -> bool:
    """Whether 100 * intersection >= per_cent * union, for distinct values."""
    low, high = sorted((len(one), len(other)))
    if 100 * low < per_cent * high or not low:
        return False
    both = low + high - len(np.union1d(one, other))
    return 100 * both >= per_cent * (low + high - both)


def _signer(k: int) -> Callable:
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        salt = seeded(BANDS + 2, 23)

        def compute(texts: pa.Array) -> list[pa.Array]:
            n = len(texts)
            words = Words(texts, space_words())
            hashes, others, owner = distinct_shingles(words, k)
            sizes = np.bincount(owner, minlength=n)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            keys = []
            for h, s in ((hashes, salt[0]), (others, salt[1])):
                with np.errstate(over="ignore"):
                    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ s), dtype=_U)])
                    keys.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
            m = sketches(hashes, owner, n, BANDS * ROWS)
            bands = np.empty((n, BANDS), _U)
            for b in range(BANDS):
                key = np.full(n, salt[b + 2], _U)
                for j in range(ROWS):
                    with np.errstate(over="ignore"):
                        key = mix(key + m[:, b * ROWS + j])
                bands[:, b] = key
            some = sizes > 0
            flat = bands[some].view(np.int64).ravel()
            return [
                pa.array(sizes, pa.int64()),
                pa.array(keys[0], pa.int64()),
                pa.array(keys[1], pa.int64()),
                list_array(flat, some * BANDS, pa.int64()),
            ]

        return compute

    return make


FIELDS = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("s1", T.LongType()),
    T.StructField("s2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
]


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Pairs (a, b) of ids whose full sets have 100 * intersection >= per_cent * union."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = rows_with(docs, ids, "id").dropDuplicates(["id"])
    many = often(pairs.groupBy("a").agg(F.count("*").alias("c")))
    joined = join_spread(pairs, texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), ["a"], "b", many).join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        one, two, owner = distinct_shingles(Words(texts, space_words()), k)
        ends = np.searchsorted(owner, np.arange(1, len(texts)))
        return list(zip(np.split(one, ends), np.split(two, ends), strict=True))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, tuple[np.ndarray, np.ndarray]] = (None, (np.zeros(0, _U),) * 2)
        for batch in batches:
            for part in slices(batch, "tb"):
                a, ta = part.column("a").to_pylist(), part.column("ta")
                ok = []
                for i, other in enumerate(sets(part.column("tb"))):
                    if known[0] != a[i]:
                        known = (a[i], sets(ta.slice(i, 1))[0])
                    if all(similar(x, y, per_cent) for x, y in zip(known[1], other, strict=True)):
                        ok.append(i)
                ok = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("a").take(ok), part.column("b").take(ok)], names=["a", "b"])

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, pairs.select("a", "b").schema)


def _settler(k: int, per_cent: int) -> Callable:
    def compute(rows: pa.Table) -> pa.Table:
        """Links between components within each pair of tiles, as many as join what can be joined."""
        sets: list[np.ndarray] = []
        others: list[np.ndarray] = []
        for batch in rows.select(["text"]).to_batches():
            for part in slices(batch, "text"):
                one, two, owner = distinct_shingles(Words(part.column("text"), space_words()), k)
                ends = np.searchsorted(owner, np.arange(1, part.num_rows))
                sets += np.split(one, ends)
                others += np.split(two, ends)
        node, comp, side = (rows[c].to_numpy() for c in ("node", "component", "side"))
        place = np.stack([rows[c].to_numpy() for c in ("g", "i", "j")])
        order = np.lexsort((node, *place[::-1]))
        cuts = np.flatnonzero(np.append(True, (place[:, order[1:]] != place[:, order[:-1]]).any(axis=0)))
        links: list[tuple[int, int]] = []
        for own in np.split(order, cuts[1:]):
            links += _join(node[own], comp[own], side[own], [sets[i] for i in own], [others[i] for i in own], per_cent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return compute


def _join(node: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], others: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    names, root = np.unique(comp, return_inverse=True)  # root: the number of each row's component so far
    sizes = np.array([len(x) for x in sets])
    words, codes = np.unique(np.concatenate(sets), return_inverse=True)
    right = np.flatnonzero(side != 0)
    ends = np.cumsum(sizes)
    of_right = np.concatenate([codes[ends[i] - sizes[i] : ends[i]] for i in right]) if len(right) else codes[:0]
    starts = np.concatenate([[0], np.cumsum(sizes[right])[:-1]]).astype(np.int64)
    mark = np.zeros(len(words), np.int32)
    links = []
    for i in np.flatnonzero(side != 1).tolist():
        near = (root[right] != root[i]) & (100 * np.minimum(sizes[right], sizes[i]) >= per_cent * np.maximum(sizes[right], sizes[i]))
        if not near.any():
            continue
        mine = codes[ends[i] - sizes[i] : ends[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[of_right], starts)
        mark[mine] = 0
        for j in right[near & (100 * both >= per_cent * (sizes[right] + sizes[i] - both))].tolist():
            if root[j] != root[i] and similar(others[i], others[j], per_cent):
                root[root == root[j]] = root[i]
                links.append((int(node[i]), int(node[j])))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, per_cent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Words are parted by white space, A-Z count as a-z. A row's set is its distinct k-word
    shingles; with fewer words the whole sequence is its one shingle; null, empty and blank texts
    have no shingles, are linked with nothing and are kept. component_id is the smallest id
    reachable by links, the row's own included; kept says whether that is its own. Rows that
    share an id should share their text; otherwise any of its texts confirms links. A row whose id is null isn't
    linked, has a null component and is kept. per_cent: links from this similarity on; the bands are
    laid out for 80 and more (a pair at 0.80 shares no band three times in a million, one at 0.85 once in a hundred million). An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = written(with_text_columns(docs, "text", FIELDS, _signer(k)).drop("text"), "signed")
    full = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    sets = written(full.groupBy("s1", "s2").agg(F.min("id").alias("node"), F.count("*").alias("c")), "sets")
    nodes = full.join(sets.select(F.col("node").alias("id"), "s1", "s2"), ["id", "s1", "s2"], "left_semi").dropDuplicates(["id"])
    keys = nodes.select(F.col("id").alias("node"), F.explode("bands").alias("key"))
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "sizes")
    many = often(sizes)
    members = written(join_spread(keys, sizes, ["key"], "node", many), "members")
    weight = members.groupBy("node").agg(F.sum("c").alias("w"))
    hubs = members.join(weight, "node").groupBy("key").agg((-F.max(F.struct("w", (-F.col("node")).alias("n")))["n"]).alias("hub"))
    star = join_spread(members, hubs, ["key"], "node", many).filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    texts = docs.filter("id IS NOT NULL")
    links = written(_confirm(star, texts, k, per_cent), "links")
    found = components(links)

    labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("first")).filter("lo <> hi").select("key", "first")
    rest = join_spread(members, split, ["key"], "node", many).join(found, "node", "left")
    rest = written(rest.select("node", F.coalesce("component", "node").alias("component"), "first").distinct(), "rest")
    groups = written(components(rest.select(F.col("node").alias("a"), F.col("first").alias("b"))), "groups").withColumnRenamed("component", "g")
    groups = groups.unionByName(groups.select(F.col("g").alias("node"), "g")).distinct()  # the smallest node is in its group too
    grouped = written(rest.select("node", "component").distinct().join(groups, "node"), "grouped")
    tiles = written(_tiles(grouped), "tiles")
    rows = tiles.agg(F.coalesce(F.sum(F.col("most") * (F.col("q") - F.col("p")) + (F.col("all") - F.col("most")) * F.col("q")), F.lit(0)).alias("n")).head()["n"]
    many = often(tiles.select("g", F.col("all").alias("c")))
    placed = join_spread(grouped, tiles, ["g"], "node", many).withColumn("in_main", F.col("component") == F.col("main")).withColumn("h", F.xxhash64("node"))
    own = F.when(F.col("in_main"), F.pmod("h", F.col("p"))).otherwise(F.col("p") + F.pmod("h", F.col("q") - F.col("p")))
    placed = placed.withColumn("t", own.cast("int")).withColumn("o", F.explode(F.sequence(F.when(F.col("in_main"), F.col("p")).otherwise(0), F.col("q") - 1)))
    side = F.when(F.col("t") == F.col("o"), 2).when(F.col("t") < F.col("o"), 0).otherwise(1)
    placed = placed.select("g", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), side.alias("side"), "node", "component")
    involved = rows_with(texts, rest.select(F.col("node").alias("id")).distinct(), "id").dropDuplicates(["id"]).withColumnRenamed("id", "node")
    packs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows) // (2 * TILE) + 1)  # about a pair of tiles each
    settled = placed.join(involved, "node").groupBy(F.pmod(F.xxhash64("g", "i", "j"), F.lit(packs)).alias("pack")).applyInArrow(_settler(k, per_cent), "a long, b long")
    links = written(links.unionByName(settled), "links")
    found = components(links)

    of_set = sets.join(found, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    plain = signed.select("id", "n_shingles", "s1", "s2")
    many = often(sets.select("s1", "s2", "c"))
    out = join_spread(plain.filter("n_shingles > 0 AND id IS NOT NULL"), of_set, ["s1", "s2"], "id", many).select("id", "n_shingles", F.least("component", "id").alias("component_id"))
    out = out.unionByName(plain.filter("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _tiles(grouped: DataFrame) -> DataFrame:
    """(g, main, most, all, p, q): a group's largest component, its rows, all rows, tiles of that component and all tiles."""
    of = grouped.groupBy("g", "component").agg(F.count("*").alias("c")).groupBy("g").agg(F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("component", F.struct("c", "component")).alias("main"))
    p = F.ceil(F.col("most") / TILE).cast("int")
    return of.select("g", "main", "most", "all", p.alias("p"), (p + F.ceil((F.col("all") - F.col("most")) / TILE).cast("int")).alias("q")).filter("q > p")
