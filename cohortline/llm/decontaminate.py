"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. A shift table, indexed by a hash of
the block of words that ends at the current position, tells how far the search may jump; its size follows the number of patterns.
Where the search may not jump, the hashes of that block and of the window's first block select the patterns to test, and the words
themselves are compared. Many stretches of the text are searched in step, so each step is
a few numpy operations.

Documents are never shuffled. The patterns are sent to all tasks, in blocks of bounded
size; a benchmark of more words than a block may hold is searched for in several passes,
whose hits are united by document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Words, alnum_words, list_array, mix, with_text_columns
from .tables import written

_U = np.uint64
_A = _U(0xC2B2AE3D27D4EB4F)
LEAST_BITS, MOST_BITS = 12, 24
LANE = 64


class Patterns:
    """Different patterns of one length with their shift table and their buckets, by last and first block."""

    def __init__(self, hashes: np.ndarray, words: list[list[bytes]]):
        self.m = hashes.shape[1]
        self.block = min(2, self.m)
        blocks = np.stack([self._block(hashes[:, last], hashes[:, last - 1]) for last in range(self.block - 1, self.m)], axis=1)
        n = len(np.unique(blocks))
        self.bits = min(max((16 * n).bit_length(), LEAST_BITS), MOST_BITS)  # about one slot in 16 or fewer is taken
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int16)
        for j in range(blocks.shape[1]):
            np.minimum.at(self.shift, self._slot(blocks[:, j]), self.m - self.block - j)
        key = self._key(blocks[:, -1], blocks[:, 0])
        self.order = np.argsort(key, kind="stable")
        self.key, self.words, self.hashes = key[self.order], [words[i] for i in self.order], hashes[self.order]

    def _block(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(last + (before * _A if self.block == 2 else _U(0)))

    @staticmethod
    def _key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(suffix * _A + prefix)

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> _U(64 - self.bits)).astype(np.int64)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The last words of all occurrences, and which pattern each is of."""
        h, m, n = words.hash, self.m, len(words)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        ends, which = [], []
        while len(at):
            block = self._block(h[at], h[at - 1])
            jump = self.shift[self._slot(block)].astype(np.int64)
            test = np.flatnonzero(jump == 0)
            if len(test):
                first = at[test] - m + 1
                key = self._key(block[test], self._block(h[first + self.block - 1], h[first]))
                low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
                some = high > low
                place, low, high = at[test[some]], low[some], high[some]
                while len(place):
                    same = words.text[place - m + 1] == words.text[place]
                    for j in range(m):
                        same &= h[place - m + 1 + j] == self.hashes[low, j]
                    ends.append(place[same])
                    which.append(low[same])
                    low = low + 1
                    more = (low < high) & ~same  # patterns differ, so one is found at most
                    place, low, high = place[more], low[more], high[more]
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, which = np.concatenate(ends), np.concatenate(which)
        exact = np.array([self._equal(words, e, self.words[w]) for e, w in zip(ends.tolist(), which.tolist(), strict=True)], bool)
        return ends[exact], self.order[which[exact]]

    def _equal(self, words: Words, end: int, pattern: list[bytes]) -> bool:
        first = end - self.m + 1
        return all(words.data[words.starts[first + j] : words.ends[first + j]].tobytes().lower() == p for j, p in enumerate(pattern))


class Matcher:
    """All patterns of a block of benchmark items, by length, and the items of each pattern."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        words = Words(texts, alnum_words())
        owners: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
        for i in range(len(items)):
            low, high = words.bounds[i], words.bounds[i + 1]
            own = [words.data[words.starts[k] : words.ends[k]].tobytes().lower() for k in range(low, high)]
            m = min(window, len(own))
            for k in range(len(own) - m + 1 if m else 0):
                owners.setdefault(m, {}).setdefault(tuple(own[k : k + m]), set()).add(i)
        self.ids = [i for i, _ in items]
        self.sets, self.items = [], []
        for m, found in sorted(owners.items()):
            flat = Words(pa.array([" ".join(x.decode() for x in p) for p in found], pa.string()), alnum_words())
            self.sets.append(Patterns(flat.hash.reshape(-1, m), [list(p) for p in found]))
            self.items.append([sorted(x) for x in found.values()])

    def search(self, texts: pa.Array) -> tuple[Words, np.ndarray, list[set[str]]]:
        """The words, how often each is covered by an occurrence, and the ids of the items that occur in each text."""
        words = Words(texts, alnum_words())
        edge = np.zeros(len(words) + 1, np.int64)
        found: list[set[str]] = [set() for _ in range(len(texts))]
        for patterns, items in zip(self.sets, self.items, strict=True):
            ends, which = patterns.find(words)
            np.add.at(edge, ends - patterns.m + 1, 1)
            np.add.at(edge, ends + 1, -1)
            pairs = np.unique(np.stack([words.text[ends], which]), axis=1) if len(ends) else np.zeros((2, 0), np.int64)
            for text, pattern in pairs.T.tolist():
                found[text].update(x for i in items[pattern] if (x := self.ids[i]) is not None)
        return words, np.cumsum(edge[:-1]), found


def _runs(words: Words, covered: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 word of each maximal run of hit words, counted within its text; runs by text."""
    hit = covered > 0
    new = np.ones(len(hit), bool)
    new[1:] = ~hit[:-1] | (words.text[1:] != words.text[:-1])
    first = np.flatnonzero(hit & new)
    last = np.ones(len(hit), bool)
    last[:-1] = ~hit[1:] | (words.text[1:] != words.text[:-1])
    end = np.flatnonzero(hit & last) + 1
    text = words.text[first]
    return first - words.bounds[text], end - words.bounds[text], np.bincount(text, minlength=n_texts)


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _searcher(items: list[tuple[str | None, str]], window: int) -> Callable:
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        matcher = Matcher(items, window)

        def compute(texts: pa.Array) -> list[pa.Array]:
            words, covered, found = matcher.search(texts)
            first, end, runs = _runs(words, covered, len(texts))
            spans = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(end, pa.int32())], ["first", "end"])
            offsets = np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)
            names = [sorted(x) for x in found]
            flat = [y for x in names for y in x]
            return [pa.array(words.counts(), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), spans), list_array(flat, np.array([len(x) for x in names]), pa.string())]

        return compute

    return make


def _unite(spans: str) -> str:
    """SQL for the union of an array of (first, end) spans; touching ones become one."""
    step = "CASE WHEN size(a) > 0 AND a[size(a) - 1].end >= s.first THEN concat(slice(a, 1, size(a) - 1), array(named_struct('first', a[size(a) - 1].first, 'end', greatest(a[size(a) - 1].end, s.end)))) ELSE concat(a, array(s)) END"
    return f"aggregate(array_sort({spans}), CAST(array() AS array<struct<first:int,end:int>>), (a, s) -> {step})"


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 1_000_000) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (word positions, end exclusive) and items (ids as sorted strings).

    Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count as
    a-z. A window is `window` consecutive words of an item, or all words of a shorter item.
    A word of a document is hit if it lies inside any occurrence of a window.
    Null or empty texts have no words and no hits; items without words have no windows; an
    item whose id is null still hits words but isn't listed. Repeated items and rows are
    searched like any others. Columns of docs that have an output's name are replaced.
    block_words: about how many benchmark words a task holds at once; beyond it the
    benchmark is searched for in several passes.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).head()["n"]
    blocks = 1 + size // (4 * block_words)
    docs = docs.drop("n_words", "n_hit", "hit_spans", "items")
    if blocks == 1:
        found = with_text_columns(docs, text, FIELDS, _searcher([(r["i"], r["t"]) for r in items.collect()], window))
    else:
        keyed = written(docs.withColumn("_at", F.monotonically_increasing_id()), "keyed")
        found = None
        for b in range(blocks):  # one block at a time passes through the driver
            part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
            one = with_text_columns(keyed.select("_at", text), text, FIELDS, _searcher([(r["i"], r["t"]) for r in part.collect()], window)).drop(text)
            one = written(one if b == 0 else one.filter(F.size("items") + F.size("hit_spans") > 0), "hits")
            found = one if found is None else found.unionByName(one)
        united = found.groupBy("_at").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = keyed.join(united.withColumn("hit_spans", F.expr(_unite("hit_spans"))), "_at").drop("_at")
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.withColumn("n_hit", hits)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20):
    """Whether hit words are at least one in `share` of a document's words."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words))
