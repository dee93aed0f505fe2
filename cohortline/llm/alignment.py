"""Alignment of two tokenizers' tokens over the same bytes, and what is linked with what corpus-wide.

Side A is a byte-level vocabulary of the `tokenizers` library, whose offsets count characters; side B a merge model of
`sentencepiece`, whose spans come with its encoded proto. Both spans are coarse cuts: several tokens of A that share a character
all have its end, and of the byte pieces that make a character of B only the last has one. There the decoded bytes of the tokens
say where each ends. Offsets at which tokens of both sides end cut them into groups.

Texts are cut first before a space, or a line feed between two other characters, that follows a character other than white
space, and before a mark after a letter or digit that the merge model never joins: neither side has a token across such a place, so
a text's groups are those of its stretches in a row. Stretches repeat; each worker keeps those it has seen, up to a fixed number
(those not asked for longest go first), and encodes only new ones.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .arrowtext import with_text_columns
from .pieces import SPACE
from .tables import SEND_IDS, join_spread, often, written

KEEP, LONG = 500_000, 64
#: Marks before which a text may be cut, where the merge model has no piece with a letter or digit before them.
MARKS = ".,;:!?)\"%"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass
class Tokens:
    """Tokens of several parts in a row: ids, the byte offset at which each ends, and where those of each part begin (one more than parts)."""

    ids: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


class Aligner:
    """Encodes stretches on both sides. a: the JSON of the byte-level vocabulary; b: the bytes of the merge model."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.raw_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        if set(letters) - set(self.a.get_vocab()):
            raise ValueError("the byte-level vocabulary must have every byte")
        n = self.b.get_piece_size()
        self.raw_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.is_byte = np.array([self.b.is_byte(i) for i in range(n)])
        self.space = self.b.piece_to_id(SPACE)
        top = max(n, max(self.raw_a) + 1)
        self.names = np.array([str(i) for i in range(top)], object)
        self.size_a = np.zeros(top, np.int64)
        for i, r in self.raw_a.items():
            self.size_a[i] = len(r)
        self.size_b = np.array([len(r) for r in self.raw_b])
        normal = [self.b.id_to_piece(i) for i in range(n) if not (self.is_byte[i] or self.b.is_control(i) or self.b.is_unknown(i))]
        met = {x + y for p in normal for x, y in zip(p, p[1:], strict=False)}
        plan = json.loads(a)
        first = plan.get("pre_tokenizer") or {}
        #: Whether texts may be cut: B has no piece with a space after another character or with a line feed, and A's words are those of the usual pattern.
        self.cuts = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in normal) and not plan.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        marks = "|".join(_before(c, "".join(sorted(x[0] for x in met if x[1] == c and x[0].isalnum()))) for c in MARKS)
        self.cut = re.compile(rf"(?=[ \n{re.escape(MARKS)}])(?:(?<=\S)(?= |\n\S)|(?<=[^\W_])(?:{marks}))")
        self.seen: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def stretches(self, text: str) -> list[str]:
        """Parts of a space and the text."""
        return self.cut.split(" " + text) if self.cuts else [" " + text]

    def encode(self, parts: list[str]) -> tuple[Tokens, Tokens, np.ndarray]:
        """The tokens of both sides, and which parts those of B join to, as those of A always do.

        B puts a space before every text: that of a part itself, one before its line feed, or one before a line feed put before any other part.
        """
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])  # the byte at which each character begins
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        return self._side_a(parts, at, first), *self._side_b(parts, at[first])

    def _side_a(self, parts: list[str], at: np.ndarray, first: np.ndarray) -> Tokens:
        done = self.a.encode_batch(parts, add_special_tokens=False)
        ids = np.array([i for e in done for i in e.ids], np.int64)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in done)), np.int64).reshape(-1, 2)
        count = np.fromiter((len(e) for e in done), np.int64, len(done))
        bounds = np.concatenate([[0], np.cumsum(count)])
        spans = spans + np.repeat(first[:-1], count)[:, None]
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False)  # the next token has bytes of the same character
        return Tokens(ids, _refined(at[spans[:, 1]], shared, self.size_a[ids], bounds, at[first]), bounds)

    def _side_b(self, parts: list[str], at: np.ndarray) -> tuple[Tokens, np.ndarray]:
        given = [p[1:] if p[0] == " " else p if p[0] == "\n" else "\n" + p for p in parts]
        done = [e.pieces for e in self.b.encode(given, return_type="proto", num_threads=1)]
        count = np.fromiter(map(len, done), np.int64, len(done))
        flat = np.fromiter((x for e in done for p in e for x in (p.id, p.end)), np.int64, 2 * count.sum()).reshape(-1, 2)
        starts = np.cumsum(count) - count
        own = np.fromiter((0 if p[0] == " " else 1 if p[0] == "\n" else 2 for p in parts), np.int64, len(parts))  # tokens that aren't the part's
        if (flat[starts[own > 0], 0] != self.space).any():
            raise RuntimeError("a line feed was joined with the space before it")
        alone = np.fromiter((p == " " for p in parts), bool, len(parts))
        keep = np.arange(len(flat)) - np.repeat(starts, count) >= np.repeat(own, count)
        flat = flat[keep] + np.stack([np.zeros(keep.sum(), np.int64), np.repeat(1 - own + at[:-1], count)[keep]], axis=1)
        count = count - own
        if alone.any():  # nothing was given: the token is the space itself
            flat = np.insert(flat, (np.cumsum(count) - count)[alone], np.stack([np.full(alone.sum(), self.space), at[:-1][alone] + 1], axis=1), axis=0)
            count = count + alone
        bounds = np.concatenate([[0], np.cumsum(count)])
        ids, coarse = flat.T
        raw = self.raw_b.__getitem__
        ok = np.ones(len(parts), bool)
        if b"".join(map(raw, ids.tolist())) != "".join(parts).encode():
            ok = np.array([b"".join(map(raw, i.tolist())) == p.encode() for i, p in zip(np.split(ids, bounds[1:-1]), parts, strict=True)])
        return Tokens(ids, _refined(coarse, self.is_byte[ids], self.size_b[ids], bounds, at), bounds), ok

    def entries(self, parts: set[str]) -> None:
        """Keep (groups as text, links, tokens of A and of B) of each part."""
        if len(self.seen) + len(parts) > KEEP // 2:
            self.seen, self.older = {}, self.seen
        seen, older = self.seen, self.older
        new = []
        for p in parts:
            if p not in seen:
                if p in older:
                    seen[p] = older[p]
                else:
                    new.append(p)
        for at in range(0, len(new), 4096):
            chunk = new[at : at + 4096]
            one, other, ok = self.encode(chunk)
            if not ok.all():
                seen.update((p, None) for p, o in zip(chunk, ok.tolist(), strict=True) if not o)
                chunk = [p for p, o in zip(chunk, ok.tolist(), strict=True) if o]
                one, other, _ = self.encode(chunk)
            seen.update(zip(chunk, self._grouped(one, other), strict=True))

    def _grouped(self, one: Tokens, other: Tokens) -> Iterator[tuple[str, bytes, int, int]]:
        """(groups, links, tokens of A and of B) of each part."""
        cuts = np.intersect1d(one.ends, other.ends, assume_unique=True)
        last_a, last_b = np.searchsorted(one.ends, cuts), np.searchsorted(other.ends, cuts)
        links = one.ids[last_a] << 32 | other.ids[last_b]
        key = np.concatenate([2 * np.searchsorted(cuts, one.ends), 2 * np.searchsorted(cuts, other.ends) + 1])  # tokens of a group: first those of A
        order = np.argsort(key, kind="stable")
        key = key[order]
        after = np.where(np.append(key[1:] == key[:-1], False), ",", np.where(key % 2 == 0, "|", ";")).astype(object)
        bounds = one.bounds + other.bounds
        after[bounds[1:] - 1] = ""
        said = (self.names[np.concatenate([one.ids, other.ids])[order]] + after).tolist()
        of = np.searchsorted(last_a, one.bounds)  # the first group of each part
        for i in range(len(bounds) - 1):
            yield "".join(said[bounds[i] : bounds[i + 1]]), links[of[i] : of[i + 1]].tobytes(), int(one.bounds[i + 1] - one.bounds[i]), int(other.bounds[i + 1] - other.bounds[i])


def _before(mark: str, joined: str) -> str:
    """A pattern of the places before a mark and not after a letter or digit that is joined with it."""
    return f"(?={re.escape(mark)})" + (f"(?<![{re.escape(joined)}])" if joined else "")


def _refined(coarse: np.ndarray, inner: np.ndarray, size: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens end: the coarse ones, but for inner tokens the end before them plus the sizes of their decoded bytes."""
    if not inner.any():
        return coarse
    total = np.cumsum(size)
    place = np.arange(len(coarse))
    part = np.searchsorted(bounds, place, "right") - 1
    known = np.maximum.accumulate(np.where(inner, -1, place))
    begins = known < bounds[part]  # nothing is known before it in its part
    base = np.where(begins, at[part], coarse[np.maximum(known, 0)])
    before = np.where(begins, np.append(0, total)[bounds[part]], total[np.maximum(known, 0)])
    return np.where(inner, base + total - before, coarse)


#: Workers serve many tasks: the last aligner stays with what it has seen.
_LAST: dict[tuple[int, int], Aligner] = {}


def _aligner(a: str, b: bytes) -> Aligner:
    key = (hash(a), hash(b))
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Aligner(a, b)
    return _LAST[key]


LINK = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.IntegerType())])
FIELDS = [
    T.StructField("n_a", T.LongType()),
    T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()),
    T.StructField("groups", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)),
]


def align_tokens(df: DataFrame, a: str, b: bytes, text: str = "text") -> DataFrame:
    """df with the groups of each whole text: n_a, n_b, n_groups, groups and links.

    Side A encodes a space and the text, side B the text, before which it puts a space itself; strings of special tokens are
    plain text. groups: `a1,a2|b1;a3|b2,b3`, the ids of both sides in order. links: the distinct pairs (a, b) of tokens that end
    together, the last ones of a group, with how often (n) the text has them. A text that is null or empty, or whose tokens
    don't join to a space and the text (such as one with U+2581), has no tokens: zeros, an empty string and an empty list.
    Rows, repeated ones too, keep all their columns; those named like an output are replaced; an empty table stays empty. a: the
    JSON of a byte-level vocabulary; b: the bytes of a merge model with byte pieces. Both go to the tasks with the job.
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        aligner = _aligner(a, b)

        def compute(texts: pa.Array) -> list[pa.Array]:
            parts = [aligner.stretches(t) if t else [] for t in texts.to_pylist()]
            aligner.entries({p for ps in parts for p in ps})
            get = aligner.seen.__getitem__
            said, sizes, links, times, ends = [], [], [], [], [0]
            for ps in parts:
                own = list(map(get, ps))
                if None in own:
                    own = []
                said.append(";".join([e[0] for e in own]))
                every = np.frombuffer(b"".join([e[1] for e in own]), np.int64)
                sizes.append((sum([e[2] for e in own]), sum([e[3] for e in own]), len(every)))
                pairs, n = np.unique(every, return_counts=True)
                links.append(pairs)
                times.append(n)
                ends.append(ends[-1] + len(pairs))
            for p in [p for ps in parts for p in ps if len(p) > LONG]:
                aligner.seen.pop(p, None)
            pairs = np.concatenate([np.zeros(0, np.int64), *links])
            of = [pairs >> 32, pairs & 0xFFFFFFFF, np.concatenate([np.zeros(0, np.int64), *times])]
            rows = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in of], names=["a", "b", "n"])
            return [*[pa.array([s[k] for s in sizes], pa.int64()) for k in range(3)], pa.array(said, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)]

        return compute

    return with_text_columns(df, text, FIELDS, make)


def pair_counts(aligned: DataFrame, links: str = "links") -> DataFrame:
    """(a, b, docs, count, best): how many links of all rows hold each pair, in how many rows, and whether no pair of the same b has more."""
    each = aligned.select(F.explode(links).alias("l")).select("l.a", "l.b", "l.n")
    counts = written(each.groupBy("a", "b").agg(F.count("*").alias("docs"), F.sum("n").alias("count")), "pair-counts")
    return counts.join(counts.groupBy("b").agg(F.max("count").alias("_most")), "b").select("a", "b", "docs", "count", (F.col("count") == F.col("_most")).alias("best"))


def with_link_counts(aligned: DataFrame, links: str = "links") -> DataFrame:
    """aligned, whose links are replaced by n_links, n_best (links whose pair is the most frequent of its b, ties included) and count_sum (of the pairs' counts over the links).

    A row without links has zeros. Counts of a million pairs at most are sent to all tasks; more are joined, frequent pairs over several tasks.
    """
    aligned = written(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(aligned, links), "pairs")
    each = aligned.select("_row", F.explode(links).alias("l")).select("_row", "l.a", "l.b", "l.n")
    of = counts.select("a", "b", "count", "best")
    if counts.limit(SEND_IDS + 1).count() <= SEND_IDS:
        joined = each.join(F.broadcast(of), ["a", "b"])
    else:
        joined = join_spread(each, of, ["a", "b"], "_row", often(counts.select("a", "b", F.col("docs").alias("c"))))
    sums = joined.groupBy("_row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    out = aligned.drop(links, "n_links", "n_best", "count_sum").join(sums, "_row", "left").drop("_row")
    return out.withColumns({c: F.coalesce(c, none) for c in ("n_links", "n_best", "count_sum")})
