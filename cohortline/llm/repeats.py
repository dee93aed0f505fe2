"""Removal of repeated passages, exact to the byte, by externally sorting the suffixes of shards.

A window is a run of `length` bytes. Its anchor is the run of ANCHOR bytes in it that has the
smallest hash (the leftmost of equals), so equal windows have equal anchors at equal places.
Consecutive windows of a text with one anchor are a segment. A segment whose anchor is
nowhere else holds no repeat and goes no further. All other segments are dealt to shards by their
anchors, with their bytes, and the suffixes of each shard are sorted by induction: suffixes
whose common prefix has the full length are one window, and all but the first of them are repeats.

A task sends equal segments on once as far as its memory of them goes (it compares their bytes), so
a passage in millions of documents comes to its shard at most about once from each task, and a shard sorts only the first of
equal segments, as far as its memory of them goes. An anchor with more than HOT segments is split: its windows are dealt one by one by hashes of all their bytes, and
windows whose hash is nowhere else are dropped before any bytes move.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import byte_table, mix, powers, slices, text_bytes, tidied
from .induced import CHUNK, room, sort_suffixes
from .tables import no_text, rows_with, rows_without, written

_U = np.uint64
ANCHOR = 32
PIECE_BITS = 17
HOT = 20_000
SAMPLE = 64
SHARD_BYTES = 4 << 20
MEMORY = 64 << 20
COPIES = 40 << 20


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w values in a row."""
    have = 1
    while have * 2 <= w:
        v = np.minimum(v[: len(v) - have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (w - have)], v[w - have :]) if w > have else v


def _prefix_sums(part: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers, from which each run's hash follows."""
    sums = np.zeros(len(part) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(byte_table(False)[part] * powers(len(part))[0][: len(part)], dtype=_U, out=sums[1:])
    return sums


def segments(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Segments of some texts: text, start in it, number of windows, anchor hash and hash of the bytes.

    A piece of the texts at a time; a segment that goes on in the next piece is two.
    """
    out: dict[str, list[np.ndarray]] = {"text": [], "start": [], "n": [], "anchor": [], "body": []}
    low_bits = _U((1 << (PIECE_BITS + 1)) - 1)
    for low in range(0, max(len(data) - length + 1, 0), 1 << PIECE_BITS):
        part = data[low : low + (1 << PIECE_BITS) + length - 1]
        n = len(part) - length + 1
        sums = _prefix_sums(part)
        down = powers(len(part))[1]
        with np.errstate(over="ignore"):
            v = mix((sums[anchor:] - sums[:-anchor]) * down[: len(part) - anchor + 1])
        keyed = (v & ~low_bits) | np.arange(len(v), dtype=_U)
        at = (_least(keyed, length - anchor + 1) & low_bits).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(low, low + n), "right") - 1
        valid = np.arange(low, low + n) + length <= offsets[text + 1]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        end = valid.copy()
        end[:-1] &= ~valid[1:] | new[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        count = last - first + 1
        with np.errstate(over="ignore"):
            body = mix((sums[last + length] - sums[first]) * down[first] + count.astype(_U) * _U(0x9E3779B97F4A7C15))
        for k, x in (("text", text[first]), ("start", first + low - offsets[text[first]]), ("n", count), ("anchor", v[at[first]].view(np.int64)), ("body", body)):
            out[k].append(x)
    return {k: np.concatenate(x) if x else np.zeros(0, np.int64) for k, x in out.items()}


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size[i] bytes of a from at[i] on equal those of b from bt[i] on; both end with 8 bytes more than needed."""
    words = [np.ndarray((max(len(x) - 7, 0),), "<u8", x, 0, (1,)) for x in (a, b)]
    out, going = np.ones(len(at), bool), np.arange(len(at))
    for k in range(0, int(size.max(initial=0)), 8):
        left = size[going] - k
        going, left = going[left > 0], left[left > 0]
        x = words[0][at[going] + k] ^ words[1][bt[going] + k]
        x <<= (8 * np.maximum(8 - left, 0)).astype(_U)  # only what belongs to the run
        out[going[x != 0]] = False
        going = going[x == 0]
    return out


class Copies:
    """Segments that a task has seen, with the texts they are in, as far as its memory goes; those met again stay longest."""

    def __init__(self, memory: int = COPIES):
        self.memory = memory
        self.pool = np.zeros(8, np.uint8)
        self.e = {k: np.zeros(0, t) for k, t in (("key", _U), ("at", np.int64), ("size", np.int64), ("id", np.int64), ("start", np.int64), ("hits", np.int64))}

    def seen(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which segments have the bytes of one that was seen and has a smaller (id, start); the others are remembered."""
        data = np.append(data, np.zeros(8, np.uint8))
        out, e = np.zeros(len(at), bool), self.e
        order = np.lexsort((start, ids, key))
        k = key[order]
        first = np.append(True, k[1:] != k[:-1])[: len(k)]
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))] if len(k) else order
        again = np.flatnonzero(~first)
        a, b = order[again], lead[again]
        out[a] = (size[a] == size[b]) & same_bytes(data, at[a], data, at[b], np.minimum(size[a], size[b]))
        leads = order[first]
        slot = np.minimum(np.searchsorted(e["key"], key[leads]), max(len(e["key"]) - 1, 0))
        hit = e["key"][slot] == key[leads] if len(e["key"]) else np.zeros(len(leads), bool)
        a, slot = leads[hit], slot[hit]
        equal = (size[a] == e["size"][slot]) & same_bytes(data, at[a], self.pool, e["at"][slot], np.minimum(size[a], e["size"][slot]))
        later = (e["id"][slot] < ids[a]) | ((e["id"][slot] == ids[a]) & (e["start"][slot] < start[a]))
        out[a[equal & later]] = True
        e["hits"][slot[equal]] += 1
        sooner = equal & ~later
        e["id"][slot[sooner]], e["start"][slot[sooner]] = ids[a[sooner]], start[a[sooner]]
        self._add(data, leads[~hit], at, size, key, ids, start)
        return out

    def _add(self, data: np.ndarray, new: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray, ids: np.ndarray, start: np.ndarray) -> None:
        """Remember segments, whose texts (data, with 8 bytes more) join the pool; new is in the order of the keys."""
        if len(self.pool) + len(data) > self.memory:
            keep = np.flatnonzero(self.e["hits"] > 0)
            keep = np.sort(keep[np.argsort(-self.e["hits"][keep], kind="stable")][: self.memory // 1024])
            self.pool, where = _gathered(self.pool, self.e["at"][keep], self.e["size"][keep])
            self.e = {k: x[keep] for k, x in self.e.items()} | {"at": where}
        rows = {"key": key[new], "at": at[new] + len(self.pool) - 8, "size": size[new], "id": ids[new], "start": start[new], "hits": np.zeros(len(new), np.int64)}
        self.pool = np.concatenate([self.pool[:-8], data])
        to = np.searchsorted(self.e["key"], rows["key"])
        self.e = {k: np.insert(x, to, rows[k]) for k, x in self.e.items()}


def _gathered(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the runs in a row, 8 more at the end, and where each begins."""
    ends = np.cumsum(size)
    where = ends - size
    index = np.arange(int(size.sum())) + np.repeat(at - where, size)
    return np.concatenate([data[index], np.zeros(8, np.uint8)]), where


ROW = "id long, start int, n int, anchor long, sure boolean"
NAMES = ["id", "start", "n", "anchor", "sure"]


def _runs(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in a row, of one key each, that follow each other without a gap become one."""
    by = np.lexsort((start, key))
    key, start, n = key[by], start[by], n[by]
    new = np.ones(len(by), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + n[:-1])
    cut = np.flatnonzero(new)
    return key[cut], start[cut], np.add.reduceat(n, cut) if len(cut) else n


def _rows(ids: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, sure: bool) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor, pa.int64()), pa.array(np.full(len(ids), sure))]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def _segmenter(length: int) -> Callable:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = Copies()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("id").to_numpy()
                data, offsets = text_bytes(part.column("text"))
                s = segments(data, offsets, length)
                own = ids[s["text"]]
                again = copies.seen(data, offsets[s["text"]] + s["start"], s["n"] + (length - 1), s["body"], own, s["start"])
                yield _rows(own[~again], s["start"][~again], s["n"][~again], s["anchor"][~again], False)
                key, start, n = _runs(own[again], s["start"][again], s["n"][again])
                yield _rows(key, start, n, np.zeros(len(key), np.int64), True)

    return run


def _windower(length: int) -> Callable:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window of the cuts, under the hash of all its bytes."""
        copies = Copies()
        for batch in batches:
            for part in slices(batch, "text", 1 << PIECE_BITS):
                data, offsets = text_bytes(part.column("text"))
                cuts = part.column("cuts")
                text = np.repeat(np.arange(part.num_rows), np.diff(cuts.offsets.to_numpy()))
                flat = cuts.flatten()
                start, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                owner = np.repeat(text, n)
                at = np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                for low in range(0, len(at), 1 << PIECE_BITS):
                    o, a = owner[low : low + (1 << PIECE_BITS)], at[low : low + (1 << PIECE_BITS)]
                    place = offsets[o] + a
                    base = int(place.min())
                    piece = data[base : int(place.max()) + length]
                    sums, down = _prefix_sums(piece), powers(len(piece))[1]
                    with np.errstate(over="ignore"):
                        key = mix((sums[place - base + length] - sums[place - base]) * down[place - base])
                    ids = part.column("id").to_numpy()[o]
                    again = copies.seen(piece, place - base, np.full(len(a), length), key, ids, a)
                    yield _rows(ids[~again], a[~again], np.ones(int((~again).sum()), np.int64), key[~again].view(np.int64), False)
                    key, a, n = _runs(ids[again], a[again], np.ones(int(again.sum()), np.int64))
                    yield _rows(key, a, n, np.zeros(len(key), np.int64), True)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their anchors: those whose anchor others have too."""
    held: pa.RecordBatch | None = None  # the last row seen, if its anchor has been alone so far
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        same = anchor[1:] == anchor[:-1]
        several = np.append(False, same) | np.append(same, False)
        if before == anchor[0]:
            several[0] = True
            if held is not None:
                yield held
        held = None if several[-1] else batch.slice(batch.num_rows - 1, 1)
        before = anchor[-1]
        yield batch.filter(pa.array(several))


def _hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the runs."""
    sums, down = _prefix_sums(data), powers(len(data))[1]
    with np.errstate(over="ignore"):
        return mix((sums[at + size] - sums[at]) * down[at] + size.astype(_U) * _U(0x9E3779B97F4A7C15))


class Shard:
    """Segments of a shard as they come; beyond the memory given their bytes lie on disk. Of equal segments the first is kept for the sort."""

    def __init__(self, memory: int):
        self.memory, self.parts, self.held, self.file, self.high = memory, [], 0, None, 0
        self.copies, self.again = Copies(memory // 8), []
        self.ids: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, batch: pa.RecordBatch) -> None:
        body = batch.column("body")
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        ids, starts, sizes = batch.column("id").to_numpy(), batch.column("start").to_numpy(), np.diff(offsets).astype(np.int64)
        at = offsets[:-1].astype(np.int64) - offsets[0]
        again = self.copies.seen(data, at, sizes, _hashes(data, at, sizes), ids, starts)
        if again.any():
            self.again.append((ids[again], starts[again], sizes[again]))
        data = data[np.repeat(~again, sizes)]
        self.ids.append(ids[~again])
        self.starts.append(starts[~again])
        self.sizes.append(sizes[~again])
        self.high = max(self.high, int(data.max(initial=0)))
        self.held += len(data)
        if self.held > self.memory:
            self.file = self.file or tempfile.TemporaryFile()  # has no name and ends with the task
            for p in [*self.parts, data]:
                self.file.write(p.tobytes())
            self.parts, self.held = [], 0
        else:
            self.parts.append(data)

    def _bytes(self) -> Iterator[np.ndarray]:
        if self.file:
            self.file.seek(0)
            while len(x := np.frombuffer(self.file.read(CHUNK), np.uint8)):
                yield x
        yield from self.parts

    def repeats(self, length: int) -> Iterator[pa.RecordBatch]:
        """(id, start, n) for runs of windows that also stand at a smaller (id, start). Segments come in that order."""
        if not self.sizes:
            return
        for again, start, size in self.again:  # all windows of these
            yield pa.RecordBatch.from_arrays([pa.array(again, pa.int64()), pa.array(start, pa.int32()), pa.array(size - (length - 1), pa.int32())], names=["id", "start", "n"])
        self.copies, self.again = Copies(0), []
        ids, starts, sizes = (np.concatenate(x) for x in (self.ids, self.starts, self.sizes))
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1]) + 1
        t = room(n, np.uint8 if self.high < 254 else np.uint16, self.memory // 8)
        t[:] = 1  # stands between segments
        t[n - 1] = 0
        done, left = 0, np.zeros(0, np.uint8)
        for x in self._bytes():  # whole segments at a time
            x = np.concatenate([left, x])
            upto = int(np.searchsorted(np.cumsum(sizes[done:]), len(x), "right")) + done
            own = sizes[done:upto]
            size = int(own.sum())
            to = np.arange(size) + np.repeat(ends[done:upto] - 1 - np.cumsum(own), own)
            t[to] = x[:size].astype(t.dtype) + 2
            done, left = upto, x[size:]
        gone = _repeated(t, ends, length, self.memory)
        for low in range(0, n, CHUNK):
            place = np.flatnonzero(gone[low : low + CHUNK]) + low
            if len(place):
                owner = np.searchsorted(ends, place, "right")
                at = place - (ends[owner] - 1 - sizes[owner]) + starts[owner]
                key, start, count = _runs(owner, at, np.ones(len(place), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids[key], pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int32())], names=["id", "start", "n"])


def _repeated(t: np.ndarray, ends: np.ndarray, length: int, memory: int) -> np.ndarray:
    """Which places begin a whole window that also begins at an earlier place; ends[i] is where what follows segment i and its mark begins."""
    n = len(t)
    gone, whole = room(n, bool, memory // 8), room(n, bool, memory // 8)
    gone[:] = False
    for low in range(0, n, CHUNK):
        place = np.arange(low, min(low + CHUNK, n))
        owner = np.minimum(np.searchsorted(ends, place, "right"), len(ends) - 1)
        whole[low : low + CHUNK] = place + length <= ends[owner] - 1
    left = np.zeros(0, np.uint32)  # the last window's suffixes so far
    for place, common in sort_suffixes(t, length, memory):
        new = np.concatenate([np.zeros(len(left), bool), common < length])
        place = np.concatenate([left, place])
        new[0] = True
        cut = np.flatnonzero(new)
        _mark(place[: cut[-1]], cut[:-1], gone, whole)
        left = place[cut[-1] :]
    if len(left):
        _mark(left, np.zeros(1, np.int64), gone, whole)
    return gone


def _mark(place: np.ndarray, cut: np.ndarray, gone: np.ndarray, whole: np.ndarray) -> None:
    if not len(place):
        return
    size = np.diff(np.append(cut, len(place)))
    first = np.minimum.reduceat(place, cut)
    several = np.repeat(size > 1, size)
    place, first = place[several], np.repeat(first, size)[several]
    again = place[place != first]
    gone[again[whole[again]]] = True


def _sorter(length: int, memory: int) -> Callable:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(memory)
        for batch in batches:
            if batch.num_rows:
                shard.add(batch)
        yield from shard.repeats(length)

    return run


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))
KEPT = [T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", SPANS)]


def _cutter(text: str) -> Callable:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Union of each row's spans, and the bytes outside them."""
        for whole in batches:
            for batch in slices(whole, text):
                yield cut(batch)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, removed = [], []
        for t, spans in zip(batch.column(text).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
            body, merged, at, out = (t or "").encode(), [], 0, []
            for s in sorted((s["first"], s["end"]) for s in spans):
                if merged and merged[-1]["end"] >= s[0]:
                    merged[-1]["end"] = max(merged[-1]["end"], s[1])
                else:
                    merged.append({"first": s[0], "end": s[1]})
            for s in merged:
                out.append(body[at : s["first"]])
                at = s["end"]
            out.append(body[at:])
            kept.append(b"".join(out))
            removed.append(merged)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        own = [c for c in batch.schema.names if c != "_spans"]
        new = [pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), pa.array(removed, kind)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *new], names=[*own, *[f.name for f in KEPT]])

    return run


def _met(rows: DataFrame) -> DataFrame:
    """Rows whose anchor others have too."""
    return rows.select(*NAMES).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_meet, ROW).drop("sure")


def _cuts(docs: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """(id, text, cuts) of the documents that have rows (id, start, n, ...)."""
    lists = rows.groupBy("id").agg(F.collect_list(F.struct("start", "n", *more)).alias("cuts"))
    return rows_with(docs, rows.select("id").distinct(), "id").join(lists, "id")


def find_repeats(docs: DataFrame, length: int = 100, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY, hot: int = HOT) -> DataFrame:
    """(id, spans) of the documents (id, text) that have bytes of repeated windows; ids must differ and order the documents.

    shard_bytes: about how many bytes of segments a shard has. memory: about how many bytes of queues and
    texts a task holds; more move to disk. hot: anchors with about so many segments are split.
    """
    spark = docs.sparkSession
    rows = written(docs.mapInArrow(_segmenter(length), ROW), "segments")
    sure, open_ = rows.filter("sure").select("id", "start", "n"), rows.filter("NOT sure")
    sample = open_.filter(F.pmod(F.xxhash64("id", "start"), F.lit(SAMPLE)) == 0)  # says how to deal, not what is found
    often = written(sample.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > hot / SAMPLE).select("anchor"), "hot")
    split = bool(often.head(1))
    met = _met(rows_without(open_, often, "anchor") if split else open_)
    if split:
        windows = written(_cuts(docs, rows_with(open_, often, "anchor")).select("id", "text", "cuts").mapInArrow(_windower(length), ROW), "windows")
        met = met.unionByName(_met(windows.filter("NOT sure")))
        sure = sure.unionByName(windows.filter("sure").select("id", "start", "n"))
    met = written(met, "met")
    size = met.agg(F.coalesce(F.sum(F.col("n") + length), F.lit(0)).alias("b")).head()["b"]
    spans = sure
    if size:
        shards = int(max(size // shard_bytes + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        body = F.transform("cuts", lambda c: F.struct(c["anchor"].alias("anchor"), c["start"].alias("start"), F.substring(F.col("bytes"), c["start"] + 1, c["n"] + (length - 1)).alias("body")))
        bodies = _cuts(docs, met, "anchor").withColumn("bytes", F.encode("text", "UTF-8")).select("id", F.explode(body).alias("c")).select("id", "c.*")
        dealt = bodies.repartition(shards, "anchor").sortWithinPartitions("id", "start").select("id", "start", "body")
        spans = spans.unionByName(dealt.mapInArrow(_sorter(length, memory), "id long, start int, n int"))
    return spans.groupBy("id").agg(F.collect_list(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("n") + (length - 1)).alias("end"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """docs with kept (binary), kept_text (string) and removed (array of (first, end) byte spans).

    A byte is removed if it lies in a run of `length` bytes (200 at most) that also starts earlier: in a row of a
    smaller id, or at an earlier byte of the same text; overlaps count, and runs are judged on the
    input. kept_text is what is kept without characters that lost some of their bytes. Null texts count as
    empty; texts shorter than the length are kept. Where ids repeat or are null, rows are ordered by id (null
    first) and text, and each is a document. Columns named like an output are replaced. No rows give none.
    """
    docs = docs.drop(*[f.name for f in KEPT], "_key", "_spans")
    own = docs.columns
    ids = docs.select(id_col).agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("d")).head()
    if ids["n"] == ids["d"]:
        rows = docs.withColumn("_key", F.col(id_col).cast("long"))
    else:  # give each row a number in the order of the ids
        rows = written(docs.orderBy(F.col(id_col).asc_nulls_first(), F.col(text).asc_nulls_first()).withColumn("_key", F.monotonically_increasing_id()), "numbered")
    spans = written(find_repeats(rows.select(F.col("_key").alias("id"), no_text(text).alias("text")), length), "spans")
    spans = spans.select(F.col("id").alias("_key"), F.col("spans").alias("_spans"))
    keys = spans.select("_key")
    schema = T.StructType([*docs.schema.fields, *KEPT])
    cut = rows_with(rows, keys, "_key").join(spans, "_key").select(*own, "_spans").mapInArrow(_cutter(text), schema)
    rest = rows_without(rows, keys, "_key").select(*own, F.encode(no_text(text), "UTF-8").alias("kept"), no_text(text).alias("kept_text"), F.array().cast(SPANS).alias("removed"))
    return cut.unionByName(rest)
