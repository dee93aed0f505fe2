"""External induced sorting of suffixes, with common-prefix values, up to a fixed number of symbols.

A suffix is of type S if it is smaller than the one a position later, else of type L. The
leftmost S suffixes of each run are sorted first: the texts from one of them to the next get
names in their order, and the names in a row are the reduced problem, which is solved the
same way, level by level, until equal names mean an equal limit of symbols. One scan in ascending
order then puts each L suffix behind the suffix it is induced from, and one in descending
order does so for the S suffixes.

What a scan induces goes through a priority queue of tuples (symbol, position, common prefix)
that hands out the smallest block of symbols and moves to disk beyond its memory. Two
tuples of one symbol that follow each other have in common what that symbol stands for and
the smallest value between the two that induced them, so values are carried along. Values are
measured only where no such pair is: between symbols, between induced and given suffixes, and where a
suffix is induced within the block that is just being scanned.

Texts, names, types and orders that outgrow the memory are mapped from unnamed temporary files of the
task, as Spark's own spills are; a scan holds a block of bounded size and a byte for each name.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 16
CHUNK = 1 << 18
LONG_RUN = 256
_NONE = np.uint8(255)
Sorted = tuple[np.ndarray, np.ndarray]


def room(n: int, dtype: type, memory: int) -> np.ndarray:
    """An array of n values, in memory or mapped from a file that has no name and ends with the task."""
    if n * np.dtype(dtype).itemsize <= memory or not n:
        return np.empty(n, dtype)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype, "w+", shape=(n,))


class BulkQueue:
    """Priority queue of tuples (symbol, place, common): smaller blocks of symbols first, equal symbols as they came.

    bounds: the first symbol of each block. Tuples come in runs that ascend by symbol; beyond the memory
    given all that is held is written to disk, in runs as well.
    """

    def __init__(self, bounds: np.ndarray, memory: int):
        self.bounds, self.memory, self.held, self.file = bounds, memory, 0, None
        self.runs: list[deque] = [deque() for _ in bounds]

    def push(self, symbol: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        cut = np.append(np.searchsorted(symbol, self.bounds), len(symbol))
        for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            at = slice(cut[b], cut[b + 1])
            self.runs[b].append((symbol[at], place[at], common[at]))
        self.held += 9 * len(symbol)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for b, runs in enumerate(self.runs):
            live = [r for r in runs if _held(r)]
            if live:
                at = self.file.seek(0, 2)
                parts = [np.concatenate(x) for x in zip(*live, strict=True)]
                for x, kind in zip(parts, (np.uint32, np.uint32, np.uint8), strict=True):
                    self.file.write(x.astype(kind).tobytes())
                self.runs[b] = deque([r for r in runs if not _held(r)] + [(at, len(parts[0]), 0)])
        self.held = 0

    def _read(self, at: int, n: int, low: int, high: int) -> tuple[np.ndarray, ...]:
        out = []
        for kind, before in ((np.uint32, 0), (np.uint32, 4 * n), (np.uint8, 8 * n)):
            size = np.dtype(kind).itemsize
            self.file.seek(at + before + size * low)
            out.append(np.frombuffer(self.file.read(size * (high - low)), kind))
        return tuple(out)

    def drain(self, block: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The tuples of a block of one symbol, also those that come meanwhile, in bounded runs."""
        runs = self.runs[block]
        while runs:
            r = runs.popleft()
            if _held(r):
                parts, n = [r], len(r[0])
                while runs and _held(runs[0]) and n + len(runs[0][0]) <= most:
                    parts.append(runs.popleft())
                    n += len(parts[-1][0])
                self.held = max(0, self.held - 9 * n)
                yield parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            else:
                at, n, low = r
                if low + most < n:
                    runs.appendleft((at, n, low + most))
                yield self._read(at, n, low, min(low + most, n))
            runs = self.runs[block]

    def pop(self, block: int) -> tuple[np.ndarray, ...]:
        """All tuples of a block, by symbol, then as they came."""
        parts = list(self.drain(block, 1 << 62))
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        symbol, place, common = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = _by_symbol(symbol)
        return symbol[order], place[order], common[order]


def _held(run: tuple) -> bool:
    """Whether a run is in memory; else it is (offset in the file, tuples, tuples already read)."""
    return not isinstance(run[0], int)


def _by_symbol(symbol: np.ndarray) -> np.ndarray:
    """Stable order of fewer than 2^31 symbols that fit in 32 bits."""
    if len(symbol) < 2 or (symbol[1:] >= symbol[:-1]).all():
        return np.arange(len(symbol))
    key = (symbol.astype(np.uint64) << np.uint64(31)) | np.arange(len(symbol), dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << 31) - 1)).astype(np.int64)


class _Least:
    """Smallest values of ranges of a byte array."""

    def __init__(self, x: np.ndarray):
        rows, have = [x], 1
        while 2 * have <= len(x):
            rows.append(np.minimum(rows[-1][: len(rows[-1]) - have], rows[-1][have:]))
            have *= 2
        self.flat = np.concatenate(rows)
        self.begin = np.cumsum([0, *map(len, rows)])[:-1]

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each range, both ends included."""
        width = np.frexp((last - first + 1).astype(np.float64))[1].astype(np.int64) - 1
        begin = self.begin[width]
        return np.minimum(self.flat[begin + first], self.flat[begin + last + 1 - (np.int64(1) << width)])


class Source:
    """The symbols of the first level, for measuring common prefixes; they end with one 0, and there is no other."""

    def __init__(self, t: np.ndarray, limit: int, memory: int):
        self.limit, self.n = limit, len(t)
        self.per = 8 // t.itemsize
        self.t = room(len(t) + limit + 16, t.dtype, memory)
        self.t[: len(t)], self.t[len(t) :] = t, 0
        self.words = np.ndarray((len(t) + limit + 8,), "<u8", self.t, 0, (t.itemsize,))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols from a[i] and b[i] on, up to the limit."""
        out = np.full(len(a), self.limit, np.uint8)
        a, b, going = a.astype(np.int64), b.astype(np.int64), np.arange(len(a))
        for k in range(0, self.limit, self.per):
            x = self.words[a + k] ^ self.words[b + k]
            differ = x != 0
            d = x[differ]
            bit = np.frexp((d & (~d + np.uint64(1))).astype(np.float64))[1] - 1
            out[going[differ]] = np.minimum(k + bit // (64 // self.per), self.limit)
            if differ.all():
                break
            same = ~differ
            a, b, going = a[same], b[same], going[same]
        return out


def suffix_types(t: np.ndarray, memory: int) -> np.ndarray:
    """Whether each suffix is of type S; the last symbol must be smaller than all others."""
    n = len(t)
    s = room(n, bool, memory)
    s[n - 1] = True
    for high in range(n - 1, 0, -CHUNK):
        low = max(0, high - CHUNK)
        part = t[low : high + 1]
        less, same = part[:-1] < part[1:], part[:-1] == part[1:]
        less[same] = False
        decided = np.append(~same, True)
        value = np.append(less, s[high])
        nearest = np.where(decided, np.arange(len(value)), len(value))
        s[low:high] = value[np.minimum.accumulate(nearest[::-1])[::-1][:-1]]
    return s


class Level:
    """One level of the recursion: its n symbols (8 bytes more follow them), where each begins in the source, and how many source symbols it stands for."""

    def __init__(self, padded: np.ndarray, n: int, begin: np.ndarray | None, source: Source, memory: int):
        t = padded[:n]
        self.t, self.n, self.source, self.memory, self.begin = t, len(t), source, memory, begin
        self.limit = source.limit
        #: Eight bytes of symbols from each place on; what t is a part of goes on for as many more.
        self.words = np.ndarray((n,), "<u8", padded, 0, (t.itemsize,))
        self.s = suffix_types(t, memory // 8)
        counts, longest = np.zeros(0, np.int64), []
        for low in range(0, self.n, CHUNK):
            part = t[low : low + CHUNK]
            c = np.bincount(part)
            counts = np.pad(counts, (0, max(0, len(c) - len(counts))))
            counts[: len(c)] += c
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            longest.append(part[cut[:-1][np.diff(cut) > LONG_RUN]])
        self.symbols = len(counts)
        single = counts > BLOCK
        single[np.concatenate(longest).astype(np.int64)] = True
        new = np.ones(self.symbols, bool)
        upto = np.cumsum(np.where(single, 0, counts)) // BLOCK
        new[1:] = single[1:] | single[:-1] | (upto[1:] != upto[:-1])
        low = np.flatnonzero(new)
        self.blocks = np.stack([low, np.append(low[1:], self.symbols)], axis=1)
        if begin is None:
            self.adv = None
        else:
            self.adv = room(self.n, np.uint8, memory // 8)
            for at in range(0, self.n, CHUNK):
                ends = np.append(begin[at + 1 : at + CHUNK + 1], source.n)[: min(CHUNK, self.n - at)]
                self.adv[at : at + CHUNK] = np.minimum(ends - begin[at : at + CHUNK].astype(np.int64), self.limit)

    def measure(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.source.common(a, b) if self.begin is None else self.source.common(self.begin[a], self.begin[b])

    def leftmost(self) -> np.ndarray:
        """The places of leftmost S suffixes, in the order of the text."""
        parts = []
        for low in range(1, self.n, CHUNK):
            high = min(low + CHUNK, self.n)
            parts.append((np.flatnonzero(self.s[low:high] & ~self.s[low - 1 : high - 1]) + low).astype(np.uint32))
        out = room(sum(map(len, parts)), np.uint32, self.memory // 8)
        np.concatenate(parts, out=out)
        return out

    def name(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Names of the texts from each place to the next one in their order, the numbers of the places in that order, and whether names settle it."""
        m = len(places)
        names, order = room(m + 2, np.uint32, self.memory // 8), room(m, np.uint32, self.memory // 8)
        names[m:] = 0
        queue = BulkQueue(self.blocks[:, 0], self.memory)
        for low in range(0, m, CHUNK):
            symbol = self.t[places[low : low + CHUNK]]
            by = _by_symbol(symbol)
            queue.push(symbol[by].astype(np.uint32), (by + low).astype(np.uint32), np.zeros(len(by), np.uint8))
        done, count, settled = 0, 0, True
        for b in range(len(self.blocks)):
            number = queue.pop(b)[1]
            if not len(number):
                continue
            number, new = self._sort_texts(places, number)
            own = count + np.cumsum(new)
            names[number] = own - 1
            order[done : done + len(number)] = number
            if settled and not new.all():
                tied = number[~new]
                settled = bool((self._length(places, tied) >= self.limit).all())
            done, count = done + len(number), int(own[-1])
        return names, order, settled

    def _length(self, places: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Source symbols from each place to the next."""
        a = places[number].astype(np.int64)
        b = np.where(number + 1 < len(places), places[np.minimum(number + 1, len(places) - 1)], self.n - 1).astype(np.int64)
        return b - a if self.begin is None else self.begin[b].astype(np.int64) - self.begin[a]

    def _sort_texts(self, places: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of places in the order of their texts, and which begin a new text.

        Eight bytes of symbols are compared at a time. A text that goes on is smaller than one that ends there: it goes on with symbols
        that aren't larger, the other with larger ones.
        """
        each = 8 // self.t.itemsize
        bits = 8 * self.t.itemsize
        start = places[number].astype(np.int64)
        size = np.where(number + 1 < len(places), places[np.minimum(number + 1, len(places) - 1)], self.n - 1).astype(np.int64) - start + 1
        order, new = np.arange(len(number)), np.zeros(len(number), bool)
        new[0] = True
        open_, depth = np.arange(len(number)), 0  # slots of the order that are in groups still to be told apart
        while len(open_) and depth <= self.limit:
            item = order[open_]
            word = self.words[start[item] + depth]
            word = word.byteswap() if each == 8 else word << np.uint64(32) | word >> np.uint64(32) if each == 2 else np.bitwise_or.reduce([(word >> np.uint64(16 * j) & np.uint64(0xFFFF)) << np.uint64(48 - 16 * j) for j in range(4)])
            left = size[item] - depth
            short = np.flatnonzero(left < each)  # what is beyond the end counts as the largest symbol
            word[short] |= ~np.uint64(0) >> (bits * left[short]).astype(np.uint64)
            group = np.cumsum(new[open_])
            by = np.lexsort((word, group)) if depth else np.argsort(word)
            word, group, order[open_] = word[by], group[by], item[by]
            fresh = np.ones(len(by), bool)
            fresh[1:] = (word[1:] != word[:-1]) | (group[1:] != group[:-1])
            new[open_] |= fresh
            depth += each
            alone = fresh & np.append(fresh[1:], True)
            open_ = open_[~alone & (size[order[open_]] >= depth)]
        return number[order], new

    def sort_leftmost(self, places: np.ndarray) -> Sorted:
        """Numbers of the leftmost S suffixes in their order, and the common prefix of each with the one before."""
        names, order, settled = self.name(places)
        begin = places if self.begin is None else self.begin[places]
        if not settled:
            deeper = Level(names, len(places), begin, self.source, self.memory)
            return deeper.sort()
        common = room(len(order), np.uint8, self.memory // 8)
        for low in range(0, len(order), CHUNK):
            part = order[max(low - 1, 0) : low + CHUNK]
            c = self.source.common(begin[part[:-1]], begin[part[1:]])
            common[low : low + CHUNK] = np.append(np.zeros(1, np.uint8), c) if low == 0 else c
        return order, common

    def sort(self) -> Sorted:
        """All suffixes in ascending order, and the common prefix of each with the one before."""
        place, common = room(self.n, np.uint32, self.memory // 8), room(self.n + 1, np.uint8, self.memory // 8)
        end = self.n
        for p, c in self.descending():
            place[end - len(p) : end] = p[::-1]
            common[end - len(p) + 1 : end + 1] = c[::-1]
            end -= len(p)
        place[0] = self.n - 1
        common[0] = common[1 : 1 + (self.n > 1)] = 0
        return place, common[: self.n]

    def descending(self) -> Iterator[Sorted]:
        """All suffixes but the last one's in descending order, and the common prefix of each with the one before it there."""
        if self.n < 2:
            return
        places = self.leftmost()
        order, common = self.sort_leftmost(places)
        counts = np.zeros(self.symbols + 1, np.int64)
        for low in range(0, len(places), CHUNK):
            counts[1:] += np.bincount(self.t[places[low : low + CHUNK]], minlength=self.symbols)
        upto = np.cumsum(counts)[np.append(self.blocks[:, 0], self.symbols)]

        def starts(b: int) -> Iterator[Sorted]:
            for low in range(int(upto[b]), int(upto[b + 1]), CHUNK):
                at = slice(low, min(low + CHUNK, int(upto[b + 1])))
                yield places[order[at]], common[at]

        held = BulkQueue(np.arange(len(self.blocks)), self.memory)
        for b, p, c, given in self._scan(False, starts):
            if not given.all():
                own = ~given
                held.push(np.full(int(own.sum()), b, np.uint32), p[own], c[own])

        def larger(b: int) -> Iterator[Sorted]:
            """The block's L suffixes in descending order; their values are those of the ones before in ascending order."""
            runs, after = [(p, c) for _, p, c in held.drain(b, CHUNK)], None
            for p, c in reversed(runs):
                yield p[::-1], np.append(_NONE if after is None else after, c[:0:-1])
                after = c[0]

        for _, p, c, _ in self._scan(True, larger):
            yield p, c

    def _scan(self, down: bool, given: Callable[[int], Iterator[Sorted]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Induce what is of the one type from what is given of the other: (block, places, common, which are given), in the order of the scan.

        Common prefixes are with the suffix before in the scan. Downwards, symbols count from the top.
        """
        top = self.symbols - 1
        blocks = np.stack([top - self.blocks[::-1, 1] + 1, top - self.blocks[::-1, 0] + 1], axis=1) if down else self.blocks
        self.down, self.queue = down, BulkQueue(blocks[:, 0], self.memory)
        self.since, self.last = np.full(self.symbols, _NONE), None
        for i, (low, high) in enumerate(blocks.tolist()):
            b = len(blocks) - 1 - i if down else i
            if high - low > 1:
                parts = list(given(b))
                own = tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.uint8))
                found = self._block(i, low, high, *own)
                if len(found[0]):
                    self._feed(found[0], found[1], high)
                    yield b, *found
                continue
            for _, p, c in self.queue.drain(i, CHUNK):
                p, c = self._joined(p, c)
                if len(p) >= 64 or self.queue.runs[i]:
                    self._feed(p, c, low)
                    yield b, p, c, np.zeros(len(p), bool)
                    continue
                self._feed(p, c, high)  # few suffixes of long runs are left, and nothing waits: take what precedes them at once
                yield b, p, c, np.zeros(len(p), bool)
                p = self._run_before(p)
                for at in range(0, len(p), CHUNK):
                    q = p[at : at + CHUNK]
                    before = self.last
                    c = self.measure(np.append(before, q[:-1]), q)
                    self.last = q[-1:]
                    self._feed(q, c, high)
                    yield b, q, c, np.zeros(len(q), bool)
            fresh = True
            for p, c in given(b):
                p, c = self._joined(p, c, fresh)
                fresh = False
                self._feed(p, c, high)
                yield b, p, c, np.ones(len(p), bool)

    def _symbol(self, p: np.ndarray) -> np.ndarray:
        return (self.symbols - 1 - self.t[p].astype(np.int64) if self.down else self.t[p]).astype(np.uint32)

    def _before(self, p: np.ndarray) -> np.ndarray:
        """Which suffixes have one before them that this scan induces."""
        s = self.s[np.maximum(p, 1) - 1]
        return (p > 0) & (s if self.down else ~s)

    def _joined(self, p: np.ndarray, c: np.ndarray, fresh: bool = False) -> Sorted:
        """A run as it follows what was scanned before; the first value is measured unless it was carried."""
        c = c.copy()
        if fresh or self.last is None or c[0] == _NONE or self.t[self.last[0]] != self.t[p[0]]:
            c[0] = 0 if self.last is None else self.measure(self.last, p[:1])[0]
        self.last = p[-1:]
        return p, c

    def _feed(self, place: np.ndarray, common: np.ndarray, least: int) -> None:
        """Queue the suffixes that scanned ones induce, of the symbols from least on."""
        place = place.astype(np.int64)
        at = np.flatnonzero(self._before(place))
        symbol = self._symbol(place[at] - 1)
        if len(at):
            far = symbol >= least
            at, symbol = at[far], symbol[far]
        lowest = np.minimum.accumulate(common)
        self.since, since = np.minimum(self.since, lowest[-1]), self.since
        if not len(at):
            return
        by = _by_symbol(symbol)
        at, symbol = at[by], symbol[by]
        first = np.ones(len(at), bool)
        first[1:] = symbol[1:] != symbol[:-1]
        value = np.empty(len(at), np.uint8)
        value[first] = np.minimum(lowest[at[first]], since[symbol[first]])
        rest = np.flatnonzero(~first)
        if len(rest):
            value[rest] = _Least(common)(at[rest - 1] + 1, at[rest])
        ends = at[np.append(first[1:], True)]
        after = np.append(np.minimum.accumulate(common[::-1])[::-1], _NONE)
        self.since[symbol[first]] = after[ends + 1]
        before = place[at] - 1
        value = np.minimum(value.astype(np.int64) + (1 if self.adv is None else self.adv[before]), self.limit)
        self.queue.push(symbol, before.astype(np.uint32), value.astype(np.uint8))

    def _run_before(self, p: np.ndarray) -> np.ndarray:
        """All suffixes that the runs of one symbol before p induce, in the order of the scan: nearer ones first."""
        sizes = []
        for at in p.tolist():
            step, low = 64, at
            while low > 0:
                part = self.t[max(0, low - step) : low] == self.t[at]
                if not part.all():
                    low -= int(part[::-1].argmin())
                    break
                low, step = max(0, low - step), min(2 * step, CHUNK)
            sizes.append(at - low)
        sizes = np.array(sizes, np.int64)
        back = np.arange(1, int(sizes.sum()) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        by = np.argsort(back, kind="stable")
        return (np.repeat(p.astype(np.int64), sizes) - back)[by].astype(np.uint32)

    def _block(self, i: int, low: int, high: int, given: np.ndarray, given_common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A block of several symbols: what is queued, what is given and what these induce within the block, in order."""
        symbol, place, common = self.queue.pop(i)
        n, m = len(place), len(given)
        nodes, by = [place.astype(np.int64), given.astype(np.int64)], [np.full(n + m, -1, np.int64)]
        edge, total = np.concatenate(nodes), n + m
        number = np.arange(total)
        while len(edge):
            ok = np.flatnonzero(self._before(edge))
            before = edge[ok] - 1
            near = self._symbol(before) < high
            edge, own = before[near], number[ok[near]]
            number = np.arange(total, total + len(edge))
            nodes.append(edge)
            by.append(own)
            total += len(edge)
        node, by = np.concatenate(nodes), np.concatenate(by)
        kind = np.ones(total, np.int64)  # induced from outside, within the block, given
        kind[:n], kind[n : n + m] = 0, 2
        key = (self._symbol(node).astype(np.int64) - low) * 3 + kind
        final = _by_symbol(key)
        rank = np.empty(total, np.int64)
        rank[final] = np.arange(total)
        # a known suffix has its own rank; those induced within share that of the first until they are told apart
        inner = kind == 1
        if total > n + m:
            own = np.flatnonzero(inner)
            value, first = key[own], rank[own]
            group = np.lexsort((first, value))
            new = np.append(True, value[group][1:] != value[group][:-1])
            rank[own[group]] = first[group][np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        jump = np.where(by < 0, np.arange(total), by)
        items = np.flatnonzero(inner)
        while len(items):
            sort = np.lexsort((rank[jump[items]], rank[items]))
            items = items[sort]
            first, second = rank[items], rank[jump[items]]
            group = np.append(True, first[1:] != first[:-1])
            new = group | np.append(True, second[1:] != second[:-1])
            at = np.arange(len(items))
            rank[items] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            if new.all():
                break
            further = jump[jump]
            if (further == jump).all():  # what is still tied has the limit in common
                for a, b in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(items)), strict=True):
                    rank[items[a:b]] += np.arange(b - a)
                break
            jump = further
        own = np.flatnonzero(inner)
        final[rank[own]] = own
        p = node[final]
        carried = np.concatenate([common, given_common, np.zeros(total - n - m, np.uint8)])[final]
        k = kind[final]
        measured = np.ones(total, bool)
        measured[1:] = (k[1:] != k[:-1]) | (k[1:] == 1) | (key[final][1:] != key[final][:-1]) | (carried[1:] == _NONE)
        at = np.flatnonzero(measured)
        if len(at):
            before = p[at - 1]
            if self.last is None:
                carried[at[0]] = 0
                carried[at[1:]] = self.measure(before[1:], p[at[1:]])
            else:
                before[0] = self.last[0]
                carried[at] = self.measure(before, p[at])
            self.last = p[-1:].astype(np.uint32)
        return p.astype(np.uint32), carried, k == 2


def sort_suffixes(t: np.ndarray, limit: int, memory: int = 32 << 20) -> Iterator[Sorted]:
    """All suffixes but the last one's in descending order of their first `limit` symbols, with the common prefix of each and the one before.

    t: symbols, the last one 0 and smaller than all others. limit: at most 200. memory: about how many bytes
    of queues are held and, eight times as many in all, of arrays before they are mapped from files.
    """
    if limit > 200:
        raise ValueError("the limit must be 200 at most")
    source = Source(t, limit, memory)
    return Level(source.t, source.n, None, source, memory).descending()
