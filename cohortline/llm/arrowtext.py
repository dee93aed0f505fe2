"""Arrow batches of texts as numpy arrays: bounded slices, word spans and word hashes.

Texts are handled as their UTF-8 bytes, a slice of rows at a time, so a task holds a
few megabytes whatever the size of its partition. A null text counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import small_batches

SLICE_BYTES = 1 << 20
_U = np.uint64
#: Odd multipliers of the polynomial hashes and of the final mixing.
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (xor-shift and multiply); a bijection."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _M1
        x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values that look random."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1_000_003)) * _P)


def byte_table(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte; with lower, A-Z have the values of a-z."""
    table = seeded(256, 7)
    if lower:
        table[65:91] = table[97:123]
    return table


def space_words() -> np.ndarray:
    """Which bytes belong to words that white space (0x20, 0x09-0x0D) parts."""
    ok = np.ones(256, bool)
    ok[[0x20, *range(0x09, 0x0E)]] = False
    return ok


def alnum_words() -> np.ndarray:
    """Which bytes belong to words of ASCII digits, ASCII letters and all beyond ASCII."""
    ok = np.zeros(256, bool)
    ok[0x30:0x3A] = ok[0x41:0x5B] = ok[0x61:0x7B] = ok[0x80:] = True
    return ok


#: Scripts written without spaces (Thai to Burmese, Khmer, kana, Han and what lies between), as ranges of code points.
UNSPACED = [(0x0E00, 0x1080), (0x1780, 0x1800), (0x3000, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000)]


def _unspaced_leads() -> np.ndarray:
    """Whether a code point whose first two bytes are i >> 8 and i & 255 belongs to such a script."""
    ok = np.zeros(1 << 16, bool)
    for low, high in UNSPACED:
        for c in range(low, high, 64):
            lead = chr(c).encode()
            ok[lead[0] << 8 | lead[1]] = True
    return ok


_UNSPACED_LEADS = _unspaced_leads()


class _Powers:
    """Powers of an odd base and their inverses mod 2^64, grown on demand."""

    def __init__(self, base: np.uint64):
        inverse = pow(int(base), -1, 1 << 64)
        self.bases, self.n = (base, _U(inverse)), 0
        self.up = self.down = np.zeros(0, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            grown = []
            with np.errstate(over="ignore"):
                for b in self.bases:
                    a = np.full(self.n, b, _U)
                    a[0] = 1
                    grown.append(np.cumprod(a, dtype=_U))
            self.up, self.down = grown
        return self.up, self.down


_POWERS = _Powers(_P)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base of rolling hashes, more than n of them, and their inverses."""
    return _POWERS.get(n + 1)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte runs: eight bytes at a time, each mixed in; of long runs by blake2b. Seeds give independent hashes."""
    low = np.zeros(len(data) + 8, np.uint8)
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    low[:-8] = table[data]
    eight = np.ndarray((len(data) + 1,), "<u8", low, 0, (1,))
    size = ends - starts
    salt = seeded(2, 1001 + seed)
    with np.errstate(over="ignore"):
        out = size.astype(_U) * _P + salt[0]
        going = np.flatnonzero(size <= LONG_WORD)
        for k in range(0, LONG_WORD, 8):
            left = size[going] - k
            going, left = going[left > 0], left[left > 0]
            if not len(going):
                break
            x = eight[starts[going] + k] << (8 * np.maximum(8 - left, 0)).astype(_U)
            out[going] = mix((out[going] ^ x) * _Q + salt[1])
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([seed])).digest(), "little")
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one offset more than texts)."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, body = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if body is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words of a slice of texts: byte spans, the text each belongs to, 64-bit hashes.

    Words never reach from one text into the next. bounds[i] and bounds[i + 1] limit
    the words of text i. With longest, each code point of a script without spaces is a word,
    and so is each code point of a word of more than so many bytes.
    """

    def __init__(self, texts: pa.Array, in_word: np.ndarray, lower: bool = True, longest: int | None = None):
        self.data, self.offsets = text_bytes(texts)
        n_texts, n = len(texts), len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = in_word[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        here, before = inside[1:], inside[:-1]
        if longest is not None:
            self._part_unspaced(first)
        self._span(here, before, first)
        if longest is not None and len(long := np.flatnonzero(self.ends - self.starts > longest)):
            depth = np.zeros(n + 1, np.int8)
            depth[self.starts[long]] += 1
            depth[self.ends[long]] -= 1
            first[:-1] |= (np.cumsum(depth[:-1], dtype=np.int8) > 0) & ((self.data & 0xC0) != 0x80)
            self._span(here, before, first)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.text = np.repeat(np.arange(n_texts), np.diff(self.bounds))
        self.lower = lower
        self.hash = self.hashes(0)

    def hashes(self, seed: int) -> np.ndarray:
        """Hashes of the words that are independent of those by another seed; `hash` has those of seed 0."""
        return word_hashes(self.data, self.starts, self.ends, self.lower, seed)

    def _span(self, here: np.ndarray, before: np.ndarray, first: np.ndarray) -> None:
        self.starts = np.flatnonzero(here[:-1] & (~before[:-1] | first[:-1]))
        self.ends = np.flatnonzero(before[1:] & (~here[1:] | first[1:])) + 1

    def _part_unspaced(self, first: np.ndarray) -> None:
        """Mark the beginning and the end of each code point of a script without spaces."""
        at = np.flatnonzero(self.data >= 0xE0)
        lead = self.data[at].astype(np.int64)
        at, lead = (x[_UNSPACED_LEADS[lead << 8 | self.data[at + 1]]] for x in (at, lead))
        first[at] = True
        first[at + np.where(lead < 0xF0, 3, 4)] = True

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def shingles(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the text of each; the same runs in the same order for all seeds.

        A text of fewer words, but not none, has its whole sequence as one run.
        """
        n, counts = len(self), self.counts()
        hash_ = self.hashes(seed) if seed else self.hash
        hashes, owners = [], []
        with np.errstate(over="ignore"):
            if n >= k:
                run = np.zeros(n - k + 1, _U)
                for j in range(k):
                    run = mix(run * _Q + hash_[j : n - k + 1 + j])
                ok = self.text[: n - k + 1] == self.text[k - 1 :]
                hashes.append(mix(run[ok] + _U(k)))
                owners.append(self.text[: n - k + 1][ok])
            for m in range(1, k):
                short = np.flatnonzero(counts == m)
                if len(short):
                    run = np.zeros(len(short), _U)
                    for j in range(m):
                        run = mix(run * _Q + hash_[self.bounds[short] + j])
                    hashes.append(mix(run + _U(m)))
                    owners.append(short)
        if not hashes:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return hashes[order], owners[order]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about limit bytes at most; a longer text comes alone."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which Spark keeps for other tasks, gives back the memory it no longer uses."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return inner


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def with_text_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """df with columns computed from one text column, slice by slice.

    make() is called once in each task; what it returns maps the texts of a slice to one
    array for each field. A column of df that has the name of a field is replaced.
    """
    if text in {f.name for f in fields}:
        raise ValueError(f"the text column {text!r} has the name of an output column")
    small_batches(df.sparkSession)
    df = df.drop(*[f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, text):
                new = compute(part.column(part.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, schema)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each row, counts[i] of the values at a time."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
