"""Merge-type subword encoding by backtracking, and decoding.

A sequence of pieces is the encoding of a text exactly if every two neighbours are
compatible: merging their characters again, best score first, gives the two pieces back.
One run of the Aho-Corasick automaton over a stretch gives the longest piece that begins at each
position. The encoder takes that of the current position, checks it against the piece before, takes the next shorter one if they aren't
compatible, and goes one piece back if none is left. A bitfield keeps the positions that
no encoding can pass, so nothing is tried twice.

Texts are cut first where no piece of the vocabulary has the two characters side by side:
no merge crosses such a place. The stretches between repeat, so each worker keeps the model and
the encodings of stretches it has seen over all its tasks, up to a fixed number; those met again stay longest.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import list_array, with_text_columns

SPACE = "▁"
KEEP, FITS = 450_000, 200_000


class PieceModel:
    """The vocabulary of a model file: pieces, scores, byte pieces and the characters that meet in a piece."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model must have a piece for every byte")
        if sp.encode("ﬁ a  b ", out_type=str)[:1] != [SPACE] and SPACE + "ﬁ" not in self.pieces:
            raise ValueError("the model must not normalise texts")
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.met = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.raw = [b""] * n
        for p, i in self.ids.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        if 0 <= self.unk < n:
            self.raw[self.unk] = " ⁇ ".encode()
        self.trie = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or self.merge(list(p)) == [p]:  # a piece that merging can't make is never in an encoding
                self.trie.add_word(p, len(p))
        self.trie.make_automaton()
        #: The longest shorter piece that a piece begins with.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if self.trie.exists(p[:n])), "") for p in self.trie.keys()}
        self.fits: dict[tuple[str, str], bool] = {}

    def merge(self, parts: list[str]) -> list[str]:
        """Join the neighbours of the best score, the first of equals, until none can be joined."""
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if a[-1] + b[0] not in self.met:
            return True
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(list(a + b)) == [a, b]
        return known

    def longest(self, text: str) -> list[int]:
        """The length of the longest piece that begins at each position; a character without a piece stands for itself."""
        size = [1] * len(text)
        for end, n in self.trie.iter(text):
            if n > size[end - n + 1]:
                size[end - n + 1] = n
        return size

    def backtrack(self, text: str) -> list[str]:
        n, at, last = len(text), 0, ""
        out: list[str] = []
        open_ = bytearray(b"\1") * (n + 1)
        fits, shorter, longest = self.fits, self.shorter, self.longest(text)
        p = text[: longest[0]] if n else ""
        while p:
            end = at + len(p)
            if open_[end] and (not last or (fits[last, p] if (last, p) in fits else self.compatible(last, p))):
                out.append(p)
                at, last = end, p
                p = text[at : at + longest[at]] if at < n else ""
            elif q := shorter.get(p):
                p = q
            else:  # nothing that begins here leads to an encoding: take the piece before back
                if not out:
                    raise RuntimeError("no encoding was found")
                open_[at] = 0
                back = out.pop()
                at -= len(back)
                last = out[-1] if out else ""
                p = shorter.get(back, "")
                while not p:
                    if not out:
                        raise RuntimeError("no encoding was found")
                    open_[at] = 0
                    back = out.pop()
                    at -= len(back)
                    last = out[-1] if out else ""
                    p = shorter.get(back, "")
        return out

    def piece_ids(self, pieces: list[str]) -> list[int]:
        ids = self.ids
        try:
            return [ids[p] for p in pieces]
        except KeyError:  # a character without a piece is its bytes
            return [i for p in pieces for i in ([ids[p]] if p in ids else [self.byte_ids[b] for b in p.encode()])]


class _Seen(dict):
    """The ids of stretches, as bytes of 32-bit integers; those not seen yet are worked out.

    Two generations of KEEP / 2: what is met again while it is in the older one moves to the newer one.
    """

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute = compute
        self.older: dict[str, bytes] = {}

    def __missing__(self, s: str) -> bytes:
        ids = self.older.get(s)
        if ids is None:
            ids = self.compute(s)
        if len(s) <= 64:
            if len(self) >= KEEP // 2:
                self.older = dict(self)
                self.clear()
            self[s] = ids
        return ids


class Encoder:
    """Encodes and decodes whole texts."""

    def __init__(self, model: bytes):
        self.model = PieceModel(model)
        self.seen = _Seen(self._stretch_ids)
        met = self.model.met
        self.cuts = [c for c in "\n\t" if not any(c in x for x in met)]
        self.spaces = not any(x[0] != SPACE and x[1] == SPACE for x in met)

    def stretches(self, text: str) -> list[str]:
        """Parts of the text with its spaces marked, between which no merge is possible."""
        text = SPACE + text.replace(" ", SPACE) if text else ""
        if not self.spaces or "\0" in text:
            return [text] if text else []
        text = text.replace(SPACE, "\0" + SPACE)
        while SPACE + "\0" + SPACE in text:  # a run of spaces stays whole
            text = text.replace(SPACE + "\0" + SPACE, SPACE + SPACE)
        for c in self.cuts:
            if c in text:
                text = text.replace(c, "\0" + c + "\0")
        return [x for x in text.split("\0") if x]

    def _stretch_ids(self, s: str) -> bytes:
        if 1 < len(s) <= 64 and not s[-1].isalnum() and s[-2] + s[-1] not in self.model.met:
            return self.seen[s[:-1]] + self.seen[s[-1]]  # a mark at the end that never joins what is before it
        return array("i", self.model.piece_ids(self.model.backtrack(s))).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """The ids as bytes of 32-bit integers, without an end."""
        return b"".join(map(self.seen.__getitem__, self.stretches(text)))

    def encode(self, text: str, end: bool = True) -> list[int]:
        ids = array("i", self.encode_bytes(text)).tolist()
        return [*ids, self.model.eos] if end else ids

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: byte pieces are joined, bytes that aren't UTF-8 become U+FFFD, the first space goes."""
        raw = self.model.raw
        body = b"".join(map(raw.__getitem__, ids))
        if ids and body[:1] == b" " and ids[0] not in self.model.byte_ids.values():
            body = body[1:]
        return body.decode("utf-8", "replace")


@lru_cache(1)
def worker_encoder(model: bytes) -> Encoder:
    """The encoder of this process, made once and kept for all its tasks."""
    return Encoder(model)


def encode_pieces(df: DataFrame, model: bytes, text: str = "text", end: bool = True, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the ids (array<int>) of each whole text, as the library of the model encodes it.

    With decoded, also that column: the ids decoded again. A null or empty text has the
    end id alone (or nothing, without it) and decodes to the empty text. Rows, repeated ones
    too, keep all their columns; those named like an output are replaced; an empty table stays
    empty. model: the bytes of a model of the merge type with byte pieces and without
    normalisation (under a megabyte; they go to the tasks with the job).
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        encoder = worker_encoder(model)
        last = np.array([encoder.model.eos] if end else [], np.int32).tobytes()

        def compute(texts: pa.Array) -> list[pa.Array]:
            rows = [encoder.encode_bytes(t or "") + last for t in texts.to_pylist()]
            counts = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            out = [list_array(np.frombuffer(b"".join(rows), np.int32), counts, pa.int32())]
            if decoded:
                out.append(pa.array([encoder.decode(array("i", r).tolist()) for r in rows], pa.string()))
            return out

        return compute

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    return with_text_columns(df, text, fields + ([T.StructField(decoded, T.StringType())] if decoded else []), make)


def decode_pieces(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; no ids or null give the empty text, control ids give nothing."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(model)
        for rows in batches:
            yield rows.map(lambda x: "" if x is None else encoder.decode(list(map(int, x))))

    return df.drop(out).withColumn(out, F.pandas_udf(decode, "string")(F.col(ids)))
