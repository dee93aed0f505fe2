"""Spelling variants: words one edit apart, found with a bidirectional FM-index over a delimited vocabulary.

An edit lies in one half of a word, so the other half is the same in both words. The search scheme has two searches: the
first half and the delimiter before it are matched exactly, then the rest is extended to the right allowing one error; or the second half and the
delimiter after it, then the rest to the left. An index holds the rank intervals of a string among the sorted
suffixes of the vocabulary and of its reverse at the same time, so both directions are steps of the same kind. All
queries of a task are extended together, a symbol at a time.

Words meet by their halves: a row for each half that a word has as a query, and as a near word of queries a symbol shorter, as
long or longer. The rows are dealt by (side, length, half) to tasks that index what they get. A half of very many
words is dealt in parts: the near words to one part each, the queries to all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .oracles import LOWER, UPPER
from .tables import SEND_IDS, written

#: Runs of letters: ASCII and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST, RATIO = 7, 2, 10
#: Rows of one half that a task gets, and rows of a pack of halves.
PART, PACK = 20_000, 50_000
BLOCK, QUERIES = 16, 8_192


def words_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", drop_one_in: int | None = 31) -> DataFrame:
    """(word) of each run of letters in each text, A-Z lower-cased, as often as it stands there.

    With drop_one_in: where that number divides the crc32 of `<id>:<run>`, the run's code point at crc32 modulo its length goes. A null id counts as an empty one there.
    """
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("w"))
    if drop_one_in is None:
        return runs.select(F.col("w").alias("word"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("i", F.lit(":"), "w"), "UTF-8")))
    at = F.pmod("h", F.char_length("w")).cast("int")
    less = F.concat(F.substring("w", 1, at), F.substring("w", at + 2, F.char_length("w")))
    return runs.select(F.when(F.col("h") % drop_one_in == 0, less).otherwise(F.col("w")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of so many code points and so many occurrences or more."""
    return words.filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


class FMIndex:
    """Suffix ranks of a sequence of symbols from 1 on, whose end is a symbol 0 of its own."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        text = np.append(symbols, 0).astype(np.uint8)
        self.places = self._sorted(text, kinds)
        n = len(text)
        last = text[self.places - 1]  # the symbol before each suffix
        blocks = n // BLOCK + 1
        padded = np.full(blocks * BLOCK, 255, np.uint8)
        padded[:n] = last
        self.last = padded.reshape(blocks, BLOCK)
        each = np.zeros((blocks + 1, kinds), np.int32)
        np.add.at(each, (np.arange(n) // BLOCK + 1, last), 1)
        #: How often each symbol stands before each block.
        self.before = np.cumsum(each, axis=0, dtype=np.int32)[:blocks]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))[:-1]])
        self.n = n

    @staticmethod
    def _sorted(text: np.ndarray, kinds: int) -> np.ndarray:
        """All suffixes in order: by as many symbols as fit a number, then by ranks of twice as many until all differ."""
        n, width = len(text), int(62 // np.log2(kinds + 1))
        key = np.zeros(n, np.int64)
        padded = np.concatenate([text, np.zeros(width, np.uint8)]).astype(np.int64)
        for i in range(width):
            key = key * (kinds + 1) + padded[i : n + i]
        step = width
        while True:
            order = np.argsort(key, kind="stable")
            new = np.append(False, key[order[1:]] != key[order[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n - 1:
                return order
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            step *= 2

    def count(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the first `at` suffixes."""
        block, rest = at // BLOCK, at % BLOCK
        here = (self.last[block] == symbol[:, None]) & (np.arange(BLOCK) < rest[:, None])
        return self.before[block, symbol] + here.sum(axis=1)

    def counts(self, at: np.ndarray) -> np.ndarray:
        """The same for all symbols: a row for each place."""
        block, rest = at // BLOCK, at % BLOCK
        out = self.before[block].astype(np.int64)
        for i in range(BLOCK):
            inside = np.flatnonzero(rest > i)
            out[inside, self.last[block[inside], i]] += 1
        return out

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the strings with the symbol put before them."""
        first = self.first[symbol]
        return first + self.count(symbol, low), first + self.count(symbol, high)


class WordIndex:
    """A bidirectional index of distinct words, each between delimiters, and the two searches."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        letters, codes = np.unique(points, return_inverse=True)
        self.codes = (codes + 2).astype(np.uint8)  # 0: the end, 1: the delimiter
        if len(letters) > 200:
            raise ValueError("words may have 200 different characters at most")
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = len(points) + len(words) + 1
        text = np.ones(n, np.uint8)
        where = np.arange(len(points)) + np.repeat(np.arange(1, len(words) + 1), self.sizes)
        text[where] = self.codes
        self.kinds = len(letters) + 2
        self.forward, self.reverse = FMIndex(text, self.kinds), FMIndex(text[::-1], self.kinds)
        #: The word that follows the delimiter at a place, and the word that precedes it.
        self.word_at = np.zeros(n + 1, np.int64)
        delimiters = self.starts + np.arange(len(words))
        self.word_at[delimiters] = np.arange(len(words))
        self.word_before = np.zeros(n + 1, np.int64)
        self.word_before[delimiters + self.sizes + 1] = np.arange(len(words))
        self.length = n

    def exact(self, begin: np.ndarray, size: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Intervals, in the index in which they are extended next, of strings of codes (begin, size) with the delimiter on their outer side.

        left: the string begins a word, is matched from its last symbol to the delimiter before it, and is then extended to the right. Both
        intervals are kept on the way: a step changes one by ranks, and the other by how many smaller symbols stand there.
        """
        here, there = (self.forward, self.reverse) if left else (self.reverse, self.forward)
        n = len(begin)
        low, high, other = np.zeros(n, np.int64), np.full(n, here.n), np.zeros(n, np.int64)
        for i in range(int(size.max(initial=0)) + 1):
            going = np.flatnonzero(i <= size)
            at = begin[going] + (size[going] - 1 - i if left else i)
            symbol = np.where(i < size[going], self.codes[np.clip(at, 0, len(self.codes) - 1)], 1).astype(np.int64)
            a, b = here.counts(low[going]), here.counts(high[going])
            smaller = np.cumsum(b - a, axis=1)[np.arange(len(going)), symbol - 1]  # the end's symbol 0 is smaller than all
            row = np.arange(len(going))
            low[going], high[going] = here.first[symbol] + a[row, symbol], here.first[symbol] + b[row, symbol]
            other[going] += smaller
        return other, other + np.maximum(high - low, 0)

    def near(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in query, word): words with exactly one edit in the half that follows, from the intervals of the half matched."""
        index = self.reverse if right else self.forward
        half = self.sizes[query] // 2
        rest = self.sizes[query] - half if right else half
        at_first = self.starts[query] + half if right else self.starts[query] + half - 1
        sign = 1 if right else -1

        def wanted(q: np.ndarray, i: int) -> np.ndarray:
            at = np.clip(at_first[q] + sign * i, 0, len(self.codes) - 1)
            return np.where(i < rest[q], self.codes[at], 1).astype(np.int64)

        whole = np.flatnonzero(high > low)
        whole_low, whole_high = low[whole], high[whole]
        erred = [np.zeros(0, np.int64)] * 3
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(int(rest.max(initial=0)) + 1):
            if not len(whole) and not len(erred[0]):
                break
            want = wanted(whole, i)
            a, b = index.counts(whole_low), index.counts(whole_high)
            child, symbol = np.nonzero(b - a)
            letter = symbol > 1
            child, symbol = child[letter], symbol[letter]
            child_low, child_high = index.first[symbol] + a[child, symbol], index.first[symbol] + b[child, symbol]
            # one more letter in the word found: the wanted one comes after it
            now = [np.concatenate(x) for x in zip(erred, (whole[child], child_low, child_high), strict=True)]
            symbol_now = wanted(now[0], i)
            stepped = index.step(symbol_now, now[1], now[2])
            kept = stepped[1] > stepped[0]
            done = kept & (i == rest[now[0]])
            found.append((now[0][done], stepped[0][done]))
            kept &= ~done
            later = [(now[0][kept], stepped[0][kept], stepped[1][kept])]
            # another letter instead of the wanted one, or none
            inside = i < rest[whole]
            other = inside[child] & (symbol != want[child])
            later += [(whole[child][other], child_low[other], child_high[other]), (whole[inside], whole_low[inside], whole_high[inside])]
            erred = [np.concatenate(x) for x in zip(*later, strict=True)]
            row = np.flatnonzero(inside)
            whole_low, whole_high = index.first[want[row]] + a[row, want[row]], index.first[want[row]] + b[row, want[row]]
            alive = whole_high > whole_low
            whole, whole_low, whole_high = whole[row][alive], whole_low[alive], whole_high[alive]
        q = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in found]])
        place = index.places[np.concatenate([np.zeros(0, np.int64), *[x for _, x in found]])]
        word = self.word_before[self.length - 1 - place] if right else self.word_at[place]
        if not len(q):
            return q, word
        both = np.unique(q * len(self.sizes) + word)  # several edits may lead to one word
        return both // len(self.sizes), both % len(self.sizes)


def _searcher() -> Callable[[pa.Table], pa.Table]:
    def compute(rows: pa.Table) -> pa.Table:
        left, part, is_query, is_target, n = (rows[c].to_numpy() for c in ("left", "part", "is_query", "is_target", "n"))
        words, half, length = rows["word"].to_pylist(), rows["half"].to_pylist(), rows["length"].to_numpy()
        names = sorted(set(words))  # in the order of code points
        number = {w: i for i, w in enumerate(names)}
        word = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        counts = np.zeros(len(names), np.int64)
        counts[word] = n
        keys: dict[tuple, int] = {}
        key = np.fromiter((keys.setdefault(k, len(keys)) for k in zip(left.tolist(), length.tolist(), half, part.tolist(), strict=True)), np.int64, len(words))
        targets = np.unique(key[is_target] * len(names) + word[is_target])
        index = WordIndex(names)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for side in (True, False):
            own = np.flatnonzero(is_query & (left == side))
            for at in range(0, len(own), QUERIES):
                row = own[at : at + QUERIES]
                q = word[row]
                h = index.sizes[q] // 2
                begin, size = (index.starts[q], h) if side else (index.starts[q] + h, index.sizes[q] - h)
                one, back = np.unique(key[row], return_index=True)  # equal halves are matched once
                low, high = index.exact(begin[back], size[back], side)
                of = np.searchsorted(one, key[row])
                place, other = index.near(q, low[of], high[of], side)
                mine = np.isin(key[row][place] * len(names) + other, targets)
                place, other = place[mine], other[mine]
                if not side:  # those with the same first half were found by the other search
                    fresh = np.fromiter((not names[b].startswith(names[a][: len(names[a]) // 2]) for a, b in zip(q[place].tolist(), other.tolist(), strict=True)), bool, len(place))
                    place, other = place[fresh], other[fresh]
                out.append((q[place], other))
        q, other = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in out]]) for k in (0, 1))
        order = np.lexsort((other, -counts[other], q))
        q, other = q[order], other[order]
        begins = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
        much = np.diff(np.append(begins, len(q)))
        pick = lambda i: pa.array([names[k] for k in i.tolist()], pa.string())
        best = other[begins]
        return pa.table({"word": pick(q[begins]), "n_near": pa.array(much, pa.int64()), "best": pick(best), "best_n": pa.array(counts[best], pa.int64())})

    return compute


def near_words(words: DataFrame, part: int | None = None) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n), distinct and of two letters or more, that have near ones: how many
    words differ by exactly one inserted, deleted or replaced code point, and the most frequent of them (the smallest of equals)."""
    spark, part = words.sparkSession, part or PART
    size = F.char_length("word")

    def halves(length: Column) -> Column:
        h = F.floor(length / 2).cast("int")
        of = lambda left, half: F.struct(F.lit(left).alias("left"), length.alias("length"), half.alias("half"), (length == size).alias("is_query"))
        return F.array(of(True, F.substring("word", F.lit(1), h)), of(False, F.right("word", length - h)))

    every = F.flatten(F.array(*[halves(size + d) for d in (-1, 0, 1)]))
    rows = words.select("word", "n", F.explode(every).alias("k")).select("word", "n", "k.*")
    rows = written(rows, "halves")
    key = ["left", "length", "half"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("c"), F.max("is_query").alias("asked")).filter("c > 1 AND asked")
    hot = written(sizes.filter(F.col("c") > part).select(*key, F.ceil(F.col("c") / part).cast("int").alias("parts")), "hot")
    found = hot.limit(SEND_IDS + 1).count()
    total = rows.count()
    if found:
        rows = rows.join(F.broadcast(hot) if found <= SEND_IDS else hot, key, "left")
        own = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int")
        rows = rows.withColumn("own", own)
        asked = F.col("is_query") & F.col("parts").isNotNull()
        rows = rows.withColumn("part", F.explode(F.when(asked, F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array("own"))))
        rows = rows.withColumn("is_target", F.col("part") == F.col("own")).drop("parts", "own")
    else:
        rows = rows.withColumns({"part": F.lit(0), "is_target": F.lit(True)})
    packs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // PACK + 1)
    some = rows.groupBy(F.pmod(F.xxhash64(*key, "part"), F.lit(packs)).alias("pack")).applyInArrow(_searcher(), "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    return some.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), form not null: forms followed to the last. Every round doubles the way, so few are needed."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("_r"))
        after = written(now.join(next_, "root", "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "roots")
        now = after.select("word", "root")
        if not after.filter("_moved").head(1):
            return now


def spelling_forms(words: DataFrame, ratio: int = RATIO, part: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    n_near: how many words differ by exactly one inserted, deleted or replaced code point. form: the most frequent of them, the
    smallest in the order of code points of equals, if it is at least `ratio` times as frequent as the word, else null, and form_n
    its n. root: forms followed from the word to the last, the word itself without a form. No words give no rows.
    """
    near = near_words(words, part)
    out = words.join(near, "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    last = roots(out.filter("form IS NOT NULL"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", drop_one_in: int | None = 31) -> DataFrame:
    """spelling_forms of the vocabulary of all texts: words of 7 code points and 2 occurrences or more.

    A null or empty text has no words; repeated rows count each time; texts of any length and other columns do no harm.
    """
    return spelling_forms(written(vocabulary(words_of(docs, id_col, text, drop_one_in)), "words"))
