"""Operators against brute force on small tables with nulls, ties, repeats, long and empty texts and extra columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortline.llm import arrowtext, decontaminate, fingerprint, induced, licenses, maxent, neardup, pieces, preferences, quality, repeats, sharding, tables

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def prose(rng, n):
    vocabulary = ["the", "of", "Und", "naïve", "straße", "data", "x1", "engine,", "spark.", "日本", "été"] + [f"w{i}" for i in range(60)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with exact and near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    base = prose(rng, 120).split()
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(99)}"
        texts.append(" ".join(copy))
    passage = prose(rng, 40)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 9)}" for _ in range(8)]
    texts += [texts[3], texts[3], None, "", "   ", "one", "ONE", "a b c d", "za " * 800, "é" * 260, prose(rng, 4000)]
    rng.shuffle(texts)
    return [(i * 3, t, "en", f"s{i % 2}", None if t is None or i % 5 == 0 else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# op1


def test_fingerprints(docs):
    out = rows(fingerprint.with_neighbours(docs, part_chars=3000))
    data = sorted((i, t or "") for i, t, *_ in corpus())
    sampler = fingerprint.Sampler()
    for (i, t), (_, u) in zip(data, data[1:] + data[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        one, changed, following = fingerprint.fingerprint_texts([t, edited, u], sampler)
        r = out[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert [r["fingerprint"], r["edited_fingerprint"]] == fingerprint.as_hex([one, changed])
        assert (r["near_edited"], r["near_next"]) == ((one == changed).mean(), (one == following).mean())
    assert len(out) == len(data)


def test_fingerprint_likeness_is_generalised_jaccard():
    rng = np.random.default_rng(0)
    sampler = fingerprint.Sampler(coordinates=2000)
    terms = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    a[:60], b[240:] = 0, 0
    one, two = (sampler.samples(np.sort(terms[w > 0]), w[w > 0][np.argsort(terms[w > 0])]) for w in (a, b))
    assert (one == two).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def likeness_of_runs(a, b, k=5):
    one, two = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (a, b))
    return sum((one & two).values()) / sum((one | two).values())


def test_fingerprint_likeness_does_not_depend_on_length():
    rng = random.Random(5)
    sampler = fingerprint.Sampler(coordinates=2000)

    def near(a, b):
        one, two = fingerprint.fingerprint_texts([a, b], sampler)
        return (one == two).mean()

    for _ in range(5):  # near copies on both sides of 256 code points
        a = [rng.choice(["the", "of", "Und", "x1", "spark."]) + rng.choice(["", "", "er", "ly", str(rng.randrange(90))]) for _ in range(90)]
        while len(" ".join(a[1:])) >= 256:
            a.pop()
        if len(" ".join(a)) < 256:
            a[0] += "y" * 10
        assert len(" ".join(a)) >= 256 > len(" ".join(a[1:]))
        assert near(" ".join(a), " ".join(a[1:])) == pytest.approx(likeness_of_runs(words(" ".join(a)), words(" ".join(a[1:]))), abs=0.05)
    for alphabet in ("日本語文書検索機械学習", "กขคงจฉช", "ab(){};=.😀", "ab𠀀𠀁é日"):  # no spaces
        if alphabet.startswith("ab𠀀"):
            a = "".join(rng.choice("𠀀𠀁𠀂日本") for _ in range(300))
        else:
            a = "".join(rng.choice(alphabet) for _ in range(300))
        b = a[:120] + a[123:]
        assert near(a, b) == pytest.approx(likeness_of_runs(a, b), abs=0.05)
    assert near("日本 ab", "日本ab") == near("ab語cd", "ab 語 cd") == 1


def test_fingerprints_of_odd_tables(spark, empty):
    assert fingerprint.with_neighbours(empty).count() == 0
    one = fingerprint.with_neighbours(spark.createDataFrame([(None, "abcd", "x")], "doc_id long, text string, part string")).head()
    assert (one["doc_id"], one["near_edited"] < 1, one["near_next"]) == (None, True, 1.0)
    same = fingerprint.add_fingerprints(spark.createDataFrame([("a b c",), ("a b c",), (None,), ("",)], "text string"))
    values = [r["fingerprint"] for r in same.collect()]
    assert values[0] == values[1]
    assert values[2] == values[3]
    assert same.select(fingerprint.likeness("fingerprint", "fingerprint")).distinct().collect()[0][0] == 1.0


# op2


def brute_hits(text, items, window=13):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    w = find(text)
    hit, seen = set(), set()
    for i, t in items:
        own = find(t)
        m = min(window, len(own))
        for k in range(len(own) - m + 1 if m else 0):
            for at in range(len(w) - m + 1):
                if w[at : at + m] == own[k : k + m]:
                    hit.update(range(at, at + m))
                    seen.add(str(i))
    return len(w), len(hit), sorted(seen)


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_contamination(spark, docs, block):
    data = corpus()
    long = max((t or "" for _, t, *_ in data), key=len).split()
    items = [(7, " ".join(long[100:130])), (10, " ".join(long[110:140]).upper()), (11, "one"), (12, None), (13, "..."), (14, "x1 data"), (15, "nothing like it " * 5), (7, " ".join(long[100:130]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    out = rows(decontaminate.find_contamination(docs.withColumn("items", F.lit(1)), b, block_words=block))
    for i, t, *_ in data:
        r = out[i]
        assert (r["n_words"], r["n_hit"], sorted(r["items"])) == brute_hits(t, items)
        assert sum(s["end"] - s["first"] for s in r["hit_spans"]) == r["n_hit"]
    assert len(out) == len(data)


def test_contamination_with_many_patterns():
    """Shift tables grow with the patterns, so the search still jumps; hot suffixes are told apart by the first block."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [(str(i), " ".join(rng.choice(vocabulary, 400))) for i in range(150)]
    items += [(f"h{i}", f"a{i} b{i} " + "x " * 9 + "same end") for i in range(300)]
    m = decontaminate.Matcher(items, 13)
    (patterns,) = m.sets
    assert (patterns.shift == 0).mean() < 0.1
    assert len(np.unique(patterns.key)) >= len(patterns.key) - 2
    text = "z " + " ".join(items[3][1].split()[40:70]) + " q " + items[160][1]
    words, covered, found = m.search(pa.array([text]))
    assert found == [{"3", items[160][0]}]
    assert (covered > 0).sum() == 43


def test_contamination_of_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).filter("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(empty, none).count() == 0


# op3


def test_preferences(spark):
    c = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "a"), (None, 0, "user", "n"), (4, 0, None, None)], "conv_id long, turn long, role string, text string")
    r = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no <|im_end|>"), (3, 0, "user", "z"), (None, 0, "user", "n")], "conv_id long, turn long, role string, text string")
    out = rows(preferences.preference_pairs(c, r), "conv_id")
    one = out[1]
    assert one["n_common"] == 1
    assert one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert one["rejected"].count("<|im_end|>") == 1
    (span,) = one["chosen_mask"]
    assert one["chosen"][span["first"] : span["end"]] == "yes<|im_end|>"
    assert (out[2]["n_common"], out[2]["rejected"], out[3]["chosen"]) == (0, "", "")
    assert (out[None]["n_common"], out[None]["chosen"], out[None]["rejected"]) == (1, "", "")
    assert preferences.preference_pairs(c.limit(0), r.limit(0)).count() == 0


def test_preferences_compare_turns_before_rendering(spark):
    schema = "conv_id long, turn long, role string, text string, prompt string"
    c = spark.createDataFrame([(1, 0, "user", "say <|x", "p"), (2, 0, "a\nb", "c", "p"), (3, 0, "user", "hi", "p"), (3, 0, "user", "hi", "p"), (4, 0, "user", "z" * 50_000, None)], schema)
    r = spark.createDataFrame([(1, 0, "user", "say < |x", "p"), (2, 0, "a", "b\nc", "p"), (3, 0, "user", "hi", "p"), (3, 0, "user", "hi", "p"), (4, 0, "user", "z" * 50_000, None)], schema)
    out = rows(preferences.preference_pairs(c, r), "conv_id")
    assert [out[i]["n_common"] for i in (1, 2, 3, 4)] == [0, 0, 2, 1]
    assert out[1]["chosen"] == out[1]["rejected"] == "<|im_start|>user\nsay < |x<|im_end|>\n"


def test_swapped_answers(spark):
    t = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "one"), (0, 2, "assistant", "two"), (1, 0, "user", "r"), (1, 1, "assistant", "three"), (4, 0, "assistant", "alone"), (None, 0, "assistant", "n")], "conv_id long, turn long, role string, text string")
    out = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in preferences.swapped_answers(t).collect())
    assert out == [(0, 0, "user", "q"), (0, 1, "assistant", "one"), (0, 2, "assistant", "three"), (1, 0, "user", "r"), (1, 1, "assistant", "two")]


# op4


@pytest.mark.parametrize("shards", [1, 4, 7, 40])
def test_shards(docs, shards):
    out = sharding.shuffle_to_shards(docs.withColumn("cell", F.lit("x")), shards, seed=3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert len(sizes) == shards
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_to_shards(docs, shards, seed=4).collect()} != {(r["doc_id"], r["shard"], r["slot"]) for r in out} or shards == 1


def test_shuffles_are_uniform(spark):
    """Each of the 24 orders of four rows in two shards comes up about equally often over many seeds."""
    d = spark.createDataFrame([(i,) for i in range(4)], "doc_id long").repartition(2).cache()
    d.count()
    seen = Counter()
    sizes = np.array([2, 2])
    for seed in range(4000):  # the counts that tasks draw, without Spark: rows of partition 0 that go to shard 0
        seen[int(sharding.matrix_row(sizes, sizes, 0, seed)[0])] += 1
    for k in range(3):
        assert abs(seen[k] - 4000 * math.comb(2, k) * math.comb(2, 2 - k) / 6) < 160
    orders = Counter(tuple(r["doc_id"] for r in sorted(sharding.shuffle_to_shards(d, 2, seed=s).collect(), key=lambda r: (r["shard"], r["slot"]))) for s in range(48))
    assert len(orders) >= 14


def test_shards_of_odd_tables(spark, empty):
    assert sharding.shuffle_to_shards(empty, 4).count() == 0
    same = spark.createDataFrame([(None, None)] * 9, "a int, b string")
    assert sorted(r["shard"] for r in sharding.shuffle_to_shards(same, 4).collect()) == [0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_hypergeometric_draws():
    rng = np.random.default_rng(5)
    a = np.array([sharding.draw_hypergeometric(rng, 12, 20, 9) for _ in range(6000)])
    want = [math.comb(12, k) * math.comb(20, 9 - k) / math.comb(32, 9) * 6000 for k in range(10)]
    seen = np.bincount(a, minlength=10)
    assert sum((s - w) ** 2 / w for s, w in zip(seen, want, strict=True) if w > 5) < 30
    big = sharding.draw_hypergeometric(rng, 10**11, 10**11, 10**10)
    assert abs(big - 5 * 10**9) < 10**6
    many = np.array([sharding.split_counts(rng, np.array([12, 0, 5, 15]), 9) for _ in range(6000)])
    assert (many.sum(axis=1) == 9).all()
    for at, n in enumerate([12, 0, 5, 15]):
        seen = np.bincount(many[:, at], minlength=10)
        want = [math.comb(n, k) * math.comb(32 - n, 9 - k) / math.comb(32, 9) * 6000 for k in range(10)]
        assert sum((s - w) ** 2 / w for s, w in zip(seen, want, strict=True) if w > 5) < 35
    huge = sharding.split_counts(rng, np.array([10**11] * 3 + [5]), 10**10)
    assert huge.sum() == 10**10
    assert abs(huge[0] - 10**10 / 3) < 10**6
    cells = np.array([5, 0, 7, 8])
    part = np.array([6, 4, 0, 10])
    m = np.array([sharding.matrix_row(part, cells, i, 1) for i in range(4)])
    assert (m.sum(axis=0) == cells).all()
    assert (m.sum(axis=1) == part).all()


# op5


def test_quality(spark):
    rng = random.Random(4)
    good = [prose(rng, rng.randint(20, 80)) for _ in range(300)]
    bad = [" ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng, rng.randint(20, 80)).split()) for _ in range(100)]
    data = [(i, t, None) for i, t in enumerate(good + bad)] + [(1000, None, None), (1001, "", 5), (None, "x", 1)]
    d = spark.createDataFrame(data, "doc_id long, text string, n_chars long").withColumn("score", F.lit("old"))
    lab = spark.createDataFrame([(i, int(i < 300)) for i in range(400)] + [(1000, None), (None, 1), (0, 1)], "doc_id long, quality int")
    out = quality.classify(d, lab).collect()
    assert len(out) == len(data)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert sum(r["predicted"] == int(r["doc_id"] < 300) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert {r["score"] for r in quality.classify(d.limit(3), lab.limit(0)).collect()} != set()
    assert quality.classify(d.limit(0), lab).count() == 0


def test_pairwise_interactions():
    m = quality.Machine.fresh(20, 3, 1)
    m.v[:] = np.random.default_rng(0).normal(size=m.v.shape)
    number, value = np.array([2, 5, 9]), np.array([1.0, 0.5, 2.0], np.float32)
    want = sum(float(m.v[number[i]] @ m.v[number[j]]) * value[i] * value[j] for i in range(3) for j in range(i + 1, 3))
    assert m.margins(number, value, np.array([3]))[0][0] == pytest.approx(want, rel=1e-4)


def test_machine_scores_and_gradient_by_brute_force():
    """The margin is the sum over all pairs, and a step goes along the gradient of the log loss."""
    rng = np.random.default_rng(2)
    m = quality.Machine.fresh(12, 3, 1)
    m.w[:], m.v[:], m.bias[:] = rng.normal(size=m.w.shape), rng.normal(size=m.v.shape), 0.3
    rows_ = [(rng.choice(12, 4, replace=False), rng.normal(size=4).astype(np.float32), int(rng.integers(2))) for _ in range(6)]

    def margin(body, number, value):
        t = quality.Machine(body, 3)
        pairs = sum(float(t.v[number[i]] @ t.v[number[j]]) * value[i] * value[j] for i in range(4) for j in range(i + 1, 4))
        return float(t.bias[0]) + float(t.w[number] @ value) + pairs

    number, value = np.concatenate([r[0] for r in rows_]), np.concatenate([r[1] for r in rows_])
    p = m.probabilities(number, value, np.full(6, 4))
    for (i, v, _), q in zip(rows_, p, strict=True):
        assert q == pytest.approx(1 / (1 + math.exp(-margin(m.body, i, v))), rel=1e-4)
    loss = lambda body: -sum(math.log(q if y else 1 - q) for (i, v, y) in rows_ for q in [1 / (1 + math.exp(-margin(body, i, v)))]) / 6
    before = m.body.astype(np.float64)
    s = quality.Settings(rank=3, epochs=1, batch=6, rate=0.01, decay=0.0)
    m.learn(rows_, s, 0)
    step = m.body - before
    for at in rng.choice(len(before), 20, replace=False):
        e = np.zeros(len(before))
        e[at] = 1e-4
        g = (loss(before + e) - loss(before - e)) / 2e-4
        assert step[at] == pytest.approx(-0.01 * g / math.sqrt(1e-4 + g * g), abs=2e-4)


def test_quality_of_odd_rows(spark):
    long = "word " * 300_000
    d = spark.createDataFrame([(1, long), (1, long), (2, "a b"), (2, "a b"), (None, None)], "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("label", F.lit(1))
    lab = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (9, 1)], "doc_id long, quality int")
    out = quality.classify(d, lab).collect()
    assert len(out) == 5
    assert len({(r["doc_id"], r["score"]) for r in out}) == 3


# op6


@pytest.fixture(scope="module")
def model():
    from cohortline.llm.queries import piece_model

    return piece_model()


def test_pieces_equal_the_library(docs, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = rows(pieces.decode_pieces(pieces.encode_pieces(docs, model, decoded="decoded"), model, out="again"))
    for i, t, *_ in corpus():
        ids = sp.encode(t or "", add_eos=True)
        assert out[i]["ids"] == ids
        assert out[i]["decoded"] == out[i]["again"] == sp.decode(ids)


def test_pieces_of_odd_texts(model):
    import sentencepiece

    sp, e = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Encoder(model)
    rng = random.Random(9)
    parts = ["a", "the ", " ", "  ", "\n", "\t", "é", "ing", "▁", "</s>", "<0x41>", "ß", "日本", "😀", "..", "'s", "http://", "    ", "\0", "\r", "(", "0000", "==", "\xa0", "aaaa"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert e.encode(t) == sp.encode(t, add_eos=True)
        assert e.decode(sp.encode(t)) == sp.decode(sp.encode(t))
    assert e.encode("x" * 3000) == sp.encode("x" * 3000, add_eos=True)


# op7


def brute_components(data, per_cent=85):
    sets = {}
    for i, t, *_ in data:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("tile", "seed"), [(512, 1), (6, 2)])
def test_near_duplicates(spark, monkeypatch, tile, seed):
    monkeypatch.setattr(neardup, "TILE", tile)
    data = corpus(seed)
    out = rows(neardup.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(3)))
    want = brute_components(data)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())


def test_near_duplicates_of_odd_tables(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, "A b c d e F")], "doc_id long, text string")
    out = neardup.near_duplicates(d).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out) == [(0, 0, True), (4, 4, True), (5, 4, False), (5, 4, False)]


def test_words_that_polynomial_hashes_confuse(spark):
    """The Thue-Morse word and its complement; alone and within longer texts."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    short = [w[:64] for w in (word, other)]
    data = [(1, word), (2, other), (3, short[0]), (4, short[1]), (5, f"x y {word} z u"), (6, f"x y {other} z u"), (7, f"x y {other} z u")]
    out = rows(neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in out.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}
    w = arrowtext.Words(pa.array([" ".join([word, other, *short, "A", "a", "ab\0", "ab"])]), arrowtext.space_words())
    for seed in (0, 1):
        assert len(set(w.hashes(seed).tolist())) == 7
    assert not set(w.hashes(0).tolist()) & set(w.hashes(1).tolist())


def test_near_duplicates_of_one_large_family(spark, monkeypatch):
    """Copies of copies, more of them than a tile holds, among texts that share bands with them but no link; hot keys are dealt over tasks."""
    monkeypatch.setattr(neardup, "TILE", 16)
    monkeypatch.setattr(tables, "OFTEN", 10)
    rng = random.Random(8)
    base, data = prose(rng, 60).split(), []
    for i in range(160):
        base[rng.randrange(60)] = f"v{i}"
        data.append((i, " ".join(base), "en", "s", 0))
    data += [(200 + i, data[i % 3][1], "en", "s", 0) for i in range(40)]
    out = rows(neardup.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(3)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == brute_components(data)


def test_sketches_agree_with_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    m = neardup.sketches(np.concatenate([a, b, a[:3]]), np.repeat([0, 1, 2], [len(a), len(b), 3]), 3, 1024)
    assert (m < np.iinfo(np.uint64).max).all()
    assert (m[0] == m[1]).mean() == pytest.approx(300 / 500, abs=0.05)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 40)]
    out = {r["node"]: r["component"] for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(1, 21))
    assert (out[31], out[32]) == (30, 30)


# op8


def test_language_model(spark, docs):
    data = corpus()
    out = rows(maxent.score_texts(docs, s=maxent.Settings(frequent=20, sent=40)))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in data}
    tokens = {i: [*words(t), "\n"] for i, t, *_ in data}
    c = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(c.values()), len(c)
    for i, own in tokens.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        assert r["score"] < 0
    assert sum(r["score"] for r in out.values()) > sum(r["base_score"] for r in out.values())


def test_language_model_of_odd_tables(spark, empty):
    clash = spark.createDataFrame([(1, "a b", 1.0, "x"), (1, "a b", 1.0, "x")], "doc_id long, text string, score double, part string")
    assert [(r["n_tokens"], r["train_tokens"]) for r in maxent.score_texts(clash).collect()] in ([(3, 6)] * 2, [(3, 0)] * 2)
    assert maxent.score_texts(empty).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = maxent.score_texts(spark.createDataFrame([(held, "a b"), (None, "a")], "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in only) == [(2, 0, 0), (3, 0, 0)]


def trained(spark, docs, s):
    training = docs.filter("doc_id % 2 = 0").select(F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    return maxent.train(training, s)[0], [t or "" for i, t, *_ in corpus() if i % 2 == 0]


def log_p_of(model, text, counts):
    """Brute force: each token's class and word probabilities from the weights, one number at a time."""
    one = lambda w: int(arrowtext.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), True)[0])
    number = {int(h): i for i, h in enumerate(model.hashes)}
    group = lambda w: int(maxent.Tokens._groups[(w.encode()[-2] if len(w.encode()) > 1 else 0) * 256 + w.encode()[-1]])
    history, classes, total = [int(maxent.START2), int(maxent.START1)], [maxent.START, maxent.START], 0.0
    if len(text.split()) == 0:
        history = history[:2]
    for w in [*words(text), None]:
        h = int(maxent.END) if w is None else one(w)
        i = number.get(h, -1)
        frequent = 0 <= i < model.frequent
        c = maxent.END_CLASS if w is None else group(w) + (0 if frequent else maxent.GROUPS)
        r = model.rows
        tri = int(maxent.mix(np.array([(history[-1] * 3 + history[-2]) % 2**64], np.uint64))[0])
        z = model.bias + model.w[history[-1] % r] + model.w[r + history[-2] % r] + model.w[2 * r + tri % r]
        p = np.exp(z.astype(float)) / np.exp(z.astype(float)).sum()
        total += math.log10(p[c])
        if w is not None and frequent:
            of = np.flatnonzero(model.word_class == c)
            z = model.own[of] + model.after[0, classes[-1], of] + model.after[1, classes[-2], of]
            total += math.log10(np.exp(z)[of == i][0] / np.exp(z).sum())
        elif w is not None:
            total += math.log10(counts[w] + 1) - model.log_tail[c - maxent.GROUPS]
        history.append(h)
        classes.append(c)
    return total


def test_language_model_by_brute_force(spark, docs):
    model, texts = trained(spark, docs, maxent.Settings(frequent=30, sent=40, least_rows=32, most_rows=64))
    counts = Counter(w for t in texts for w in words(t))
    model.prepare()
    sample = [t or "" for _, t, *_ in corpus() if len(t or "") < 2000][:40]
    found = model.score(pa.array(sample))
    known = {int(h) for h in model.hashes}
    for t, score in zip(sample, found["score"], strict=True):
        one = {w: int(arrowtext.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), True)[0]) for w in words(t)}
        rest = sum(math.log10(counts[w] + 1) for w in words(t) if one[w] not in known)  # added by the join
        assert score + rest == pytest.approx(log_p_of(model, t, counts), abs=1e-3)
    p = np.exp(model.log_softmax(np.array([[0, model.rows, 2 * model.rows], [3, model.rows + 5, 2 * model.rows + 9]])))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    for c in range(maxent.GROUPS):
        of = np.flatnonzero(model.word_class == c)
        if len(of):
            for a, b in ((0, 3), (maxent.START, maxent.START), (7, 48)):
                assert np.exp(model.own[of] + model.after[0, a, of] + model.after[1, b, of] - model.log_sum[c, a, b]).sum() == pytest.approx(1, abs=1e-4)
    tails = Counter(w for w in counts.elements() if (h := int(arrowtext.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), True)[0])) not in {int(x) for x in model.hashes[: model.frequent]})
    for g in range(maxent.GROUPS):
        mine = [w for w in tails if int(maxent.Tokens._groups[(w.encode()[-2] if len(w.encode()) > 1 else 0) * 256 + w.encode()[-1]]) == g]
        assert 10 ** model.log_tail[g] == pytest.approx(sum(tails[w] + 1 for w in mine) + 1)


def test_language_model_gradient():
    rng = np.random.default_rng(0)
    model = maxent.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(maxent.GROUPS), np.full(maxent.CLASSES, 1 / maxent.CLASSES), 1, 1, maxent.Settings(least_rows=8))
    model.w = rng.normal(size=model.w.shape)
    rows, cls = np.stack([rng.integers(0, 8, 50) + 8 * j for j in range(3)], axis=1), rng.integers(0, maxent.CLASSES, 50)
    cost = lambda: -model.log_softmax(rows)[np.arange(50), cls].sum()
    for r, g in model.gradient(rows, cls):
        for i in range(0, len(r), 3):
            for c in (0, 5, 48):
                model.w[r[i], c] += 1e-5
                high = cost()
                model.w[r[i], c] -= 2e-5
                assert (high - cost()) / 2e-5 == pytest.approx(g[i, c], abs=1e-4)
                model.w[r[i], c] += 1e-5


def test_language_model_words_are_fitted():
    """At the end the expected counts are the observed ones, less the pull to 0."""
    rng = np.random.default_rng(0)
    runs = rng.integers(0, 40, (6, 6)).astype(float)
    runs[4] = 0
    p = rng.dirichlet(np.ones(5), (6, 6))
    drawn = np.array([[rng.multinomial(int(runs[a, b]), p[a, b]) for b in range(6)] for a in range(6)])
    after, own = np.stack([drawn.sum(axis=1), drawn.sum(axis=0)]).astype(np.float32), np.log(np.full(5, 0.2))
    w, log_sum = maxent.fit_words(own, after, runs, maxent.Settings(steps=500, prior=1.0))
    q = np.exp(own + w[0][:, None] + w[1][None] - log_sum[:, :, None])
    assert np.allclose(q.sum(axis=2), 1, atol=1e-5)
    expected = runs[:, :, None] * q
    assert np.allclose(after[0] - expected.sum(axis=1), w[0], atol=0.1)
    assert np.allclose(after[1] - expected.sum(axis=0), w[1], atol=0.1)


def test_counts_sent_are_the_largest(spark):
    c = spark.createDataFrame([(x,) for x in [1] * 50 + [2] * 20 + [7] * 5 + [30_000, 30_001, 90_000]], "c long")
    for most in (0, 1, 2, 3, 7, 8, 27, 28, 77, 78, 100):
        least = maxent.least_count(c, most, bins=4)
        n = c.filter(F.col("c") >= least).count()
        assert n <= most
        assert c.filter(F.col("c") >= least - 1).count() > most or least == 1
    assert maxent.least_count(c.limit(0), 3) == 1


# op9


def brute_repeats(data, length):
    seen, out = set(), {}
    for i, t, *_ in sorted(data, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = (bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone))
    return out


@pytest.mark.parametrize(("length", "seed", "settings"), [(100, 1, {}), (100, 2, {"shard_bytes": 500, "memory": 0}), (60, 3, {"hot": 3, "memory": 4000}), (100, 4, {"hot": 0})])
def test_repeats(spark, monkeypatch, length, seed, settings):
    plain = repeats.find_repeats
    monkeypatch.setattr(repeats, "find_repeats", lambda d, n: plain(d, n, **settings))
    if "hot" in settings:
        monkeypatch.setattr(repeats, "SAMPLE", 1)
    data = corpus(seed)
    out = rows(repeats.remove_repeats(spark.createDataFrame(data, SCHEMA).repartition(4), length=length))
    want = brute_repeats(data, length)
    assert {i: (bytes(r["kept"]), sum(s["end"] - s["first"] for s in r["removed"])) for i, r in out.items()} == want
    assert all(r["kept_text"] == want[i][0].decode("utf-8", "ignore") and r["lang"] == "en" for i, r in out.items())


def test_copies_of_a_task(monkeypatch):
    """Remembered segments are equal in bytes, and what is dropped from memory is only sent on again."""
    rng = np.random.default_rng(1)
    for memory in (0, 2000, 1 << 20):
        copies, first = repeats.Copies(memory), {}
        for _ in range(20):
            data = rng.integers(97, 99, 600).astype(np.uint8)
            at, size = rng.integers(0, 580, 80), rng.integers(1, 9, 80)
            ids, start = rng.integers(0, 5, 80), rng.permutation(80)
            key = size.astype(np.uint64) % 3  # all but equal: only the bytes tell
            seen = copies.seen(data, at, size, key, ids, start)
            body = [data[a : a + n].tobytes() for a, n in zip(at, size, strict=True)]
            place = list(zip(ids.tolist(), start.tolist(), strict=True))
            for b, p in zip(body, place, strict=True):
                first[b] = min(first.get(b, p), p)
            assert all(first[b] < p or (first[b] == p) for b, p, s in zip(body, place, seen, strict=True) if s)


@pytest.mark.parametrize("memory", [1 << 20, 20_000, 0])
def test_a_shard_sorts_the_first_of_equal_segments(monkeypatch, memory):
    """Segments that many tasks sent are told from others by their bytes before the sort; marked windows are those of brute force."""
    rng, sorted_ = random.Random(3), []
    sort = repeats.sort_suffixes
    monkeypatch.setattr(repeats, "sort_suffixes", lambda t, *a: sorted_.append(len(t)) or sort(t, *a))
    own = [rng.randbytes(rng.randint(100, 168)) for _ in range(20)]
    own += [b[:-1] + bytes([b[-1] ^ 1]) for b in own[:5]] + [b"ab" * 70, own[0][20:] + own[1][:80]]
    bodies = [(i, 200 * j, b) for i in range(40) for j, b in enumerate(rng.sample(own, rng.randint(1, len(own))))]
    parts = [bodies[k : k + 50] for k in range(0, len(bodies), 50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.int64()), pa.array([r[1] for r in x], pa.int32()), pa.array([r[2] for r in x], pa.binary())], names=["id", "start", "body"]) for x in parts]
    found = [(i, s + k) for b in repeats._sorter(100, memory)(iter(batches)) for i, s, n in zip(*(c.to_pylist() for c in b.columns)) for k in range(n)]
    seen, expected = set(), []
    for i, s, b in bodies:
        for k in range(len(b) - 99):
            expected += [(i, s + k)] * (b[k : k + 100] in seen)
            seen.add(b[k : k + 100])
    assert sorted(found) == expected
    if memory == 1 << 20:
        assert sorted_ == [sum(map(len, own)) + len(own) + 1]


def test_repeats_of_odd_tables(spark, empty):
    assert repeats.remove_repeats(empty).count() == 0
    text = "abc " * 60 + "end"
    d = spark.createDataFrame([(1, "q" * 99 + text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    out = repeats.remove_repeats(d).collect()
    assert len(out) == 4
    kept = {(r["doc_id"], r["text"] is None or len(r["text"])): len(r["kept"]) for r in out}
    assert kept[(None, len(text))] < len(text)  # its own repeats go
    assert kept[(1, len(text))] == 0
    assert kept[(2, True)] == 0


def check_order(t, limit, memory):
    runs = list(induced.sort_suffixes(np.array([*t, 0], np.uint8), limit, memory))
    place, common = ([int(x) for r in runs for x in r[i]] for i in (0, 1))
    assert sorted(place) == list(range(len(t)))
    key = [tuple(t[i : i + limit]) for i in place]
    assert key == sorted(key, reverse=True)
    for a, b, c in zip(key, key[1:], common[1:], strict=False):
        assert c == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize(("block", "chunk", "run"), [(1 << 16, 1 << 18, 256), (8, 16, 3), (3, 5, 2), (20, 7, 1000)])
@pytest.mark.parametrize("memory", [0, 1 << 20])
def test_induced_sorting(monkeypatch, block, chunk, run, memory):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("LONG_RUN", run)):
        monkeypatch.setattr(induced, name, value)
    rng = random.Random(block + memory)
    for k in range(150):
        t = [rng.randint(1, rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 60 if k % 5 else 300))]
        check_order((t * 5)[:300] if k % 3 == 0 else t, rng.choice([3, 7, 50]), memory)


def test_induced_sorting_of_runs_beyond_memory(monkeypatch):
    """A shard of 400 kB, memory of 4 kB: everything goes through files, and runs of one symbol take no step each."""
    monkeypatch.setattr(induced, "BLOCK", 1 << 10)
    monkeypatch.setattr(induced, "CHUNK", 1 << 12)
    rng = np.random.default_rng(2)
    t = rng.integers(2, 6, 400_000).astype(np.uint8)
    t[1000:90_000], t[200_000:260_000], t[300_000:310_000] = 3, np.tile([4, 5], 30_000), t[390_000:]
    t[-1] = 0
    seen = 0
    body = t.tobytes() + bytes(100)
    last = None
    for place, common in induced.sort_suffixes(t, 100, 4096):
        seen += len(place)
        keys = [body[p : p + 100] for p in place.tolist()]
        assert last is None or last >= keys[0]
        assert all(a >= b for a, b in zip(keys, keys[1:], strict=False))
        assert all((c == 100) == (a == b) for a, b, c in zip(keys, keys[1:], common.tolist()[1:], strict=False))
        last = keys[-1]
    assert seen == len(t) - 1


def test_memory_of_segments_and_sorting():
    """One long text is cut in pieces, and a shard is sorted with little beyond its queues and blocks."""
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 4 << 20).astype(np.uint8)
    tracemalloc.start()
    found = repeats.segments(text, np.array([0, len(text)]), 100)
    peak = tracemalloc.get_traced_memory()[1]
    assert found["n"].sum() == len(text) - 99
    assert peak < 32 << 20
    tracemalloc.reset_peak()
    t = np.append(text[: 3 << 20] - 95, 0).astype(np.uint8)
    assert sum(len(p) for p, _ in induced.sort_suffixes(t, 100, 1 << 20)) == len(t) - 1
    assert tracemalloc.get_traced_memory()[1] < 96 << 20
    tracemalloc.stop()


def test_pieces_seen_by_a_worker_stay_while_they_are_met(model, monkeypatch):
    """One encoder for all tasks of a worker; a stretch that is met again outlives many that aren't."""
    import sentencepiece

    monkeypatch.setattr(pieces, "KEEP", 40)
    e = pieces.worker_encoder(model)
    assert pieces.worker_encoder(bytes(model)) is e
    worked, compute = [], e.seen.compute
    monkeypatch.setattr(e.seen, "compute", lambda s: (worked.append(s), compute(s))[1])
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(100):
        text = f"often zq{i}w, \u0416\u4e2d{i}"
        assert e.encode(text, end=False) == sp.encode(text)
    assert worked.count(pieces.SPACE + "often") <= 1 and len(e.seen) + len(e.seen.older) <= 40


# op8


def test_class_steps_are_those_of_the_plain_formula():
    """Steps over gathered rows, with the softmax worked out once, equal dense adaptive steps."""
    texts = pa.array(["the cat sat on the mat", None, "the dog sat", "a cat ate the dog"])
    t = maxent.Tokens(texts)
    h, at, c = np.unique(t.hash, return_index=True, return_counts=True)
    order = np.lexsort((h, -c, h != maxent.END))
    share = np.ones(maxent.CLASSES) / maxent.CLASSES
    m = maxent.Model(h[order], c[order], t.group[at][order], np.ones(maxent.GROUPS), share, len(t.hash), len(h), maxent.Settings(least_rows=64))
    m.prepare()
    m.w += np.random.default_rng(4).normal(size=m.w.shape).astype(np.float32)
    past, met, w = np.full(m.w.shape, 3.0, np.float32), np.zeros(len(m.w)), m.w.astype(float)
    _, cls, _, rows = m.read(t)
    p = m.softmax(rows)
    assert np.allclose(p, np.exp(m.log_softmax(rows)), atol=1e-6) and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    g = np.zeros(w.shape)
    for j in range(3):
        np.add.at(g, rows[:, j], p - np.eye(maxent.CLASSES)[cls])
    m.learn(texts, past, met)
    assert np.allclose(m.w, w - 0.5 * g / np.sqrt(3 + g * g), atol=1e-5)
    assert np.allclose(past, 3 + g * g, atol=1e-5) and met.sum() == 3 * len(cls)


# op10


def test_licenses(spark):
    f = spark.createDataFrame(
        [(1, "h/a/LICENSE", "Released under the MIT License."), (2, "h/a/b/x.py", "code"), (3, "h/a/b/y.py", "x\nlicensed under the apache license, version 2.0!"), (4, "h/z", None), (5, None, "the version of this"), (6, "g/q", ""), (7, "h/a/u.py", "All rights reserved.")],
        "file int, path string, text string",
    )
    out = rows(licenses.scan_licenses(f, spark.createDataFrame(licenses.TEMPLATES, "license string, template string")), "file")
    assert [out[i]["license"] for i in range(1, 8)] == ["MIT", "Apache-2.0", "Apache-2.0", None, None, None, "Proprietary"]
    assert (out[2]["license_dir"], out[3]["license_dir"]) == ("h/a/b", None)
    one = rows(licenses.scan_licenses(f.filter("file IN (1, 2)"), spark.createDataFrame(licenses.TEMPLATES, "license string, template string")), "file")
    assert (one[2]["license"], one[2]["license_dir"]) == ("MIT", "h/a")
    assert licenses.scan_licenses(f.limit(0), spark.createDataFrame(licenses.TEMPLATES, "license string, template string")).count() == 0


def test_licenses_of_headers_files_and_odd_rows(spark):
    """Statements over several lines, whole licence texts, repeated rows, long texts, clashing columns."""
    text = {n: t for n, t in licenses.TEMPLATES if len(t) > 300}
    wrap = lambda t: "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    code = "\n\n" + "int main() { return compute(alpha, beta); }\n" * 40
    rows_ = [
        (1, "a/LICENSE", "Copyright (c) 2020 Somebody\n\n" + wrap(text["MIT"])),
        (2, "a/x.c", "/* " + wrap(text["GPL-3.0"]) + " */" + code),
        (3, "b/COPYING.txt", wrap(text["BSD-3-Clause"]).replace(". ", ".\n\n")),
        (4, "b/y.c", "// SPDX-License-Identifier: MPL-2.0" + code),
        (5, "b/z.c", code),
        (5, "b/z.c", code),
        (6, "c/long.txt", "lorem ipsum " * 40_000 + "\n\n" + wrap(text["Apache-2.0"])),
        (7, "c/none", ""),
    ]
    f = spark.createDataFrame([(*r, "x", 1) for r in rows_], "file int, path string, text string, license string, dir int")
    out = licenses.scan_licenses(f, spark.createDataFrame(licenses.TEMPLATES, "license string, template string")).collect()
    assert len(out) == len(rows_)
    found = {r["file"]: (r["own_license"], r["license"]) for r in out}
    assert found == {1: ("MIT", "MIT"), 2: ("GPL-3.0", "GPL-3.0"), 3: ("BSD-3-Clause", "BSD-3-Clause"), 4: ("MPL-2.0", "MPL-2.0"), 5: (None, "BSD-3-Clause"), 6: ("Apache-2.0", "Apache-2.0"), 7: (None, "Apache-2.0")}


def test_licenses_clean_the_text_once_for_the_frequencies(spark, monkeypatch):
    """One replacement a file, by a class that Java looks up in a table; lines count a word once, lines without words don't count."""
    kept, plans, write = {}, {}, licenses.written

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(licenses, "written", spy)
    beyond = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000, 7), *range(0x10000, 0x110000, 997)])).replace("\n", "")
    texts = ["the The\n\n--\nRights,the end\r\n \n7z", "\u212aey \u0130x\n\U0001d400a\u00e9b", "", None, beyond]
    f = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file int, text string")
    assert licenses.own_licenses(f, spark.createDataFrame(licenses.TEMPLATES, "license string, template string")).count() == 0
    expected = Counter()
    for line in "\n".join(t or "" for t in texts).split("\n"):
        words = set(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
        expected.update(words | {""} if words else ())
    assert {r["word"]: r["df"] for r in kept["frequencies"].collect()} == expected
    assert plans["frequencies"].count("regexp_replace") == 1 and "A-Za-z" not in plans["frequencies"] + plans["chosen"]


def test_licenses_compare_only_what_can_reach_the_limit(spark, monkeypatch):
    """Blocks with some words of templates whose weights can't add up to the limit are in no exchange; own licences are worked out once."""
    kept, write = {}, licenses.written

    def spy(df, name):
        kept.setdefault(name, []).append(write(df, name))
        return kept[name][-1]

    monkeypatch.setattr(licenses, "written", spy)
    texts = ["the work or a purpose, to any person\n" * 3, "see this, if you may not", "x\nReleased under the MIT License.\nthe end", "\u212aey: ALL RIGHTS RESERVED", "all \u0130rights"]
    f = spark.createDataFrame([(i, f"h{i}/x", t) for i, t in enumerate(texts)], "file int, path string, text string")
    out = rows(licenses.scan_licenses(f, spark.createDataFrame(licenses.TEMPLATES, "license string, template string")), "file")
    assert [out[i]["license"] for i in range(5)] == [None, None, "MIT", "Proprietary", "Proprietary"]
    assert {r["file"] for r in kept["chosen"][0].collect()} <= {2, 3, 4}
    assert len(kept["own"]) == 1 and kept["own"][0].count() == 3
