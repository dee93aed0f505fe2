"""Token alignment, SimHash and spelling variants against brute force."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortline.llm import alignment, maxent, queries, simhash, spelling, tables

from .test_operators import LOWER, SCHEMA, corpus, words

ODD = [
    None, "", " ", "  ", "a ", " a", "a  b", "a\nb", "a\n b", "a \nb", "a\n\nb", "\n", "\nx", "x\n", "tab\there", "naïve 日本語 🎉🎊 ok", "a▁b", "▁", "<|endoftext|> <s></s> <0x41>",
    "x\0y", " nb  sp", "é" * 40, "日" * 50, "'s 'll don't", "🎉", "a\r\nb", "\x1c a", "word " * 600, "x" * 3000, "𝔘𝔫𝔦 ⟨⟩ ﬁ", "١٢٣ 456", "a b c",
]


def odd_docs(spark, texts=ODD):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9], (None, "null id", None, None, None)], SCHEMA).withColumn("n_a", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


# Alignment


def plain_tokens(text):
    """Ids and end offsets of both sides by decoded bytes alone, None where they don't join to the text."""
    a = Tokenizer.from_str(queries.byte_vocabulary())
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    letters = alignment.byte_letters()
    names = {i: t for t, i in a.get_vocab().items()}

    def tokens(text):
        if not text:
            return None
        body = (" " + text).encode()
        ids = [a.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)]
        raw = [[bytes(letters[c] for c in names[i]) for i in ids[0]], [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if any(b"".join(r) != body for r in raw):
            return None
        return [(i, np.cumsum([len(t) for t in r]).tolist()) for i, r in zip(ids, raw, strict=True)]

    return tokens(text) if isinstance(text, str) else tokens


def plain_alignment(rows):
    tokens = plain_tokens(None)
    out, links = {}, {}
    for key, text in rows:
        found = tokens(text)
        groups, own = [], []
        if found:
            (a, ae), (b, be) = found
            cuts = sorted(set(ae) & set(be))
            i = j = 0
            for c in cuts:
                x, y = ae.index(c, i) + 1, be.index(c, j) + 1
                groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
                own.append((a[x - 1], b[y - 1]))
                i, j = x, y
        text_ = ";".join(groups)
        out[key] = [len(found[0][0]) if found else 0, len(found[1][0]) if found else 0, len(groups), hashlib.sha256(text_.encode()).hexdigest() if groups else ""]
        links[key] = own
    counts = Counter(x for own in links.values() for x in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for key, own in links.items():
        out[key] += [len(own), sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own)]
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]


@pytest.mark.parametrize("bound", [None, 10])
def test_alignment(spark, docs, tmp_path, monkeypatch, bound):
    if bound:
        monkeypatch.setattr(alignment, "SEND_IDS", bound)
        monkeypatch.setattr(tables, "OFTEN", 3)
    both = docs.unionByName(odd_docs(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).drop("n_a").withColumn("doc_id", F.col("doc_id") + 10_000))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: [r[c] for c in COLUMNS] for r in queries.op11_alignment(spark, str(tmp_path)).collect()}
    want = plain_alignment([(r["doc_id"], r["text"]) for r in both.collect()])
    assert out == want
    assert sum(v[0] == 0 for v in want.values()) >= 6


def test_alignment_stretches(monkeypatch):
    rng = random.Random(4)
    aligner = alignment.Aligner(queries.byte_vocabulary(), queries.piece_model())
    assert aligner.cuts
    tokens = plain_tokens(None)
    letters = [" ", " ", "\n", "\t", "a", ".", ",", "!?", ")", "_", "2", "²", ":", ";", "%", '"', "\u0301", "a", "Be", "é", "日", "🎉", "'s", "1", ".", " ", "\x1c", "the", "ing"]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
        parts = aligner.stretches(text)
        one, other, ok = aligner.encode(parts)
        want = tokens(text)
        assert "".join(parts) == " " + text
        assert ok.all()
        assert (one.ids.tolist(), other.ids.tolist()) == (want[0][0], want[1][0]), repr(text)
        assert (one.ends.tolist(), other.ends.tolist()) == (want[0][1], want[1][1]), repr(text)
        assert len(one.bounds) == len(other.bounds) == len(parts) + 1
    assert aligner.stretches("ab, c.\nD e2e! x") == [" ab", ",", " c", ".", "\nD", " e2e", "!", " x"]
    monkeypatch.setattr(alignment, "KEEP", 6)
    aligner.entries({" w1", " w2"})
    first = aligner.seen[" w1"]
    aligner.entries({" w1", " w30", " w31"})
    assert (set(aligner.seen), set(aligner.older)) == ({" w1", " w30", " w31"}, {" w1", " w2"})
    assert aligner.seen[" w1"] is first


def test_alignment_of_odd_tables(spark):
    a, b = queries.byte_vocabulary(), queries.piece_model()
    none = alignment.with_link_counts(alignment.align_tokens(spark.createDataFrame([], SCHEMA), a, b))
    assert none.count() == 0
    done = alignment.align_tokens(odd_docs(spark), a, b).collect()
    assert len(done) == len(ODD) + 2
    assert {r["n_a"] for r in done if r["doc_id"] in (0, 1)} == {0}
    assert all(sum(x["n"] for x in r["links"]) == r["n_groups"] == len([g for g in r["groups"].split(";") if g]) for r in done)
    only = alignment.with_link_counts(alignment.align_tokens(odd_docs(spark, [None] * 10), a, b)).filter("doc_id IS NOT NULL").collect()
    assert {(r["n_links"], r["n_best"], r["count_sum"]) for r in only} == {(0, 0, 0)}


# SimHash


def plain_simhash(text):
    w = words(text)
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=4):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash(spark, docs, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(tables, "OFTEN", 3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op12_simhash(spark, str(tmp_path)).collect()}
    prints = {r["doc_id"]: plain_simhash(r["text"]) for r in docs.collect()}
    want = plain_components(prints)
    assert out == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(prints) - 5


@pytest.mark.parametrize(("nodes", "bits"), [(100, 4), (20_000_000, 4), (10**10, 4), (100, 2)])
def test_blocks_bring_all_pairs_together(nodes, bits):
    masks = simhash.block_masks(nodes, bits)
    rng = random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), bits))
        assert any(not flips & m for m in masks)
    width = min(m.bit_count() for m in masks)
    assert nodes <= 16 << width or len(masks) == 70


@pytest.mark.parametrize("tile", [4096, 40])
def test_links_of_one_family(spark, tile):
    """Fingerprints about a few centres: what links join is what all pairs within four bits join, and the links are few."""
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for c in centres for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    named = dict(enumerate(sorted(prints)))
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in named.items()], "node long, simhash long").repartition(4)
    links = simhash.close_links(nodes, tile=tile).collect()
    assert all((named[r["a"]] ^ named[r["b"]]).bit_count() <= 64 for r in links)
    want = plain_components(named)
    found = {r["node"]: r["component"] for r in tables.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {i: found.get(i, i) for i in named} == want


def test_pivots_discard_no_close_pair(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.int64).view(np.uint64)
    prints[100:200] = prints[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    group = rng.integers(0, 2, 300)
    got = {tuple(sorted(p)) for a, b in simhash.close_pairs(group, prints, 4) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= 4}
    assert got == want
    assert len(want) > 30


def test_simhash_of_odd_tables(spark):
    assert simhash.simhash_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = odd_docs(spark).withColumn("component_id", F.lit("clash")).withColumn("simhash", F.lit("clash"))
    out = simhash.simhash_duplicates(df).collect()
    assert len(out) == len(ODD) + 2
    blank = [r for r in out if r["doc_id"] in (0, 1, 2, 3, 11)]
    assert {(r["simhash"], r["component_id"]) for r in blank} == {(0, 0)}
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None]
    texts = pa.array(["a b c d e " * 30_000, None, "x"])
    got = simhash.fingerprints(*simhash.shingle_hashes(texts), 3)
    assert [int(x) for x in got] == [plain_simhash(t) for t in texts.to_pylist()]


# Spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_forms(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def last(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], last(w), counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None) for w in counts}


def typos(seed, n=400):
    """Words of two letters and more with many near ones, chains of forms and ties."""
    rng = random.Random(seed)
    letters = "abcdeéÿ×" if seed % 2 else "ab"
    out = {}
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
        for _ in range(rng.randint(1, 4)):
            out.setdefault(w, rng.choice([2, 2, 3, 20, 30, 300, 4000]))
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w + rng.choice(letters), rng.choice(letters) + w])
            w = w if len(w) >= 2 else "aa"
    return out


def as_forms(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "part"), [(1, None), (2, None), (3, 10), (4, 7)])
def test_spelling_forms(spark, monkeypatch, seed, part):
    if part:
        monkeypatch.setattr(spelling, "PACK", 300)
        monkeypatch.setattr(spelling, "QUERIES", 64)
    counts = typos(seed)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    want = plain_forms(counts)
    assert as_forms(spelling.spelling_forms(df, part=part)) == want
    assert any(f[0] is not None and f[1] != f[0] for f in want.values())


def test_index_intervals_by_counting():
    names = sorted(typos(1, 60))
    index = spelling.WordIndex(names)
    text = "$" + "$".join(names) + "$"
    number = {c: int(index.codes[i]) for w, s in zip(names, index.starts, strict=True) for i, c in enumerate(w, int(s))} | {"$": 1}
    for i, (w, s) in enumerate(zip(names, index.starts.tolist(), strict=True)):
        for left, part, begin in ((True, w[: len(w) // 2], s), (False, w[len(w) // 2 :], s + len(w) // 2)):
            low, high = index.exact(np.array([begin]), np.array([len(part)]), left)
            want = "$" + part if left else part + "$"
            places = {m.start() for m in re.finditer(f"(?={re.escape(want)})", text)}
            assert high[0] - low[0] == len(places), (i, w)
            here = index.reverse if left else index.forward
            got = here.places[low[0] : high[0]]
            assert ({len(text) - int(p) - len(want) for p in got} if left else set(map(int, got))) == places
    for c, k in number.items():
        every = index.forward.counts(np.arange(index.forward.n + 1))[:, k]
        assert every[-1] == text.count(c)
        assert (index.forward.count(np.full(index.forward.n + 1, k), np.arange(index.forward.n + 1)) == every).all()


def test_spelling_of_documents(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["straßenbahn", "naïveté", "ABCDEFGH", "Élévation", "question", "questions", "quotation", "stationary", "stationery", "x×y÷zabc"] + ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 400))) + rng.choice(["", ".", "1", "日"]) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "a" * 5000, "a" * 5000, "b" + "a" * 5000, "b" + "a" * 5000, texts[0]])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    want = plain_forms({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    out = as_forms(queries.op13_spelling(spark, str(tmp_path)))
    assert out == want
    assert sum(f[0] is not None for f in want.values()) > 5


def test_spelling_of_odd_tables(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    df = odd_docs(spark, [None, "", "1 2 3", "Letters letterS", "letter"] * 2).withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    out = as_forms(spelling.spelling_variants(df, drop_one_in=None))
    assert out == {"letters": (None, "letters", 4, 0, None)}
    ties = spark.createDataFrame([("abcdefg", 2), ("abcdefh", 20), ("abcdefi", 20)], "word string, n long")
    assert as_forms(spelling.spelling_forms(ties))["abcdefg"] == ("abcdefh", "abcdefh", 2, 2, 20)


# Language model


def test_weights_are_averaged_by_tokens_met():
    rng = np.random.default_rng(0)
    w, met = rng.normal(size=(5, 7, maxent.CLASSES)), rng.integers(0, 9, (5, 7)).astype(float)
    met[:, 3] = 0
    some = maxent._average(iter([maxent._average(maxent._packed(w[i], met[i]) for i in (0, 1, 2)), maxent._packed(w[3], met[3]), maxent._packed(w[4], met[4])]))
    got, n = maxent._unpacked(some)
    assert n.tolist() == met.sum(axis=0).tolist()
    for r in range(7):
        if n[r]:
            np.testing.assert_allclose(got[r], np.average(w[:, r], axis=0, weights=met[:, r]), atol=0.01)


def test_models_are_sent_with_the_weights_that_tasks_use():
    model = maxent.Model(np.array([5, 9], np.uint64), np.ones(2, np.int64), np.zeros(2, np.int64), np.ones(maxent.GROUPS), np.full(maxent.CLASSES, 1 / maxent.CLASSES), 10, 2, maxent.Settings(least_rows=64))
    empty = pickle.dumps(model)
    assert not pickle.loads(empty).w.any()
    model.w[:] = np.random.default_rng(0).normal(size=model.w.shape)
    full = pickle.dumps(model)
    np.testing.assert_allclose(pickle.loads(full).w, model.w, atol=0.01)
    assert len(full) - len(empty) < 2.1 * model.w.size
    assert len(pickle.dumps(model.without_weights())) < len(empty) + 100
    assert model.w.any()


def held_out_gain(spark, n):
    """Log10 a token that the class factor gains over the shares of the classes, for trained and for held-out texts of a corpus whose endings follow each other."""
    rng = random.Random(3)
    after = {e: rng.sample("abcdefgh", 3) for e in "abcdefgh"}

    def text(size):
        e, out = "a", []
        for _ in range(size):
            e = rng.choice(after[e])
            out.append(f"w{rng.randrange(300)}{e}{e}")
        return " ".join(out)

    texts = [text(120) for _ in range(n)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).select("text", F.spark_partition_id().alias("part"))
    model, _, _ = maxent.train(df)
    model.prepare()

    def gain(texts):
        t = maxent.Tokens(pa.array(texts))
        _, cls, _, rows = model.read(t)
        z = model.log_softmax(rows)[np.arange(len(cls)), cls]
        return float((z - model.bias[cls]).mean() / np.log(10))

    return gain(texts[:60]), gain([text(120) for _ in range(60)])


def test_held_out_gain_grows_with_the_corpus(spark):
    small, large = held_out_gain(spark, 100), held_out_gain(spark, 1500)
    assert -0.005 < small[1] < large[1]
    assert large[1] > 0.1
    assert large[0] - large[1] < 0.5 * large[0]
