"""The pipeline's stages, each against brute force on what the stage before it kept."""

import random

import pytest

import corpus_pipeline
from cohortline.llm.queries import piece_model

from .test_operators import SCHEMA, brute_components, brute_hits, brute_repeats, corpus, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    data = corpus(5)
    first = max(i for i, *_ in data) + 1
    item = prose(rng, 30)
    more = [" ".join(w + "###" for w in prose(rng, 40).split()) for _ in range(60)] + [prose(rng, 60) for _ in range(60)] + [f"{prose(rng, 12)} {item}"]
    data = data + [(first + i, t, "en", "s", len(t)) for i, t in enumerate(more)]
    labels = [(first + i, int(i >= 60), 0) for i in range(120)] + [(i, 1, 0) for i, t, *_ in data[:80] if t and len(t) > 200]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "nothing like it at all " * 4)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, [(1, item), (2, "nothing like it at all " * 4)], first


def test_pipeline(spark, folder):
    import sentencepiece

    path, items, first = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path).cache()
        if n < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(docs.collect())
    data = [[(r["doc_id"], r["text"]) for r in rows] for rows in kept[:4]]
    ids = [{i for i, _ in d} for d in data]
    assert not ids[0] & set(range(first, first + 60)) or len(ids[0] & set(range(first, first + 60))) <= 3
    assert len(ids[0] & set(range(first + 60, first + 120))) >= 58
    assert ids[1] == {i for i, (_, c) in brute_components(data[0], 80).items() if i == c}
    want = brute_repeats(data[1], 100)
    assert {i: t or "" for i, t in data[2]} == {i: b.decode("utf-8", "ignore") for i, (b, _) in want.items()}
    hits = {i: brute_hits(t, items) for i, t in data[2]}
    assert ids[3] == {i for i, (n, h, _) in hits.items() if not (h > 0 and 20 * h >= n)}
    assert ids[3] != ids[2]
    sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    texts = dict(data[3])
    assert {r["doc_id"]: r["ids"] for r in kept[4]} == {i: sp.encode(t or "", add_eos=True) for i, t in texts.items()}
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded"] == sp.decode(r["ids"]) for r in kept[4])
    whole = corpus_pipeline.run(spark, path)
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(ids[3])


def test_stages_of_odd_tables(spark, folder, tmp_path):
    """No rows give none; null ids and texts, repeated rows and clashing columns go through every stage."""
    path, _, _ = folder
    none = spark.createDataFrame([], SCHEMA)
    long = "many words in a row " * 60
    odd = [(None, None, None, None, None), (None, "a b c", "en", "s", 5), (1, long, "en", "s", 9), (1, long, "en", "s", 9), (2, "", "en", "s", 0), (3, long + "x", "en", "s", 9)]
    d = spark.createDataFrame(odd, SCHEMA)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, none, path).count() == 0
        out = stage(spark, d, path)
        rows = out.collect()
        assert n == 4 or out.columns == corpus_pipeline.COLUMNS
        if n in (3, 4):
            assert len(rows) == len(odd)
        if n == 1:
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((i or 0, t or "") for i, t, *_ in odd if i != 3)
        if n == 2:
            assert len(rows) == len(odd)
            assert all(r["text"] is None or len(r["text"]) < 150 for r in rows)
