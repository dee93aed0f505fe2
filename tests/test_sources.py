"""Signal files and saved tables."""

import numpy as np

from cohortline.queries import signals
from cohortline.sources import tables


def test_signal_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "ID1-2018y-07m_17d_9h_5m.txt").write_text("header\ntime a b\n0.000 1 2\n0.004 3 4\n")
    (tmp_path / "bad.txt").write_text("x\n1 2\n")
    listed = {r["file_key"] for r in tables.list_signals(spark, str(tmp_path)).collect()}
    assert listed == {"id1_20180717_0905", "bad"}
    good, bad = tables.good_and_bad(tables.read_signals(spark, [str(tmp_path / "sub"), str(tmp_path / "bad.txt")]))
    row = good.head()
    assert (row["n"], row["ch1"], row["ch2"]) == (2, [1.0, 3.0], [2.0, 4.0])
    assert bad.head()["error"]


def test_signal_files_are_read_by_groups(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(121, 5)).astype("float32").astype(float)  # the last has no second channel
    spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen = {"list_signals": [], "read_signals": []}

    def watched(name, f):
        def run(s, path, *a):
            files = s.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            seen[name].append({r["path"] for r in files.select("path").collect()})
            return f(s, path, *a)

        return run

    for name in seen:
        monkeypatch.setattr(tables, name, watched(name, getattr(tables, name)))
    monkeypatch.setattr(tables, "GROUP", 20, raising=False)
    rows = sorted(signals.signal_files(spark, str(tmp_path)).collect())
    assert [(r["pair"], r["n"], r["status"]) for r in rows] == [(i, 5 if i % 7 else 0, "ok" if i % 7 else "error") for i in range(60)]
    for r in rows:
        got = (r["last"], r["sum1"], r["sum2"])
        assert got == (None,) * 3 if r["pair"] % 7 == 0 else np.allclose(got, [4 / 90, *x[2 * r["pair"] : 2 * r["pair"] + 2].sum(axis=1)], atol=1e-4)
    for groups in seen.values():
        assert len(set.union(*groups)) == sum(map(len, groups)) == 60
        assert max(map(len, groups)) < 45  # dealt by hash, about 20 each; the driver held all 60 at once


def test_no_signals_at_all(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert signals.signal_files(spark, str(tmp_path)).count() == 0


def test_model_and_signature(spark, tmp_path):
    tables.save_model(spark, str(tmp_path / "m"), ["a"], [0.0], [1.0], [0.1, 0.2], [[1.0, 0.0], [0.0, 2.0]])
    m = tables.load_model(spark, str(tmp_path / "m"))
    assert m["features"] == ["a"]
    assert np.allclose(m["cov"], [[1, 0], [0, 2]])
    res = spark.createDataFrame([("Fixed", "a, b")], "FeatureSet string, SelectedFeatures string")
    assert [r["feature"] for r in tables.load_signature(res, "Fixed").collect()] == ["a", "b"]
    tables.write(res, str(tmp_path / "t"), by=["FeatureSet"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_optional(spark):
    schema = spark.createDataFrame([], "a int").schema
    assert tables.optional(spark, None, schema).count() == 0
