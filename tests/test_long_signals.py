"""Filters by blocks, parsing at once, places in long signals, intervals and saved models, against plain loops and draws."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators import attribution, bayes, segments, signal
from cohortline.sources import tables


def by_sample(x, q):
    b0, b1, b2, a1, a2 = q
    z1, z2 = signal.settled(x[0], q)
    out = np.empty_like(x)
    for i, v in enumerate(x):
        y = b0 * v + z1
        z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
        out[i] = y
    return out


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000, 2048])
def test_blocks_filter_as_samples_do(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 2)).cumsum(axis=0)
    for q in signal.butterworth(1.0, 45.0, 250.0):
        want = by_sample(x, q)
        got, _ = signal.section(x, q, signal.settled(x[0], q))
        np.testing.assert_allclose(got, want, atol=1e-9)
        at, state, parts = 0, signal.settled(x[0], q), []
        for size in (1, 300, 17, n):  # the state is handed over between chunks
            part, state = signal.section(x[at : at + size], q, state)
            parts.append(part)
            at += size
        np.testing.assert_allclose(np.concatenate(parts), want, atol=1e-9)


def test_an_hour_in_a_second():
    x = np.random.default_rng(0).normal(size=(3600 * 250, 2))
    sections = signal.butterworth(1.0, 45.0, 250.0)
    signal.zero_phase(x[:5000], sections)
    best = min((lambda t: (signal.zero_phase(x, sections), time.perf_counter() - t)[1])(time.perf_counter()) for _ in range(3))
    assert best < 5  # under a second on a machine that has nothing else to do; a loop over samples takes some minutes
    part = signal.zero_phase(x[:3000], sections)
    y = x[:3000]
    y = np.concatenate([2 * y[:1] - y[24:0:-1], y, 2 * y[-1:] - y[-2:-26:-1]])
    for _ in range(2):
        for q in sections:
            y = by_sample(y, q)
        y = y[::-1]
    np.testing.assert_allclose(part, y[24:-24], atol=1e-9)


def test_signal_texts():
    plain = "\n".join(f"{i / 250} {i} {i * 2}" for i in range(50))
    for head in ("", "% a header\nTime, A, B\n\n", "units 1 2\n"):
        t, a, b = tables.parse_signal(head + plain)
        assert (len(t), t[-1], a[3], b[3]) == (50, 49 / 250, 3, 6)
    t, a, b = tables.parse_signal("Time;A;B\n0;1;2;9\n0.1;nan;4\nbroken line here\n0.3;5\n0.4;7;8\n\n")
    assert len(t) == 4 and t.tolist() == [0, 1 / 250, 2 / 250, 3 / 250]
    np.testing.assert_array_equal(a, [1, np.nan, np.nan, 7])
    np.testing.assert_array_equal(b, [2, 4, np.nan, 8])
    for body in ("", "words only", "1 2\n3 4"):
        with pytest.raises(ValueError, match="a signal needs"):
            tables.parse_signal(body)


def test_places_in_signals(spark):
    """One signal has most of the rows and lies in several ranges."""
    rng = np.random.default_rng(2)
    rows = [(k, int(t)) for k, n in (("long", 5000), ("b", 7), ("c", 1)) for t in rng.permutation(n)]
    df = spark.createDataFrame(rows, "k string, t int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = segments.numbered(df, "k", ["t"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r["_i"] == r["t"] for r in out)
    assert {(r["k"], r["_n"]) for r in out} == {("long", 5000), ("b", 7), ("c", 1)}
    cut = segments.cut_segments(df, "k", ["t"], 6, 3).groupBy("k", "segment").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).collect()
    assert {(r["k"], r["segment"]) for r in cut} == {("b", 0)} | {("long", i) for i in range((5000 - 6) // 3 + 1)}
    assert all((r["a"], r["b"], r["n"]) == (3 * r["segment"], 3 * r["segment"] + 5, 6) for r in cut)
    scaled = {r["k"]: r["x"] for r in segments.robust_scale(df.withColumn("v", F.col("t").cast("double")), "k", "v").filter("t = 0").collect()}
    mad = 1.4826 * np.median(np.abs(np.arange(5000) - 2499.5))
    assert scaled == {"long": pytest.approx(-2499.5 / mad), "b": pytest.approx(-3 / (1.4826 * 2)), "c": 0.0}
    capped = segments.cap_segments(spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "k string, segment int"), "k", 5, 1).collect()
    assert sorted(r["segment_id"] for r in capped if r["k"] == "a") == [1, 2, 3, 4, 5]
    assert [r["segment_id"] for r in capped if r["k"] == "b"] == [1]


B = np.array([0.2, 0.9, -0.6])
COV = np.array([[0.2, 0.02, 0.01], [0.02, 0.15, -0.04], [0.01, -0.04, 0.3]])


def test_sweep_uncertainty_by_draws(spark):
    df = spark.createDataFrame([(1, 0.5, -1.2), (2, -2.0, 0.3)], "r int, a double, b double")
    limits = spark.createDataFrame([("a", -9.0, 9.0), ("b", -9.0, 9.0)], "feature string, low double, high double")
    out = attribution.sweep(df, "r", ["a", "b"], B, COV, limits, points=5).collect()
    assert len(out) == 20
    draws = np.random.default_rng(0).multivariate_normal(B, COV, 100_000)
    for r in out:
        x = {1: [1, 0.5, -1.2], 2: [1, -2.0, 0.3]}[r["r"]]
        j = {"a": 1, "b": 2}[r["feature"]]
        x[j] += r["offset"]
        p = 1 / (1 + np.exp(-draws @ x))
        logit = draws[:, j] * x[j]
        prob = logit * p * (1 - p)
        assert r["z"] == pytest.approx(x[j])
        for c, v, tol in (("p", p.mean(), 0.005), ("p_std", p.std(), 0.004), ("ci_lo", np.quantile(p, 0.025), 0.01), ("ci_hi", np.quantile(p, 0.975), 0.01), ("logit", logit.mean(), 0.02), ("logit_std", logit.std(), 0.02), ("prob", prob.mean(), 0.004), ("prob_std", prob.std(), 0.004)):
            assert r[c] == pytest.approx(v, abs=tol), (r["feature"], r["index"], c)


def test_contribution_intervals(spark):
    draws = np.random.default_rng(1).multivariate_normal(B, COV, 2000)
    sample = spark.createDataFrame([(i, *map(float, d)) for i, d in enumerate(draws)], "draw int, b0 double, b1 double, b2 double")
    df = spark.createDataFrame([(7, 0.5, -1.2)], "r int, a double, b double")
    out = {r["feature"]: r for r in attribution.contributions(df, "r", ["a", "b"], sample).collect()}
    p = 1 / (1 + np.exp(-draws @ [1, 0.5, -1.2]))
    for j, (c, x) in enumerate((("a", 0.5), ("b", -1.2)), 1):
        logit = draws[:, j] * x
        for name, v in (("logit", logit), ("prob", logit * p * (1 - p))):
            got = [out[c][f"{name}_{s}"] for s in ("mean", "std", "lo", "hi", "positive", "abs_mean", "abs_std")]
            want = [v.mean(), v.std(ddof=1), np.quantile(v, 0.025, method="hazen"), np.quantile(v, 0.975, method="hazen"), (v > 0).mean(), np.abs(v).mean(), np.abs(v).std(ddof=1)]
            assert got == pytest.approx(want)


def test_coefficient_intervals(spark):
    fit = bayes.Fit(B, COV, 1, True)
    out = {r["feature"]: r for r in bayes.coefficient_summary(spark, ["a", "b"], fit).collect()}
    draws = bayes.draws(fit, 100_000, 1)
    for j, c in ((1, "a"), (2, "b")):
        assert (out[c]["ci_lo"], out[c]["ci_hi"]) == (pytest.approx(np.quantile(draws[:, j], 0.025), abs=0.02), pytest.approx(np.quantile(draws[:, j], 0.975), abs=0.02))


def test_saved_models_give_equal_scores(spark, tmp_path):
    path = str(tmp_path / "model")
    df = spark.createDataFrame([(i, float(i) / 7, float(i % 3), i % 2) for i in range(20)], "r int, a double, b double, y int")
    scored = bayes.score_gaussian(df, ["a", "b"], B, COV)
    draws = bayes.draws(bayes.Fit(B, COV, 1, True), 50, 2)
    cases = attribution.representative_cases(scored, "r").join(scored.withColumnRenamed("r", "row"), "row")
    tables.save_model(spark, path, ["a", "b"], [0.0, 0.0], [1.0, 1.0], B, COV, draws, cases)
    m = tables.load_model(spark, path)
    again = bayes.score_gaussian(df, m["features"], m["b"], m["cov"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))
    np.testing.assert_array_equal(np.array([[r[f"b{i}"] for i in range(3)] for r in m["draws"].orderBy("draw").collect()]), draws)
    assert sorted(map(tuple, m["cases"].collect())) == sorted(map(tuple, cases.collect()))
    of = attribution.contributions(m["cases"].select(F.col("row").alias("r"), "a", "b"), "r", m["features"], m["draws"])
    assert of.count() == 2 * cases.count()
    limits = spark.createDataFrame([("a", -9.0, 9.0), ("b", -9.0, 9.0)], "feature string, low double, high double")
    assert attribution.sweep(m["cases"].select(F.col("row").alias("r"), "a", "b"), "r", m["features"], m["b"], m["cov"], limits).count() > 0
    tables.save_model(spark, path, ["a", "b"], [0.0, 0.0], [1.0, 1.0], B, COV)
    bare = tables.load_model(spark, path)
    assert (bare["draws"], bare["cases"]) == (None, None)
    spark.read.parquet(f"{path}/model").withColumn("version", F.lit(1)).write.parquet(f"{path}2/model")
    with pytest.raises(ValueError, match="version 1"):
        tables.load_model(spark, f"{path}2")
