"""Statistics, folds, preprocessing, metrics and models against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.functions import rules, stats
from cohortline.operators import attribution, bayes, features, folds, metrics, prep, segments, signal


def hazen(x, p):
    return float(np.quantile(x, p, method="hazen"))


@pytest.mark.parametrize("whole", [10, 10_000])
def test_hazen(spark, whole):
    rng = np.random.default_rng(0)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 4), ("c", 3000)) for v in rng.normal(size=n)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    ps = {"q1": 0.25, "hi": 0.99, "lo": 0.0}
    out = {r["k"]: r for r in stats.hazen_percentiles(df, ["k"], "v", ps, whole).collect()}
    assert set(out) == {"a", "b", "c"}
    for k in out:
        x = [v for kk, v in rows if kk == k]
        for name, p in ps.items():
            assert out[k][name] == pytest.approx(hazen(x, p))


def test_percentiles_of_ties_are_counted(spark):
    """Nine tenths of a column are one value: it is one cell, and no list has its copies."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(6000) < 0.9, 1.5, np.round(rng.normal(size=6000), 3))
    df = spark.createDataFrame([("k", float(v)) for v in x] + [("one", 2.0)] * 500, "k string, v double")
    out = {r["k"]: r for r in stats.hazen_percentiles(df, ["k"], "v", {"m": 0.5, "q": 0.93, "lo": 0.02}, whole=100).collect()}
    for name, p in (("m", 0.5), ("q", 0.93), ("lo", 0.02)):
        assert out["k"][name] == pytest.approx(hazen(x, p))
        assert out["one"][name] == 2.0
    slots = df.withColumns({"lo": F.lit(1.0), "hi": F.lit(1.6)})
    cells = {r["k"]: r["cells"] for r in stats.counted_cells(slots, ["k"], "v", [("lo", "hi")], [F.count("*").alias("c")]).collect()}
    assert len(cells["k"]) <= len(set(x[(x >= 1.0) & (x <= 1.6)])) + 2
    assert sum(c["c"] for c in cells["k"]) == 6000
    assert cells["one"] == [(2.0, 500)]


def plain_parameters(v, fold, t, name, log, winsor, kinds):
    train = v[fold != t]
    known = train[~np.isnan(train)]
    med = np.median(known) if len(known) else 0.0
    x = np.where(np.isnan(train), med, train)
    least = known.min() if len(known) else None
    if kinds and rules.transform_kind(name) == "atanh":
        x = np.arctanh(np.clip(x, -0.999, 0.999))
    elif kinds and rules.transform_kind(name) == "log" and least is not None and least >= 0:
        x = np.log(np.maximum(x, 0) + rules.EPS)
    low, high = (hazen(x, 0.01), hazen(x, 0.99)) if winsor else (None, None)
    x = np.clip(x, low, high) if winsor else x
    x = np.sign(x) * np.log1p(np.abs(x)) if log and not kinds else x
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return med, least, low, high, x.mean(), sd if sd > 1e-12 else 1.0


@pytest.mark.parametrize(("whole", "log", "winsor", "kinds"), [(10_000, True, True, False), (50, True, True, False), (50, False, True, True), (50, False, False, False), (10_000, False, True, True)])
def test_fold_parameters_by_brute_force(spark, whole, log, winsor, kinds):
    """Ties, missing values in large and small numbers, folds of different sizes and values, one fold with all of the smallest."""
    rng = np.random.default_rng(7)
    n = 1500
    fold = rng.choice([1, 2, 3], n, p=[0.6, 0.3, 0.1])
    values = {
        "plain": rng.normal(size=n), "theta_rel_x": np.abs(rng.normal(size=n)), "corr_mean_x": np.tanh(rng.normal(size=n)), "ties": np.where(rng.random(n) < 0.9, 3.0, rng.normal(size=n)),
        "apart": rng.normal(size=n) + 100.0 * (fold == 1), "gaps": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n)), "theta_rel_gaps": np.where(rng.random(n) < 0.02, np.nan, np.abs(rng.normal(size=n))),
        "constant": np.full(n, 2.0), "missing": np.full(n, np.nan), "half": np.where(fold == 2, np.nan, rng.normal(size=n)),
    }
    rows = [("a", 4, int(f), name, None if np.isnan(v) else float(v)) for name, vs in values.items() for f, v in zip(fold, vs, strict=True)]
    df = spark.createDataFrame(rows, "task string, seed int, fold int, feature string, value double").repartition(4)
    out = {(r["feature"], r["train"]): r for r in prep.fold_parameters(df, 3, log=log, winsor=winsor, kinds=kinds, by=["task"], whole=whole).collect()}
    assert len(out) == 3 * len(values)
    for (name, t), r in out.items():
        want = plain_parameters(values[name], fold, t, name, log, winsor, kinds)
        for c, v in zip(("med", "least", "low", "high", "mean", "sd"), want, strict=True):
            assert (r[c] == pytest.approx(v, abs=1e-9)) if v is not None else r[c] is None, (name, t, c)


def test_folds_keep_subjects_together(spark):
    df = spark.createDataFrame([(i, i // 3, int(i % 7 == 0)) for i in range(90)], "r int, s int, y int")
    f = folds.subject_folds(df, "s", "y", 3, [1, 2])
    joined = folds.fold_of_records(df, f, "s")
    assert joined.count() == 180
    assert joined.groupBy("seed", "s").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = f.groupBy("seed", "positive", "fold").count().groupBy("seed", "positive").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.filter("d > 1").count() == 0


def test_parameters_dont_see_held_out_rows(spark):
    rows = [(1, 1 + i % 3, "f", float(i)) for i in range(30)]
    schema = "seed int, fold int, feature string, value double"
    one = prep.fold_parameters(spark.createDataFrame(rows, schema), 3, log=True, winsor=True).filter("train = 1").head()
    changed = [(s, f, n, v if f != 1 else 1e6) for s, f, n, v in rows]
    two = prep.fold_parameters(spark.createDataFrame(changed, schema), 3, log=True, winsor=True).filter("train = 1").head()
    assert one == two


def test_class_weights_sum_to_n(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    w = {r["y"]: r["weight"] for r in prep.class_weights(df, [], "y").collect()}
    assert w == {0: pytest.approx(2 / 3), 1: 2.0}


def brute_auc(y, p):
    a, b = p[y == 1], p[y == 0]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))


def test_metrics(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame([("g", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))] + [("h", 0, 1, 1.0), ("h", 1, 1, 0.2)], "g string, row_id int, y int, p double")
    out = {r["g"]: r for r in metrics.evaluate(df, ["g"]).collect()}
    assert out["g"]["auc"] == pytest.approx(brute_auc(y, p))
    assert out["h"]["auc"] is None
    flipped = df.withColumn("y", 1 - F.col("y"))
    assert {r["g"]: r["auc"] for r in metrics.area_under_roc(flipped, ["g"]).collect()}["g"] == pytest.approx(1 - brute_auc(y, p))
    order = np.lexsort((np.arange(400), -p))
    tp = np.cumsum(y[order])
    precision, recall = np.r_[1, tp / np.arange(1, 401)], np.r_[0, tp / tp[-1]]
    assert out["g"]["auprc"] == pytest.approx(np.trapezoid(precision, recall))
    t = {r["g"]: r for r in metrics.best_threshold(df, ["g"]).collect()}["g"]
    grid = sorted({0.05, 0.1, 0.9, 0.95, *[round(0.15 + 0.01 * i, 2) for i in range(71)], *p.tolist()})
    ba = [round(((p >= c)[y == 1].mean() + (p < c)[y == 0].mean()) / 2, 12) for c in grid]
    assert (t["threshold"], t["train_ba"]) == (pytest.approx(grid[int(np.argmax(ba))]), pytest.approx(max(ba)))


def test_auc_of_ties_and_last_bin(spark):
    df = spark.createDataFrame([(0, 0, 0.5), (1, 1, 0.5)], "row_id int, y int, p double")
    assert metrics.area_under_roc(df, []).head()["auc"] == 0.5
    one = spark.createDataFrame([(0, 1, 1.0)], "row_id int, y int, p double")
    assert metrics.calibration_error(one, []).head()["ece"] == 0.0


def test_fit_is_a_stationary_point(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([("k", [float(v) for v in a], int(b), 1.0) for a, b in zip(x, y, strict=True)], "key string, x array<double>, y int, w double")
    fit = bayes.fit_logistic(df, 3, ["k"])["k"]
    a = np.c_[np.ones(300), x]
    p = 1 / (1 + np.exp(-a @ fit.b))
    penalty = np.array([1 / 400, 4, 4, 4])
    assert np.linalg.norm(a.T @ (p - y) + penalty * fit.b) < 1e-3
    hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
    assert np.allclose(fit.cov @ hessian, np.eye(4), atol=1e-3)
    assert fit.converged


def test_gaussian_scores_agree_with_draws(spark):
    fit = bayes.Fit(np.array([0.2, 1.0]), np.array([[0.1, 0.02], [0.02, 0.2]]), 1, True)
    df = spark.createDataFrame([(float(v),) for v in np.linspace(-2, 2, 9)], "f double")
    a = bayes.score_gaussian(df, ["f"], fit.b, fit.cov).toPandas()
    b = bayes.score_draws(df, ["f"], bayes.draws(fit, 20_000, 1)).toPandas()
    for c in ("p", "p_std", "ci_lo", "ci_hi"):
        assert np.abs(a[c] - b[c]).max() < 0.02


def test_sweep_keeps_its_own_point(spark):
    df = spark.createDataFrame([(1, 2.0, 0.1), (2, -2.0, 0.3)], "r int, a double, b double")
    limits = spark.createDataFrame([("a", -9.0, 9.0), ("b", -9.0, 9.0)], "feature string, low double, high double")
    b, cov = np.array([0.0, 2.0, 0.1]), np.eye(3) * 0.01
    s = attribution.sweep(df, "r", ["a", "b"], b, cov, limits, points=11)
    assert s.filter("offset = 0 AND NOT preserved").count() == 0
    none = attribution.preserving_ranges(s.withColumn("preserved", F.lit(False)), "r").head()
    assert (none["width"], none["min_z"], none["points"]) == (0.0, None, 0)


def test_segments(spark):
    df = spark.createDataFrame([(k, i, float(i % 5)) for k, n in (("a", 19), ("b", 20), ("c", 30), ("d", 29)) for i in range(n)], "k string, i0 int, x double")
    cut = segments.cut_segments(df.withColumnRenamed("i0", "t"), "k", ["t"], 20, 10)
    assert {r["k"]: r["n"] for r in cut.groupBy("k").agg(F.countDistinct("segment").alias("n")).collect()} == {"b": 1, "c": 2, "d": 1}
    one = segments.roll_up(spark.createDataFrame([("a", 1.0)], "k string, v double"), "k", ["v"]).head()
    assert one["v_std"] == 0.0


def test_reject(spark):
    flat = [("flat", 0, i, 1.0) for i in range(20)]
    jump = [("jump", 0, i, 6.0 if i == 9 else 0.1 * (i % 3)) for i in range(20)]
    high = [("high", 0, i, 5.5 if i < 2 else 0.5 * (i % 3) + 1) for i in range(20)]
    good = [("good", 0, i, 0.5 * (i % 3)) for i in range(20)]
    df = spark.createDataFrame(flat + jump + high + good, "k string, segment int, i int, x double")
    assert {r["k"]: r["bad"] for r in segments.describe_segments(df, "k").collect()} == {"flat": True, "jump": True, "high": True, "good": False}


def test_filter_and_spectrum():
    t = np.arange(2500) / 250
    for f, least, most in ((0.1, 0, 0.05), (10, 0.95, 1.05), (80, 0, 0.1)):
        x = np.sin(2 * np.pi * f * t)[:, None]
        y = signal.zero_phase(x, signal.butterworth(1, 45, 250))[500:-500, 0]
        gain = np.abs(y).max()
        assert least <= gain <= most
        if f == 10:
            assert np.corrcoef(y, x[500:-500, 0])[0, 1] > 0.999
    d = signal.describe(np.sin(2 * np.pi * 10 * t)[None, :], 250, 500, 250)
    assert d["median_freq"][0] == pytest.approx(10, abs=0.5)
    assert d["alpha_rel"][0] > 0.95


def test_imputation_and_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), None), (3, 3.0, None)], "id int, a double, b double")
    out = features.impute_median(df, ["a", "b"]).orderBy("id").collect()
    assert [(r["a"], r["b"]) for r in out] == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]
    assert features.feature_columns(df, ["id"]) == ["a", "b"]
    assert features.subject_column(df) == "id"
    with pytest.raises(ValueError, match="c"):
        features.need_columns(df, ["c"])
