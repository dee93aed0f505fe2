"""Folds, search, grids, signals and models of the benchmark, against numpy and by hand."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cohortline.operators import attribution, bayes, features, folds, metrics, models, ranking, segments, signal, trajectory
from cohortline.plans import extraction, search, validation


def people(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    y = (np.arange(n) // 2 % 3 == 0).astype(int)
    x = rng.normal(size=(n, 4)) + y[:, None] * np.array([1.5, 0, -1.0, 0])
    rows = [(i, f"s{i // 2}" if i % 7 else None, int(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "r long, s string, y int, a double, b double, c double, d double")


def test_records_without_subject_are_their_own(spark):
    df = people(spark)
    own = folds.with_own_subjects(df, "s", "r")
    f, k = folds.dealt_folds(own, "s", "y", 3, [1, 2])
    joined = folds.fold_of_records(own, f, "s")
    assert k == 3
    assert joined.count() == 2 * df.count()
    per = joined.groupBy("seed", "fold").agg(F.countDistinct("y").alias("n")).collect()
    assert all(r["n"] == 2 for r in per)
    blank = spark.createDataFrame([(1, " "), (2, None), (3, "x")], "r int, s string")
    assert folds.with_own_subjects(blank, "s", "r").select("s").distinct().count() == 3


def test_folds_shrink_and_fail(spark):
    few = spark.createDataFrame([(i, f"s{i}", int(i < 2)) for i in range(20)], "r int, s string, y int")
    f, k = folds.dealt_folds(few, "s", "y", 5, [3])
    assert (k, f.select("fold").distinct().count()) == (2, 2)
    with pytest.raises(ValueError, match="two subjects"):
        folds.dealt_folds(few.filter("r <> 0"), "s", "y", 5, [3])


def test_fitness(spark):
    row = dict(recall0=0.4, recall1=0.9, auc=None, balanced_accuracy=0.65, macro_f1=0.6, n_features=7, redundancy=0.3)
    row |= {f"{c}_mean{k}": v for c, k, v in (("p_std", "", 0.15), ("p_std", "0", 0.3), ("p_std", "1", 0.075), ("attr_unc", "", 0.05), ("attr_unc", "0", 0.01), ("attr_unc", "1", 0.2))}
    df = spark.createDataFrame([Row(**{k: v for k, v in row.items() if v is not None})]).withColumn("auc", F.lit(None).cast("double"))
    out = df.select(*[search.fitness(k).alias(k) for k in ("decline", "maintain", "balanced")]).head()
    common = 0.025 * 0.5 + 0.035 * 0.5
    assert out["decline"] == pytest.approx(0.45 * 0.9 + 0.2 * 0.5 + 0.2 * 0.65 + 0.15 * 0.6 - 0.25 * 0.05 - 0.08 * 0.5 - 0.07 * 2 - common)
    assert out["maintain"] == pytest.approx(0.45 * 0.4 + 0.2 * 0.5 + 0.2 * 0.65 + 0.15 * 0.6 - 0.08 * 2 - 0.07 * 0.2 - common)
    assert out["balanced"] == pytest.approx(0.35 * 0.65 + 0.25 * 0.5 + 0.2 * 0.6 + 0.2 * 0.4 - 0.08 - 0.07 - common)


def test_guide_is_boosted_by_elites():
    guide = {m: {"a": 1.0, "b": 0.5, "c": 0.0} for m in ("decline", "maintain", "balanced")}
    out = search.boosted(guide, {"decline": [["c"], ["c", "b"]], "maintain": [["a"]]})
    assert out["decline"] == {"a": 0.0, "b": 0.0, "c": 0.0} or out["decline"] == pytest.approx({"a": 1.0, "b": 1.0, "c": 1.0})
    assert out["maintain"] == pytest.approx({"a": 1.0, "b": 0.25, "c": 0.0})
    assert out["balanced"] == pytest.approx({"a": 1.0, "b": 0.25 / 1.0, "c": 0.0})


def test_guide_scores_of_no_effect(spark):
    e = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", -1.0), ("d", 0.5)], "feature string, signed_effect double")
    out = {r["feature"]: r for r in ranking.guide_scores(e, []).collect()}
    assert (out["a"]["decline_score"], out["a"]["maintain_score"]) == (0.0, 0.0)
    assert (out["b"]["decline_score"], out["b"]["maintain_score"]) == (1.0, 0.65)
    cut = np.quantile([0, 1, 0.5, 0.25], 0.65, method="hazen")
    for k, v in (("c", 0.5), ("d", 0.25)):
        assert out[k]["balanced_score"] == pytest.approx(v if v >= cut else v / 4)


def test_search_uses_all_phases(spark):
    df = people(spark, 80)
    names = ["a", "b", "c", "d"]
    s = search.Settings(population=3, generations=2, children=1, elite=1, tournament=2, smallest=2, largest=3)
    guide = {m: dict.fromkeys(names, 0.5) for m in ("decline", "maintain", "balanced")}
    out = search.search(df, "r", "s", names, guide, s, validation.Design(seeds=(1,), k=2)).cache()
    assert {(r["phase"], r["n"]) for r in out.groupBy("phase").agg(F.count("*").alias("n")).collect()} == {("decline", 6), ("maintain", 6), ("balanced", 3)}
    log = {(r["phase"], r["generation"]): r for r in search.generation_log(out).collect()}
    best = out.filter("phase = 'decline' AND generation = 1").orderBy(F.col("fitness").desc(), F.col("individual").desc()).head()
    assert (log["decline", 1]["best"], log["decline", 1]["best_auc"], log["decline", 1]["best_n_features"]) == (best["fitness"], best["auc"], best["n_features"])


def test_grid_is_taken_up_again(spark, tmp_path, monkeypatch):
    df = people(spark).withColumn("kind", F.when(F.col("y") == 1, "p").otherwise("q"))
    path = str(tmp_path / "grid")
    designs = validation.grid_designs(["zscore"], [2, None], [2], (1,))
    tasks = [("t", "kind", ["q"], ["p"]), ("empty", "kind", ["q"], ["none"])]
    first = validation.run_grid(df.drop("y"), "r", "s", ["a", "b", "c", "d"], tasks, dict(list(designs.items())[:1]), path)
    n = first.filter("status = 'OK'").count()
    assert n == 60
    assert first.filter("status LIKE 'FAILED%'").count() == 1
    done = []
    plain = validation.fit_designs
    monkeypatch.setattr(validation, "fit_designs", lambda w, parts: done.extend(p[:2] for p in parts) or plain(w, parts))
    out = validation.run_grid(df.drop("y"), "r", "s", ["a", "b", "c", "d"], tasks, designs, path)
    assert done == [("t", "zscore|topall|k2")]
    assert out.filter("status = 'OK'").count() == 120
    m = validation.grid_metrics(out).collect()
    assert len(m) == 2
    assert all(r["auc"] > 0.6 and r["p_std_mean"] > 0 for r in m)


def test_mean_of_folds_then_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(s, f, i, int(i % 2), float(rng.random())) for s in (1, 2) for f in (1, 2) for i in range(10)]
    df = spark.createDataFrame(rows, "seed int, fold int, row_id int, y int, p double")
    out = validation.fold_then_repeat(df, ["brier"]).head()
    brier = {(s, f): np.mean([(p - y) ** 2 for ss, ff, _, y, p in rows if (ss, ff) == (s, f)]) for s in (1, 2) for f in (1, 2)}
    per = [np.mean([brier[s, f] for f in (1, 2)]) for s in (1, 2)]
    assert (out["runs"], out["brier_mean"], out["brier_std"]) == (2, pytest.approx(np.mean(per)), pytest.approx(np.std(per, ddof=1)))


def test_uncertainty_by_class(spark):
    df = spark.createDataFrame([("k", 0, 0.1, 0.2, 0.6), ("k", 1, 0.3, 0.1, 0.9), ("k", 1, 0.5, None, None)], "k string, y int, p_std double, ci_lo double, ci_hi double")
    r = metrics.uncertainty(df, ["k"]).head()
    assert (r["p_std_mean"], r["p_std_mean0"], r["p_std_mean1"], r["ci_width_mean"]) == (pytest.approx(0.3), 0.1, 0.4, pytest.approx(0.6))
    assert "entropy_mean" not in r.asDict()


def test_attribution_spread_by_draws(spark):
    rng = np.random.default_rng(3)
    b, root = rng.normal(size=4), rng.normal(size=(4, 4)) * 0.3
    cov = root @ root.T + 0.01 * np.eye(4)
    x = rng.normal(size=(5, 3))
    rows = spark.createDataFrame([(i, "k", list(map(float, v)), 0) for i, v in enumerate(x)], "r int, key string, x array<double>, y int")
    out = {r["r"]: r for r in bayes.score_fits(rows, {"k": bayes.Fit(b, cov, 1, True)}, ["r", "y"]).collect()}
    draws = rng.multivariate_normal(b, cov, 200_000)
    for i, v in enumerate(x):
        p = 1 / (1 + np.exp(-(draws @ np.append(1.0, v))))
        want = (p * (1 - p))[:, None] * draws[:, 1:] * v
        assert out[i]["attr_unc"] == pytest.approx(want.std(axis=0).mean(), rel=0.03)
        assert (out[i]["p"], out[i]["p_std"]) == (pytest.approx(p.mean(), abs=0.005), pytest.approx(p.std(), abs=0.005))
        assert out[i]["ci_hi"] == pytest.approx(np.quantile(p, 0.975), abs=0.01)


def test_coefficients_in_order(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "feature string, abs_z double")
    assert [r["feature"] for r in bayes.rank_coefficients(s).collect()] == ["b", "c", "a"]
    t = spark.createDataFrame([("a", 1.0), ("c", 0.5)], "feature string, stability double")
    assert [r["feature"] for r in bayes.rank_coefficients(s, t).collect()] == ["a", "c", "b"]


def test_ranges_in_own_units(spark):
    swept = spark.createDataFrame([(1, "f", -1.0, True), (1, "f", 0.5, True), (1, "f", 1.0, False), (2, "f", 0.0, False)], "r int, feature string, z double, preserved boolean")
    scale = spark.createDataFrame([("f", 10.0, 2.0)], "feature string, mean double, sd double")
    out = {r["r"]: r for r in attribution.preserving_ranges(swept, "r", scale).collect()}
    assert (out[1]["low"], out[1]["high"], out[1]["own_width"]) == (8.0, 11.0, 3.0)
    assert (out[2]["low"], out[2]["own_width"]) == (None, 0.0)


def test_two_channel_features_by_numpy(spark):
    rng = np.random.default_rng(4)
    t = np.arange(250 * 25) / 250
    files = [(k, (np.sin(2 * np.pi * 10 * t) + rng.normal(size=len(t))).tolist(), (np.sin(2 * np.pi * 6 * t) + 0.5 * rng.normal(size=len(t))).tolist()) for k in ("a", "b")]
    files += [("short", [0.0] * 100, [0.0] * 100), ("null", None, [1.0]), ("flat", [1.0] * 5000, [2.0] * 5000)]
    df = spark.createDataFrame(files, "file_key string, ch1 array<double>, ch2 array<double>")
    out = {r["file_key"]: r for r in extraction.file_features(df, "file_key").collect()}
    assert set(out) == {"a", "b"}
    assert len(out["a"]) == 2 + 64
    for k, a, b in files[:2]:
        x = signal.clean(np.array([a, b]).T, 250.0).T
        parts = [x[:, i : i + 2500] for i in range(0, x.shape[1] - 2499, 1250)]
        good = [p for p in parts if not (np.abs(p).max() > 8 or (p.std(axis=1, ddof=1) < 0.05).any() or np.abs(np.diff(p)).max() > 5 or (np.abs(p) > 5).mean() > 0.05)]
        assert out[k]["num_segments"] == len(good) == 4
        r = [np.corrcoef(p)[0, 1] for p in good]
        assert out[k]["ch1_ch2_corr_mean"] == pytest.approx(np.mean(r))
        assert out[k]["ch1_ch2_corr_iqr"] == pytest.approx(np.quantile(r, 0.75, method="hazen") - np.quantile(r, 0.25, method="hazen"))
        d = [signal.describe(p, 250.0, 500, 250) for p in good]
        assert out[k]["ch2_alpha_rel_std"] == pytest.approx(np.std([e["alpha_rel"][1] for e in d], ddof=1))
        assert out[k]["mean_sef95_med"] == pytest.approx(np.median([e["sef95"].mean() for e in d]))
        assert out[k]["ch1_median_freq_mean"] == pytest.approx(10, abs=2)
    capped = {r["file_key"]: r["num_segments"] for r in extraction.file_features(df, "file_key", cap=2).collect()}
    assert capped == {"a": 2, "b": 2}
    assert segments.roll_up(spark.createDataFrame([], "k string, v double"), "k", ["v"]).count() == 0


def test_files_and_tasks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "r int, file_key string")
    files = spark.createDataFrame([("p2", "a"), ("p1", "a"), ("p3", "c")], "path string, file_key string")
    found, missing = trajectory.match_files(rows, files)
    assert [(r["r"], r["path"]) for r in found.collect()] == [(1, "p1")]
    assert sorted(r["r"] for r in missing.collect()) == [2, 3]
    picked = features.pick_task(rows, "file_key", ["a"], ["b", "z"], ("A", "B")).collect()
    assert sorted((r["r"], r["y"], r["task_class"]) for r in picked) == [(1, 0, "A"), (2, 1, "B")]


@pytest.mark.parametrize("kind", ["ridge", "forest", "margin", "discriminant"])
def test_benchmark_models(spark, kind):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 3)) + y[:, None] * np.array([2.0, 0, -1.5])
    df = spark.createDataFrame([(i, list(map(float, x[i])), int(y[i]), 1.0) for i in range(200)], "row_id int, x array<double>, y int, w double")
    train, test = df.filter("row_id < 120"), df.filter("row_id >= 120").drop("w")
    made = models.discriminant(train, test, 3) if kind == "discriminant" else getattr(models, kind)(train, test)
    out = {r["row_id"]: r["p"] for r in made.select("row_id", "p").collect()}
    p = np.array([out[i] for i in range(120, 200)])
    assert ((p >= 0) & (p <= 1)).all()
    assert ((p >= 0.5) == y[120:]).mean() > 0.85
    if kind == "discriminant":
        a, b = x[:120][y[:120] == 0], x[:120][y[:120] == 1]
        cov = ((a - a.mean(0)).T @ (a - a.mean(0)) + (b - b.mean(0)).T @ (b - b.mean(0))) / 120
        w = np.linalg.solve(cov, b.mean(0) - a.mean(0))
        z = x[120:] @ w - 0.5 * (b.mean(0) + a.mean(0)) @ w + np.log(len(b) / len(a))
        assert p == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
