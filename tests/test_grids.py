"""Batched fits, validation grid, benchmark and search, against numpy fit by fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.functions import rules
from cohortline.operators import batch, bayes, forest
from cohortline.plans import benchmark, search, validation

NAMES = ["theta_rel_a", "b", "ch1_ch2_corr_mean", "d", "e_std", "f"]


def people(n=90, seed=0):
    rng = np.random.default_rng(seed)
    y = (np.arange(n) // 2 % 3 == 0).astype(int)
    x = rng.normal(size=(n, len(NAMES))) + y[:, None] * np.array([0.9, 0, -0.8, 0, 0.5, 0.2])
    x[:, 0] = np.abs(x[:, 0])
    x[:, 2] = np.tanh(x[:, 2])
    x[rng.random(x.shape) < 0.03] = np.nan
    x[5, 1] = 40.0
    return y, x


def as_rows(spark, y, x):
    rows = [(i, f"s{i // 2}" if i % 7 else None, int(y[i]), "pq"[y[i]], *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "r long, s string, y int, kind string, " + ", ".join(f"{c} double" for c in NAMES)).repartition(5)


def hazen(v, p):
    return np.quantile(v, p, method="hazen")


def scaled(train, x, log=False, winsor=False, kinds=False):
    """Values scaled by what the training values say, as the plan states it."""
    train, x = train.copy(), x.copy()
    med = np.nanmedian(train, axis=0)
    for v in (train, x):
        v[:] = np.where(np.isnan(v), med, v)
    if kinds:
        least = train.min(axis=0)
        for j, name in enumerate(NAMES):
            for v in (train, x):
                if rules.transform_kind(name) == "atanh":
                    v[:, j] = np.arctanh(np.clip(v[:, j], -0.999, 0.999))
                elif rules.transform_kind(name) == "log" and least[j] >= 0:
                    v[:, j] = np.log(np.maximum(v[:, j], 0) + rules.EPS)
    if winsor:
        low, high = hazen(train, 0.01) if train.ndim == 1 else (np.array([hazen(c, 0.01) for c in train.T])), np.array([hazen(c, 0.99) for c in train.T])
        train, x = np.clip(train, low, high), np.clip(x, low, high)
    if log:
        train, x = (np.sign(v) * np.log1p(np.abs(v)) for v in (train, x))
    sd = train.std(axis=0, ddof=1)
    sd[sd == 0] = 1
    return (train - train.mean(axis=0)) / sd, (x - train.mean(axis=0)) / sd


def newton(x, y, precision, intercept=0.0, w=None, steps=100):
    a = np.column_stack([np.ones(len(x)), x])
    n = np.bincount(y, minlength=2)
    w = (len(y) / (2 * n))[y] if w is None else w
    pen = np.diag([intercept, *[precision] * x.shape[1]])
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ b))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + pen + 1e-6 * np.eye(len(b))
        b = b - np.linalg.solve(h, a.T @ (w * (p - y)) + pen @ b)
    return b, np.linalg.inv(h)


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def cohens(x, y):
    a, b = x[y == 0], x[y == 1]
    pooled = np.sqrt(((len(a) - 1) * a.var(axis=0, ddof=1) + (len(b) - 1) * b.var(axis=0, ddof=1)) / (len(y) - 2))
    return (b.mean(axis=0) - a.mean(axis=0)) / pooled


@pytest.fixture(scope="module")
def world(spark):
    y, x = people()
    df = as_rows(spark, y, x)
    designs = [validation.Design(seeds=(1, 2), k=3, top_k=None), validation.Design(seeds=(1, 2), k=3, top_k=None, winsor=True, log=True)]
    w = validation.wide_rows(df, "r", "s", NAMES, designs)
    validation.add_splits(w, designs)
    folds = {r["row_id"]: r["folds"] for r in w.rows.select("row_id", "folds").collect()}
    return y, x, df, w, np.array([folds[i] for i in range(len(y))])


def test_folds_keep_subjects_together(world):
    _, _, df, w, folds = world
    assert w.deals == [(3, 1), (3, 2)]
    assert set(folds.ravel().tolist()) == {1, 2, 3}
    of = {r["r"]: r["s"] for r in df.collect()}
    for s in {v for v in of.values() if v}:
        assert len({tuple(folds[i]) for i in of if of[i] == s}) == 1


def test_splits_and_moments(world):
    y, x, _, w, folds = world
    assert len(w.splits) == 12
    for ((log, winsor, kinds), _, deal, train), s in w.splits.items():
        own = folds[:, deal] != train
        tr, te = scaled(x[own], x[~own], log, winsor, kinds)
        np.testing.assert_allclose(s.scaling.apply(x[~own]), te, atol=1e-9)
        m = w.moments[s.name]
        assert m.n.tolist() == np.bincount(y[own]).tolist()
        np.testing.assert_allclose(m.cohens_d(), cohens(tr, y[own]), atol=1e-9)


def test_many_fits_equal_single_ones(world, monkeypatch):
    y, x, _, w, folds = world
    monkeypatch.setattr(batch, "TOGETHER", 3)
    splits = list(w.splits.values())
    rng = np.random.default_rng(1)
    specs = [batch.Spec(str(i), int(rng.integers(len(splits))), tuple(sorted(rng.choice(6, rng.integers(1, 7), replace=False).tolist())), precision=float(rng.choice([0.5, 4.0])), intercept_precision=float(rng.choice([0.0, 0.01])), posterior=bool(i % 2)) for i in range(25)]
    fits = batch.fit_many(w.rows, splits, specs, [w.moments[s.name] for s in splits])
    scored = {}
    for r in batch.score_many(w.rows, splits, specs, fits, held_out=None).collect():
        scored.setdefault(r["spec"], {})[r["row_id"]] = r
    for i, (s, fit) in enumerate(zip(specs, fits, strict=True)):
        split = splits[s.split]
        own = folds[:, split.deal] != split.train
        b, cov = newton(split.scaling.apply(x[own])[:, s.columns], y[own], s.precision, s.intercept_precision)
        np.testing.assert_allclose(fit.b, b, atol=1e-6)
        np.testing.assert_allclose(fit.cov, cov, atol=1e-5)
        assert fit.converged
        assert {k for k, r in scored[i].items() if r["held_out"]} == set(np.flatnonzero(~own).tolist())
        r = scored[i][3]
        a = np.append(1.0, split.scaling.apply(x[3:4])[0, list(s.columns)])
        if s.posterior:
            draws = np.random.default_rng(0).multivariate_normal(b, cov, 100_000) @ a
            assert (r["p"], r["p_std"]) == (pytest.approx((1 / (1 + np.exp(-draws))).mean(), abs=0.005), pytest.approx((1 / (1 + np.exp(-draws))).std(), abs=0.005))
        else:
            assert (r["p"], r["p_std"]) == (pytest.approx(1 / (1 + np.exp(-a @ b)), abs=1e-6), None)


def test_sums_in_two_levels(world, monkeypatch):
    _, _, _, w, _ = world
    monkeypatch.setattr(batch, "ADDED", 1)
    splits = list(w.splits.values())
    again = batch.moments(w.rows.repartition(7), splits)
    for s, m in zip(splits, again, strict=True):
        np.testing.assert_allclose(m.sums, w.moments[s.name].sums, atol=1e-9)


def test_margin_and_its_curve(world):
    y, x, _, w, folds = world
    splits = list(w.splits.values())
    found = [w.moments[s.name] for s in splits]
    one = batch.Spec("m", 0, (0, 2, 4), loss="hinge", precision=1.0)
    fit = batch.fit_many(w.rows, splits, [one], found, bayes.Prior(max_iter=50))[0]
    own = folds[:, splits[0].deal] != splits[0].train
    a = np.column_stack([np.ones(own.sum()), splits[0].scaling.apply(x[own])[:, [0, 2, 4]]])
    t, wt = 2 * y[own] - 1, found[0].weights()[y[own]]
    short = np.maximum(1 - t * (a @ fit.b), 0)
    gradient = -2 * a.T @ (wt * t * short) + np.array([0, 1, 1, 1]) * fit.b
    assert np.abs(gradient).max() < 1e-4
    curve = batch.Spec("c", 0, (0, 2, 4), precision=1e-3, over=fit.b)
    got = batch.fit_many(w.rows, splits, [curve], found)[0]
    np.testing.assert_allclose(got.b, newton((a @ fit.b)[:, None], y[own], 1e-3)[0], atol=1e-5)


def test_discriminants_of_subsets(world):
    y, x, _, w, folds = world
    splits = list(w.splits.values())
    specs = [batch.Spec(str(i), i % len(splits), c) for i, c in enumerate([(0, 1, 2), (3,), (0, 1, 2, 3, 4, 5), (2, 4)])]
    for s, fit in zip(specs, batch.discriminants(w.rows, splits, specs, [w.moments[p.name] for p in splits]), strict=True):
        own = folds[:, splits[s.split].deal] != splits[s.split].train
        v, c = splits[s.split].scaling.apply(x[own])[:, s.columns], y[own]
        wt = (len(c) / (2 * np.bincount(c)))[c]
        mean = [np.average(v[c == k], axis=0, weights=wt[c == k]) for k in (0, 1)]
        cov = sum(((v - mean[k]) * (wt * (c == k))[:, None]).T @ (v - mean[k]) for k in (0, 1)) / wt.sum()
        b = np.linalg.solve(cov, mean[1] - mean[0])
        np.testing.assert_allclose(fit.b, [-(mean[0] + mean[1]) @ b / 2, *b], atol=1e-6)


def test_auc_ranks(world):
    y, x, _, w, folds = world
    splits = list(w.splits.values())[:4]
    validation.add_auc(w, splits)
    for s in splits:
        own = folds[:, s.deal] != s.train
        v = s.scaling.apply(x[own])
        np.testing.assert_allclose(w.auc[s.name], [abs(auc(y[own], c) - 0.5) for c in v.T], atol=1e-9)
        order = validation.ranked(w, s, "auc")
        assert order[0] == int(np.argmax(w.auc[s.name]))


def test_tree_takes_the_best_split():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 1)), rng.integers(0, 2, 80).astype(float)
    feature, threshold, left, right, value = forest.grow(x, y, 1, rng)

    def impurity(c):
        return sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[x[:, 0] <= c], y[x[:, 0] > c]) if len(p))

    cuts = (np.sort(x[:, 0])[1:] + np.sort(x[:, 0])[:-1]) / 2
    assert impurity(threshold[0]) == pytest.approx(min(map(impurity, cuts)))
    assert (feature.tolist(), left[0], right[0]) == ([0, -1, -1], 1, 2)
    assert value[1] == pytest.approx(y[x[:, 0] <= threshold[0]].mean())
    assert forest.share([(feature, threshold, left, right, value)], x).tolist() == np.where(x[:, 0] <= threshold[0], value[1], value[2]).tolist()


def grid_designs():
    return validation.grid_designs(["zscore", "winsor_names"], [2, 3, None], [3], (1,), ranks=("effect", "auc"), fixed=("b", "f"))


def test_grid_by_brute_force(spark, tmp_path):
    y, x = people()
    df = as_rows(spark, y, x).drop("y")
    tasks = [("t", "kind", ["p"], ["q"]), ("back", "kind", ["q"], ["p"])]
    path = str(tmp_path / "grid")
    out = {(r["task"], r["design"], r["row_id"]): r for r in validation.run_grid(df, "r", "s", NAMES, tasks, grid_designs(), path).collect()}
    assert len(out) == 2 * 12 * len(y)
    chosen = {(r["task"], r["design"], r["fold"]): r["features"] for r in validation.grid_selection(spark, path).collect()}
    for name, d in grid_designs().items():
        fold = np.array([out["t", name, i]["fold"] for i in range(len(y))])
        for k in (1, 2, 3):
            tr, te = scaled(x[fold != k], x[fold == k], *d.transform)
            score = np.array([abs(auc(y[fold != k], c) - 0.5) for c in tr.T]) if d.rank == "auc" else np.abs(cohens(tr, y[fold != k]))
            best = sorted(range(6), key=lambda j: (-score[j], NAMES[j]))
            columns = [1, 5] if d.fixed else sorted(best[: d.top_k or 6], key=lambda j: NAMES[j])
            assert chosen["t", name, k] == [NAMES[j] for j in columns]
            b, cov = newton(tr[:, columns], y[fold != k], 4.0, 1 / 400)
            for i, v in zip(np.flatnonzero(fold == k)[:4], te[:4, columns], strict=True):
                p = bayes.predictive(np.append(1.0, v)[None, :], b, cov)[0][0].as_py()
                assert out["t", name, i]["p"] == pytest.approx(p, abs=1e-6)
    m = validation.grid_metrics(spark.read.parquet(f"{path}/predictions")).collect()
    assert len(m) == 24
    of = {(r["task"], r["design"]): r["auc"] for r in m}
    want = auc(y, np.array([out["t", "zscore|top2|k3", i]["p"] for i in range(len(y))]))
    assert of["t", "zscore|top2|k3"] == pytest.approx(want)


def test_small_classes_fail_and_grids_go_on(spark, tmp_path, monkeypatch):
    y, x = people()
    df = as_rows(spark, y, x).drop("y")
    tasks = [("t", "kind", ["p"], ["q"]), ("none", "kind", ["p"], ["zz"])]
    path = str(tmp_path / "grid")
    designs = grid_designs()
    first = dict(list(designs.items())[:2])
    monkeypatch.setattr(validation, "TOGETHER", 3)
    out = validation.run_grid(df, "r", "s", NAMES, tasks, first, path, least=5)
    assert {r["status"] for r in out.filter("task = 'none'").collect()} == {"FAILED: classes of 60 and 0 records; 5 are needed"}
    done = []
    plain = validation.fit_designs
    monkeypatch.setattr(validation, "fit_designs", lambda w, parts: done.extend(p[1] for p in parts) or plain(w, parts))
    out = validation.run_grid(df, "r", "s", NAMES, tasks, designs, path, least=5)
    assert sorted(done) == sorted(set(designs) - set(first))
    assert out.filter("status = 'OK'").groupBy("design").count().collect() and out.filter("status = 'OK'").count() == len(designs) * len(y)
    done.clear()
    assert validation.run_grid(df, "r", "s", NAMES, tasks, designs, path, least=5).count() == len(designs) * (len(y) + 1)
    assert not done


def test_subsets_of_a_generation_by_brute_force(world):
    y, x, _, w, folds = world
    design = validation.Design(seeds=(1, 2), k=3, top_k=None)
    r = batch.correlations(w.rows, 6, [s for s in w.splits.values() if not s.scaling.log])
    subsets = {"one": ["b"], "few": ["b", "d", "f"], "all": NAMES, "two": ["e_std", "theta_rel_a"]}
    out = {q["individual"]: q for q in search.evaluate_subsets(w, subsets, design, r).collect()}
    held = []
    for i, fs in subsets.items():
        columns = [NAMES.index(f) for f in sorted(fs, key=NAMES.index)]
        ps, ys, xs = [], [], []
        for deal in (0, 1):
            for k in (1, 2, 3):
                own = folds[:, deal] != k
                tr, te = scaled(x[own], x[~own])
                b, cov = newton(tr[:, columns], y[own], 4.0, 1 / 400)
                ps += bayes.predictive(np.column_stack([np.ones(len(te)), te[:, columns]]), b, cov)[0].to_pylist()
                ys += y[~own].tolist()
                xs.append(te)
        ps, ys = np.array(ps), np.array(ys)
        assert out[i]["auc"] == pytest.approx(auc(ys, ps), abs=5e-4)  # equal rows may differ in the last bit
        recalls = [((ps >= 0.5) == 1)[ys == 1].mean(), ((ps >= 0.5) == 0)[ys == 0].mean()]
        assert out[i]["balanced_accuracy"] == pytest.approx(np.mean(recalls))
        assert out[i]["n_features"] == len(fs)
        held = np.vstack(xs)
    full = np.abs(np.corrcoef(held.T))
    np.testing.assert_allclose(r, full, atol=1e-9)
    assert out["few"]["redundancy"] == pytest.approx(np.mean([full[1, 3], full[1, 5], full[3, 5]]))
    assert out["one"]["redundancy"] == 0


def test_search_repeats_and_remembers(spark, monkeypatch):
    y, x = people()
    df = as_rows(spark, y, x)
    s = search.Settings(population=4, generations=3, children=2, elite=2, tournament=2, smallest=2, largest=4)
    guide = {m: {n: (i + 1) / 6 for i, n in enumerate(NAMES)} for m in ("decline", "maintain", "balanced")}
    asked = []
    plain = search.evaluate_subsets
    monkeypatch.setattr(search, "evaluate_subsets", lambda w, subsets, *a: asked.extend(subsets) or plain(w, subsets, *a))
    design = validation.Design(seeds=(1,), k=2)
    one = sorted(map(str, search.search(df, "r", "s", NAMES, guide, s, design).collect()))
    assert len(asked) == len(set(asked))
    assert len(one) == 2 * 3 * 4 + 2 * 4
    assert one == sorted(map(str, search.search(df, "r", "s", NAMES, guide, s, design).collect()))


def test_benchmark_by_brute_force(spark, tmp_path):
    y, x = people()
    df = as_rows(spark, y, x)
    args = (df, "r", "s", NAMES, ["zscore", "winsor_log"], [None, 2], list(benchmark.MODELS))
    path = str(tmp_path / "runs")
    runs = benchmark.benchmark(*args, seeds=(1,), k=3, trees=8, fixed=("d",), path=path).collect()
    assert len(runs) == 2 * 3 * 3 * 5
    assert {r["status"] for r in runs} == {"OK"}
    again = benchmark.benchmark(*args, seeds=(1, 2), k=3, trees=8, fixed=("d",), path=path)
    assert again.count() == 2 * len(runs)
    assert {tuple(r) for r in runs} <= {tuple(r) for r in again.collect()}
    w = validation.wide_rows(df, "r", "s", NAMES, [validation.Design(seeds=(1,), k=3)])
    fold = {r["row_id"]: r["folds"][0] for r in w.rows.collect()}
    fold = np.array([fold[i] for i in range(len(y))])
    grid = [0.05, 0.1, *[round(0.15 + 0.01 * i, 2) for i in range(71)], 0.9, 0.95]
    for r in runs:
        if r["model"] not in ("bayes", "ridge") or r["feature_set"] != "top2":
            continue
        own = fold != r["fold"]
        tr, te = scaled(x[own], x[~own], *validation.TRANSFORMS[r["preprocessing"]])
        best = sorted(sorted(range(6), key=lambda j: (-abs(cohens(tr, y[own])[j]), NAMES[j]))[:2], key=lambda j: NAMES[j])
        assert r["features"] == ",".join(NAMES[j] for j in best)
        b, cov = newton(tr[:, best], y[own], 4.0 if r["model"] == "bayes" else benchmark.RIDGE * own.sum())
        p = [bayes.predictive(np.column_stack([np.ones(len(v)), v[:, best]]), b, cov)[0].to_numpy() if r["model"] == "bayes" else 1 / (1 + np.exp(-(b[0] + v[:, best] @ b[1:]))) for v in (tr, te)]

        def balanced(t, q, c):
            return ((q[c == 1] >= t).mean() + (q[c == 0] < t).mean()) / 2

        cut = max(sorted({*grid, *p[0].tolist()}), key=lambda t: (round(balanced(t, p[0], y[own]), 12), -t))
        assert balanced(r["threshold"] - 1e-6, p[0], y[own]) == pytest.approx(balanced(cut, p[0], y[own]))  # it may be a prediction itself
        assert r["balanced_accuracy"] == pytest.approx(balanced(r["threshold"], p[1], y[~own]))
        assert (r["n_train"], r["n_test"], r["n_test_pos"]) == (own.sum(), (~own).sum(), y[~own].sum())
        assert (r["p_std_mean"] is not None) == (r["model"] == "bayes")
    by = {(s["preprocessing"], s["feature_set"], s["model"]): s["runs"] for s in benchmark.summary(spark.read.parquet(path)).collect()}
    assert set(by.values()) == {6} and len(by) == 30
    better = [r["auc"] for r in runs if r["feature_set"] == "all"]
    assert np.mean(better) > 0.6


def test_benchmark_of_failed_fits(spark):
    y, x = people(24)
    df = as_rows(spark, y, x)
    runs = benchmark.benchmark(df, "r", "s", NAMES, ["zscore"], [2], ["discriminant", "forest"], seeds=(3,), k=2, fixed=("unknown",), trees=3).collect()
    assert {(r["feature_set"], r["status"]) for r in runs} == {("top2", "OK"), ("fixed1", "FAILED: no features")}
    with pytest.raises(ValueError, match="classes of 16 and 0 records"):
        benchmark.benchmark(df.filter("y = 0"), "r", "s", NAMES, ["zscore"], [2], ["bayes"])
