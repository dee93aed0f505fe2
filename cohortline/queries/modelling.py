"""Folds, preprocessing, ranking, metrics, posterior scores and sweeps over embeddings and labels.

The embeddings are the feature table: 64 features, class 1 is label 0, three neighbouring ids are one subject.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, stats
from ..operators import attribution, bayes, features, folds, metrics, prep, ranking
from ..plans import benchmark, search, signature, validation
from ..sources import tables
from ..sources.shared import new_folder

K, SEEDS = 3, (42, 43)
SWEPT = ["p_std", "ci_lo", "ci_hi", "logit", "logit_std", "prob", "prob_std"]
SEVEN = [f"f{i}" for i in range(7)]
ALL = [f"f{i}" for i in range(64)]
#: Parameters of the model that the scoring queries take (intercept first).
B = np.array([-1.2, 0.8, -0.5, 0.3, 1.1, -0.9, 0.2, 0.4])
COV = np.diag([0.09, 0.04, 0.05, 0.03, 0.06, 0.05, 0.04, 0.03]) + 0.005


def _features(spark: SparkSession, d: str, n: int = 7) -> DataFrame:
    e = tables.read(spark, d, "embeddings").filter("embedding IS NOT NULL")
    e = e.withColumns({"y": (F.col("label") == 0).cast("int"), "subject": F.floor(F.col("vec_id") / 3)})
    return features.unpack(e, "embedding", "f", n).drop("embedding")


def _long(spark: SparkSession, d: str, n: int = 7) -> DataFrame:
    f = _features(spark, d, n)
    return features.to_long(f, ["vec_id", "subject", "y"], [f"f{i}" for i in range(n)])


def _folded(spark: SparkSession, d: str, n: int = 7) -> DataFrame:
    f = folds.subject_folds(_features(spark, d, 0), "subject", "y", K, list(SEEDS))
    return _long(spark, d, n).join(f.select("seed", "subject", "fold"), "subject")


def subject_folds(spark: SparkSession, d: str) -> DataFrame:
    return folds.subject_folds(_features(spark, d, 0), "subject", "y", K, list(SEEDS))


def record_folds(spark: SparkSession, d: str) -> DataFrame:
    return folds.record_folds(_features(spark, d, 0), "vec_id", "y", K, 42).select("vec_id", "y", "fold")


def valid_seeds(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d, 0)
    return folds.valid_seeds(f, folds.subject_folds(f, "subject", "y", K, [1, 2, 3, 4, 5]), "subject", "y", K)


def class_subjects(spark: SparkSession, d: str) -> DataFrame:
    return folds.subjects_by_class(_features(spark, d, 0), "subject", "y")


def fold_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Training medians, 1st and 99th percentile, mean and spread after winsor and signed log."""
    p = prep.fold_parameters(_folded(spark, d, 64), K, log=True, winsor=True)
    return p.select("seed", "train", "feature", *[F.round(c, 6).alias(c) for c in ("med", "least", "low", "high", "mean", "sd")])


def scaled_features(spark: SparkSession, d: str) -> DataFrame:
    """Moments of the scaled values in training and held-out rows."""
    rows = _folded(spark, d, 64)
    x = prep.apply_parameters(rows, prep.fold_parameters(rows, K))
    return x.groupBy("seed", "train", "feature", "held_out").agg(F.count("*").alias("n"), F.round(F.avg("x") + 1, 6).alias("mean1"), F.round(F.max("x"), 6).alias("max"))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    train = prep.training_sets(_folded(spark, d, 1), K)
    return prep.class_weights(train, ["seed", "train"], "y").withColumn("weight", F.round("weight", 6))


def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = ranking.guide_scores(ranking.effect_sizes(ranking.class_moments(_long(spark, d, 64), [])), [])
    return e.select("feature", *[F.round(c, 6).alias(c) for c in ("effect", "signed_effect", "cohens_d", "base", "decline_score", "maintain_score", "balanced_score")])


def auc_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.auc_distance(_long(spark, d, 64), []).withColumn("auc_distance", F.round("auc_distance", 6))


def fold_top_features(spark: SparkSession, d: str) -> DataFrame:
    train = prep.training_sets(_folded(spark, d, 64), K).filter("train <> fold")
    e = ranking.effect_sizes(ranking.class_moments(train, ["seed", "train"])).withColumn("score", F.round("effect", 9))
    return ranking.top_features(e, ["seed", "train"], "score", 5).withColumn("features", F.array_join("features", ","))


def selection_stability(spark: SparkSession, d: str) -> DataFrame:
    train = prep.training_sets(_folded(spark, d, 64), K).filter("train <> fold")
    e = ranking.effect_sizes(ranking.class_moments(train, ["seed", "train"])).withColumn("score", F.round("effect", 9))
    top = ranking.top_features(e, ["seed", "train"], "score", 5)
    names = spark.createDataFrame([(f,) for f in ALL], "feature string")
    return metrics.selection_stability(top, ["seed"], names, "train").withColumn("stability", F.round("stability", 6))


def redundancy(spark: SparkSession, d: str) -> DataFrame:
    return ranking.mean_abs_correlation(_features(spark, d, 64), ALL).select(F.round("redundancy", 6).alias("redundancy"))


def imputed(spark: SparkSession, d: str) -> DataFrame:
    """Values over 0.2 taken as missing, then replaced by the median of the others."""
    f = _features(spark, d, 64).withColumns({c: F.when(F.col(c) <= 0.2, F.col(c)) for c in ALL})
    out = features.impute_median(f, ALL)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ALL])


def task_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two tasks over the market segments, counted by class."""
    c = tables.read(spark, d, "customer")
    tasks = [("a", "c_mktsegment", ["BUILDING"], ["MACHINERY"]), ("b", "c_mktsegment", ["BUILDING", "HOUSEHOLD"], ["AUTOMOBILE", "FURNITURE"])]
    return features.all_tasks(c, tasks).groupBy("task", "y").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p"))
    lab = tables.read(spark, d, "labels").filter("quality IS NOT NULL").select("doc_id", F.col("quality").alias("y"))
    return docs.join(lab, "doc_id").withColumnRenamed("doc_id", "row_id")


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """All metrics by language."""
    out = metrics.evaluate(_predictions(spark, d), ["lang"])
    return out.select("lang", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("lang", "tp", "tn", "fp", "fn")])


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.best_threshold(_predictions(spark, d), ["lang"])
    return out.select("lang", F.round("threshold", 9).alias("threshold"), F.round("train_ba", 6).alias("train_ba"))


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread over languages of their metrics by parity of the id, best first."""
    p = _predictions(spark, d).withColumn("half", F.col("row_id") % 2)
    raw = metrics.losses(p, ["lang", "half"]).join(metrics.area_under_roc(p, ["lang", "half"]), ["lang", "half"])
    out = metrics.leaderboard(metrics.summarize(raw, ["half"], ["brier", "auc"]), ["auc_mean"], 20)
    return out.select("half", "runs", *[F.round(c, 6).alias(c) for c in ("brier_mean", "brier_std", "auc_mean", "auc_std")])


def posterior_scores(spark: SparkSession, d: str) -> DataFrame:
    s = bayes.score_gaussian(_features(spark, d), SEVEN, B, COV)
    return s.select("vec_id", *[F.round(c, 6).alias(c) for c in ("p", "p_std", "ci_lo", "ci_hi", "entropy")])


def posterior_draws(spark: SparkSession, d: str) -> DataFrame:
    fit = bayes.Fit(B, COV, 0, True)
    return bayes.score_draws(_features(spark, d).select("vec_id", *SEVEN), SEVEN, bayes.draws(fit, 1000, 3)).select("vec_id", "p", "p_std", "ci_lo", "ci_hi", "entropy")


def bayes_fit(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of one fit of all features over all rows, with intervals and the probability of their sign."""
    f = _features(spark, d, 64)
    w = prep.class_weights(f, [], "y").withColumnRenamed("weight", "w")
    rows = f.join(F.broadcast(w), "y").select(F.lit("all").alias("key"), F.array(*ALL).alias("x"), "y", "w")  # w: a row a class
    return bayes.coefficient_summary(spark, ALL, bayes.fit_logistic(rows, 64, ["all"])["all"])


def _limits(df: DataFrame) -> DataFrame:
    return stats.hazen_percentiles(features.to_long(df, [], SEVEN), ["feature"], "value", {"low": 0.01, "high": 0.99})


def sweep_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Preserving ranges of every record and feature."""
    f = _features(spark, d).select("vec_id", *SEVEN)
    swept = attribution.sweep(f, "vec_id", SEVEN, B, COV, _limits(f))
    out = attribution.preserving_ranges(swept, "vec_id")
    return out.select("vec_id", "feature", "points", *[F.round(c, 6).alias(c) for c in ("min_z", "max_z", "width")])


def sweep_surface(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).select("vec_id", *SEVEN)
    swept = attribution.sweep(f, "vec_id", SEVEN, B, COV, _limits(f))
    out = attribution.surface(swept, "p", list(range(101)))
    return out.select("feature", *[F.round(f"i{i}", 6).alias(f"i{i}") for i in range(101)])


def sweep_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """Means over all records of the posterior deviation and interval of p, and of the contributions, at each grid point of each feature."""
    f = _features(spark, d).select("vec_id", *SEVEN)
    swept = attribution.sweep(f, "vec_id", SEVEN, B, COV, _limits(f))
    return swept.groupBy("feature", "index").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in SWEPT])


def repeat_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread over three repeats of the means over four folds, dealt by the id."""
    p = _predictions(spark, d).withColumns({"seed": (F.col("row_id") % 3).cast("int"), "fold": (F.floor(F.col("row_id") / 3) % 4).cast("int")})
    out = validation.fold_then_repeat(p, ["brier", "auc"])
    return out.select("runs", *[F.round(c, 6).alias(c) for c in ("brier_mean", "brier_std", "auc_mean", "auc_std")])


def uncertainty_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the posterior deviation, the entropy and the width of the interval by label parity, for all records and those of each class."""
    scored = bayes.score_gaussian(_features(spark, d), SEVEN, B, COV).withColumn("parity", F.col("label") % 2)
    out = metrics.uncertainty(scored, ["parity"])
    return out.select("parity", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("parity", "n")])


def range_summary(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).select("vec_id", *SEVEN)
    swept = attribution.sweep(f, "vec_id", SEVEN, B, COV, _limits(f))
    out = attribution.ranges_by_feature(attribution.preserving_ranges(swept, "vec_id"))
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("width_mean", "width_std", "width_med", "width_abs")])


def case_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Contributions of the features to the representative cases, over a table of draws that the model's parameters give."""
    f = bayes.score_gaussian(_features(spark, d), SEVEN, B, COV)
    f = f.withColumns({c: F.round(c, 6) for c in ("p", "p_std")})
    cases = attribution.representative_cases(f, "vec_id").withColumnRenamed("row", "vec_id")
    shift = F.array(*[F.lit(float(x)) for x in np.sqrt(np.diag(COV))])
    sample = spark.range(9).select("id", *[(F.lit(float(B[i])) + (F.col("id") - 4) / 2.0 * shift[i]).alias(f"b{i}") for i in range(8)])
    out = attribution.contributions(f.join(cases, "vec_id").select("vec_id", "kind", *SEVEN), "vec_id", SEVEN, sample).join(cases, "vec_id")
    return out.select("vec_id", "kind", "feature", *[F.round(c, 6).alias(c) for c in ("logit_mean", "logit_std", "logit_lo", "logit_hi", "logit_positive", "prob_mean", "prob_std", "prob_lo", "prob_hi", "prob_abs_mean", "prob_abs_std")])


def attribution_spread(spark: SparkSession, d: str) -> DataFrame:
    out = attribution.attribution_uncertainty(_features(spark, d), SEVEN, B, COV)
    return out.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("attr_unc"), 6).alias("attr_unc"))


def feature_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the 64 feature names, and the number functions over the first features."""
    f = _features(spark, d)
    name = F.concat(F.element_at(F.array(F.lit("ch1_theta_rel_"), F.lit("ch2_theta_alpha_ratio_"), F.lit("x_corr_"), F.lit("y_sef95_"), F.lit("other_")), (F.col("vec_id") % 5 + 1).cast("int")), F.lit("mean"))
    return f.select("vec_id", rules.feature_group(name).alias("grp"), F.round(rules.signed_log(F.col("f0")), 6).alias("slog"), F.round(rules.sigmoid(F.col("f1") * 10), 6).alias("sig"), F.round(rules.entropy(F.abs("f2")), 6).alias("ent"), F.round(rules.min_max(F.col("f3"), F.lit(-1.0), F.lit(1.0)), 6).alias("mm"), rules.direction(F.col("f4") + 0.5).alias("dir"))


def validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Pooled metrics of each repeat of the validation job."""
    p, _ = validation.validate(_features(spark, d, 64).select("vec_id", "subject", "y", *ALL), "vec_id", "subject", ALL, validation.Design(seeds=SEEDS, k=K, top_k=5))
    return validation.pooled_metrics(p)


#: Names of the 64 features in the grid: a third each is transformed by atanh, by log and not at all.
NAMED = [("f{}", "ch1_theta_rel_f{}", "ch1_ch2_corr_mean_f{}")[i % 3].format(i) for i in range(64)]


def validation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Pooled metrics of 54 configurations for each of two tasks: 3 transforms by all, 8 numbers of best features by 2 ranks, and a fixed set, in five folds."""
    f = _features(spark, d, 64).withColumnsRenamed(dict(zip(ALL, NAMED, strict=True))).withColumn("kind", F.col("label").cast("string"))
    rest = [str(i) for i in range(1, 10)]
    tasks = [("one_vs_rest", "kind", rest, ["0"]), ("halves", "kind", rest[:4], rest[4:])]
    designs = validation.grid_designs(["zscore", "names", "winsor_names"], [None, 3, 5, 7, 8, 10, 15, 20, 30], [5], (42,), ranks=("effect", "auc"), fixed=tuple(NAMED[:7]))
    found = validation.run_grid(f.drop("y"), "vec_id", "subject", NAMED, tasks, designs, new_folder(spark, "grid"), least=5)
    return validation.grid_metrics(found)


def benchmark_runs(spark: SparkSession, d: str) -> DataFrame:
    """One repeat of the benchmark: 4 preprocessings by 6 feature sets by 5 models in five folds."""
    f = _features(spark, d, 64).select("vec_id", "subject", "y", *ALL)
    return benchmark.benchmark(f, "vec_id", "subject", ALL, ["zscore", "winsor", "log", "winsor_log"], [None, 5, 7, 10, 15, 20], list(benchmark.MODELS), seeds=(42,), k=5, trees=20)


def subset_search(spark: SparkSession, d: str) -> DataFrame:
    """Two generations of each phase of the search over all features, as their log."""
    f = _features(spark, d, 64).select("vec_id", "subject", "y", *ALL)
    e = ranking.guide_scores(ranking.effect_sizes(ranking.class_moments(features.to_long(f, ["y"], ALL), [])), [])
    modes = ("decline", "maintain", "balanced")
    scores = e.select("feature", *[f"{m}_score" for m in modes]).collect()  # three numbers a feature
    guide = {m: {r["feature"]: r[f"{m}_score"] for r in scores} for m in modes}
    s = search.Settings(generations=2, children=2)
    return search.generation_log(search.search(f, "vec_id", "subject", ALL, guide, s, validation.Design(seeds=(42,), k=K)))


def signature_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients and attributions of seven features over the folds of two repeats."""
    f = _features(spark, d).select("vec_id", "subject", "y", *SEVEN)
    return signature.roll_up(signature.fold_coefficients(f, "vec_id", "subject", SEVEN, validation.Design(seeds=SEEDS, k=K)))


def _individuals(spark: SparkSession, d: str) -> DataFrame:
    """Parts as individuals of a search: the type is the subset, the brand the phase."""
    p = tables.read(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("individual"), F.col("p_brand").alias("phase"), F.col("p_size").alias("generation"), F.replace("p_type", F.lit(" "), F.lit(",")).alias("features"),
        F.round("p_retailprice", 0).alias("fitness"), (F.col("p_size") / 50.0).alias("balanced_accuracy"), (F.col("p_partkey") % 7 / 7.0).alias("auc"), F.col("p_size").alias("n_features"),
    )


def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    return search.rank_candidates(_individuals(spark, d), 20).select("individual", "features", "fitness", "n_features")


def search_log(spark: SparkSession, d: str) -> DataFrame:
    out = search.generation_log(_individuals(spark, d))
    return out.select("phase", "generation", "best", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "best_features", "best_n_features", *[F.round(c, 6).alias(c) for c in ("best_balanced_accuracy", "best_auc")])


def elite_features(spark: SparkSession, d: str) -> DataFrame:
    return search.elite_frequency(_individuals(spark, d), 5).withColumn("share", F.round("share", 6))


def kind_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of the second family: logs by the name of the feature, then winsor limits."""
    rows = _folded(spark, d, 64).withColumn("feature", F.concat(F.lit("ch1_theta_rel_"), "feature")).withColumn("value", F.abs("value"))
    p = prep.fold_parameters(rows, K, winsor=True, kinds=True)
    return p.select("seed", "train", "feature", *[F.round(c, 6).alias(c) for c in ("med", "least", "low", "high", "mean", "sd")])


_F = "f AS (SELECT vec_id, CAST(label = 0 AS INT) AS y, vec_id // 3 AS subject, embedding FROM embeddings WHERE embedding IS NOT NULL)"
_LONG = "{} AS (SELECT vec_id, subject, y, 'f' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS value FROM f, range(0, {}) t(i))"
_FOLDS = f"""subjects AS (SELECT subject, max(y) AS positive FROM f GROUP BY subject),
folds AS (SELECT seed, subject, CAST((row_number() OVER (PARTITION BY seed, positive ORDER BY md5(seed || '|' || subject), subject) - 1) % {K} + 1 AS INT) AS fold, positive FROM subjects, (VALUES (42), (43)) s(seed))"""
_TRAIN = f"train_rows AS (SELECT seed, train, feature, y, value FROM long JOIN folds USING (subject), range(1, {K + 1}) k(train) WHERE train <> fold)"


def _hz(a: str, p: float) -> str:
    r = f"least(greatest(len({a}) * {p} + 0.5, 1), len({a}))"
    k = f"CAST(floor({r}) AS BIGINT)"
    return f"({a}[{k}] + ({a}[least({k} + 1, len({a}))] - {a}[{k}]) * ({r} - floor({r})))"


def _sig(z: str) -> str:
    return f"(1 / (1 + exp(-least(greatest({z}, -40), 40))))"


_X = ["1.0", *[f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(7)]]
_MU = " + ".join(f"{x} * ({float(b)!r})" for x, b in zip(_X, B, strict=True))
_V = " + ".join(f"{_X[i]} * {_X[j]} * ({float(COV[i, j])!r})" for i in range(8) for j in range(8))
_P = " + ".join(f"({float(w)!r}) * {_sig(f'(mu + s * ({float(x)!r}))')}" for x, w in zip(bayes.NODES, bayes.WEIGHTS, strict=True))
_P2 = " + ".join(f"({float(w)!r}) * power({_sig(f'(mu + s * ({float(x)!r}))')}, 2)" for x, w in zip(bayes.NODES, bayes.WEIGHTS, strict=True))
_BENT = [(float(x), float(w), _sig(f"(mu + s * ({float(x)!r}))")) for x, w in zip(bayes.NODES, bayes.WEIGHTS, strict=True)]
_FIRST = " + ".join(f"({w!r}) * {q} * (1 - {q}) * (bj + share * ({x!r}))" for x, w, q in _BENT)
_SQUARE = " + ".join(f"({w!r}) * power({q} * (1 - {q}), 2) * (power(bj + share * ({x!r}), 2) + greatest(cjj - share * share, 0))" for x, w, q in _BENT)
_MOMENTS = "moments AS (SELECT {k} feature, count(value) FILTER (y = 0) AS n0, count(value) FILTER (y = 1) AS n1, avg(value) FILTER (y = 0) AS m0, avg(value) FILTER (y = 1) AS m1, var_samp(value) FILTER (y = 0) AS v0, var_samp(value) FILTER (y = 1) AS v1 FROM {t} GROUP BY ALL)"
_PRED = "p AS (SELECT doc_id AS row_id, lang, n_chars / (n_chars + 1000.0) AS p, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"
_AUC = "SELECT {k}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END AS auc FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY p) + (count(*) OVER (PARTITION BY {k}, p) - 1) / 2.0 AS r FROM p) GROUP BY {k}"
_TOP = "top AS (SELECT seed, train, feature FROM (SELECT *, row_number() OVER (PARTITION BY seed, train ORDER BY round(abs(m1 - m0) / sqrt(0.5 * (v0 + v1) + 1e-8), 9) DESC, feature) AS r FROM moments) WHERE r <= 5)"


def _sweep_sql(points: int, tail: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT vec_id, 'f{j - 1}' AS feature, {_X[j]} AS x, ({float(B[j])!r}) AS bj, {' + '.join(f'{_X[i]} * ({float(COV[i, j])!r})' for i in range(8))} AS cx, ({float(COV[j, j])!r}) AS cjj, {_MU} AS mu0, {_V} AS v0 FROM f" for j in range(1, 8)
    )
    z = "(CASE WHEN mu0 >= 0 THEN mu / s ELSE -mu / s END)"
    return f"""WITH {_F}, rows_ AS ({each}),
limits AS (SELECT feature, {_hz("a", 0.01)} AS low, {_hz("a", 0.99)} AS high FROM (SELECT feature, list(x ORDER BY x) AS a FROM rows_ GROUP BY feature)),
grid AS (SELECT r.*, i AS index, i * {5.0 / (points - 1)!r} - 2.5 AS off FROM rows_ r, range(0, {points}) g(i)),
spot AS (SELECT g.*, x + off AS z, mu0 + bj * off AS mu, sqrt(greatest(v0 + 2 * off * cx + off * off * cjj, 0)) AS s FROM grid g JOIN limits USING (feature) WHERE x + off >= low AND x + off <= high),
swept AS (SELECT *, (mu0 >= 0) = (mu >= 0) AND {stats.normal_cdf_sql(z)} >= 0.8 AS ok, {_P} AS p FROM spot),
ranges AS (SELECT vec_id, feature, count(*) FILTER (ok) AS points, min(z) FILTER (ok) AS min_z, max(z) FILTER (ok) AS max_z, coalesce(max(z) FILTER (ok) - min(z) FILTER (ok), 0) AS width FROM swept GROUP BY ALL) {tail}"""


_NODES = "nodes(xi, w) AS (VALUES " + ", ".join(f"({float(x)!r}, {float(w)!r})" for x, w in zip(bayes.NODES, bayes.WEIGHTS, strict=True)) + ")"
_SCORED = f"""z AS (SELECT vec_id, y, embedding, {_MU} AS mu, sqrt(greatest({_V}, 1e-18)) AS s FROM f),
at_ AS (SELECT z.*, xi, w, {_sig("(mu + s * xi)")} AS q FROM z, nodes)"""
_C = {j: "((" + " + ".join(f"{_X[i]} * ({float(COV[i, j])!r})" for i in range(8)) + ") / s)" for j in range(1, 8)}
_SPREAD = f"""WITH {_F}, {_NODES}, {_SCORED},
m AS (SELECT vec_id, y, any_value(embedding) AS embedding, {", ".join(f"sum(w * q * (1 - q) * ({float(B[j])!r} + {_C[j]} * xi)) AS a{j}, sum(w * power(q * (1 - q), 2) * (power({float(B[j])!r} + {_C[j]} * xi, 2) + greatest({float(COV[j, j])!r} - {_C[j]} * {_C[j]}, 0))) AS b{j}" for j in range(1, 8))} FROM at_ GROUP BY vec_id, y)
SELECT y, count(*) AS n, round(avg(({" + ".join(f"abs({_X[j]}) * sqrt(greatest(b{j} - a{j} * a{j}, 0))" for j in range(1, 8))}) / 7), 6) AS attr_unc FROM m GROUP BY y"""
_DRAWS = ", ".join(f"{float(B[i])!r} + (id - 4) / 2.0 * ({float(np.sqrt(COV[i, i]))!r}) AS b{i}" for i in range(8))
_CASES = f"""WITH {_F}, {_NODES}, {_SCORED},
p AS (SELECT vec_id, any_value(y) AS y, any_value(embedding) AS embedding, round(sum(w * q), 6) AS p, round(sqrt(greatest(sum(w * q * q) - power(sum(w * q), 2), 0)), 6) AS sd FROM at_ GROUP BY vec_id),
picks AS (SELECT 0 AS i, 'confident_0' AS kind, coalesce(first(vec_id ORDER BY p, vec_id) FILTER (y = 0 AND p < 0.5), first(vec_id ORDER BY p, vec_id)) AS vec_id FROM p UNION ALL
  SELECT 1, 'confident_1', coalesce(first(vec_id ORDER BY p DESC, vec_id) FILTER (y = 1 AND p >= 0.5), first(vec_id ORDER BY p DESC, vec_id)) FROM p UNION ALL
  SELECT 2, 'boundary', first(vec_id ORDER BY abs(p - 0.5), vec_id) FROM p UNION ALL SELECT 3, 'uncertain', first(vec_id ORDER BY sd DESC, vec_id) FROM p),
cases AS (SELECT vec_id, first(kind ORDER BY i) AS kind FROM picks GROUP BY vec_id),
draws AS (SELECT {_DRAWS} FROM range(0, 9) t(id)),
g AS (SELECT vec_id, kind, embedding, draws.*, {_sig("(" + " + ".join(f"{_X[i]} * b{i}" for i in range(8)) + ")")} AS q FROM cases JOIN p USING (vec_id), draws),
long AS ({" UNION ALL ".join(f"SELECT vec_id, kind, 'f{j - 1}' AS feature, {_X[j]} * b{j} AS l, q FROM g" for j in range(1, 8))})
SELECT vec_id, kind, feature, round(avg(l), 6) AS logit_mean, round(stddev_samp(l), 6) AS logit_std, round({_hz("list_sort(list(l))", 0.025)}, 6) AS logit_lo, round({_hz("list_sort(list(l))", 0.975)}, 6) AS logit_hi, round(avg(CASE WHEN l > 0 THEN 1.0 ELSE 0.0 END), 6) AS logit_positive,
  round(avg(l * q * (1 - q)), 6) AS prob_mean, round(stddev_samp(l * q * (1 - q)), 6) AS prob_std, round({_hz("list_sort(list(l * q * (1 - q)))", 0.025)}, 6) AS prob_lo, round({_hz("list_sort(list(l * q * (1 - q)))", 0.975)}, 6) AS prob_hi,
  round(avg(abs(l * q * (1 - q))), 6) AS prob_abs_mean, round(stddev_samp(abs(l * q * (1 - q))), 6) AS prob_abs_std FROM long GROUP BY vec_id, kind, feature"""
_EVAL = f"""WITH {_PRED}, q AS (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS c FROM p),
counts AS (SELECT lang, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y <> 1 AND p < 0.5) AS tn, count(*) FILTER (y <> 1 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, avg((p - y) * (p - y)) AS brier, avg(-CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END) AS nll FROM q GROUP BY lang),
rates AS (SELECT *, (tp + tn) / nullif(tp + tn + fp + fn, 0) AS accuracy, tp / nullif(tp + fn, 0) AS recall1, tn / nullif(tn + fp, 0) AS recall0, tp / nullif(tp + fp, 0) AS precision1, tn / nullif(tn + fn, 0) AS precision0 FROM counts),
bins AS (SELECT lang, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM p GROUP BY ALL),
eces AS (SELECT lang, sum(n * abs(mp - my)) / sum(n) AS ece FROM bins GROUP BY lang),
aucs AS ({_AUC.format(k="lang")}),
ordered AS (SELECT lang, y, sum(y) OVER w AS tp, count(*) OVER w AS n, sum(y) OVER (PARTITION BY lang) AS pos FROM p WINDOW w AS (PARTITION BY lang ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING)),
prs AS (SELECT lang, sum((tp / n + CASE WHEN n > 1 THEN (tp - 1) / (n - 1) ELSE 1 END) / 2) / max(pos) AS auprc FROM ordered WHERE y = 1 GROUP BY lang)
SELECT lang, tp, tn, fp, fn, {", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "recall1", "recall0", "precision1", "precision0", "brier", "nll", "ece", "auc", "auprc"))}, round((recall0 + recall1) / 2, 6) AS balanced_accuracy,
  round((coalesce(2 * recall0 * precision0 / nullif(recall0 + precision0, 0), 0) + coalesce(2 * recall1 * precision1 / nullif(recall1 + precision1, 0), 0)) / 2, 6) AS macro_f1, round(recall0, 6) AS specificity
FROM rates LEFT JOIN eces USING (lang) LEFT JOIN aucs USING (lang) LEFT JOIN prs USING (lang)"""

SQL = {
    "subject_folds": f"WITH {_F}, {_FOLDS} SELECT seed, subject, fold, positive FROM folds",
    "record_folds": f"WITH {_F} SELECT vec_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || vec_id), vec_id) - 1) % {K} + 1 AS INT) AS fold FROM f",
    "valid_seeds": f"""WITH {_F}, {_FOLDS.replace("(VALUES (42), (43)) s(seed)", "range(1, 6) s(seed)")},
per AS (SELECT seed, fold, sum(y) AS pos, count(*) AS n FROM f JOIN folds USING (subject) GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY seed) AS ap, sum(n) OVER (PARTITION BY seed) AS an FROM per)
SELECT CAST(seed AS INT) AS seed FROM w GROUP BY seed HAVING bool_and(pos > 0 AND pos < n AND ap > pos AND an - ap > n - pos) AND count(*) = {K}""",
    "class_subjects": f"WITH {_F}, s AS (SELECT subject, max(CAST(y = 0 AS INT)) AS a, max(CAST(y = 1 AS INT)) AS b FROM f GROUP BY subject) SELECT CAST(sum(a) AS BIGINT) AS n_class0, CAST(sum(b) AS BIGINT) AS n_class1, CAST(sum(a * b) AS BIGINT) AS n_mixed FROM s",
    "fold_parameters": f"""WITH {_F}, {_LONG.format("long", 64)}, {_FOLDS}, {_TRAIN},
g AS (SELECT seed, train, feature, median(value) AS med, min(value) AS least, list(value ORDER BY value) AS a FROM train_rows GROUP BY ALL),
lim AS (SELECT *, {_hz("a", 0.01)} AS low, {_hz("a", 0.99)} AS high FROM g),
x AS (SELECT t.seed, t.train, t.feature, greatest(least(value, high), low) AS v FROM train_rows t JOIN lim l ON l.seed = t.seed AND l.train = t.train AND l.feature = t.feature),
m AS (SELECT seed, train, feature, avg(sign(v) * ln(1 + abs(v))) AS mean, stddev_samp(sign(v) * ln(1 + abs(v))) AS sd FROM x GROUP BY ALL)
SELECT seed, CAST(train AS INT) AS train, feature, round(med, 6) AS med, round(least, 6) AS least, round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean, round(CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS sd FROM lim JOIN m USING (seed, train, feature)""",
    "scaled_features": f"""WITH {_F}, {_LONG.format("long", 64)}, {_FOLDS}, {_TRAIN},
m AS (SELECT seed, train, feature, avg(value) AS mean, stddev_samp(value) AS sd FROM train_rows GROUP BY ALL)
SELECT seed, CAST(train AS INT) AS train, feature, fold = train AS held_out, count(*) AS n, round(avg((value - mean) / sd) + 1, 6) AS mean1, round(max((value - mean) / sd), 6) AS max
FROM long JOIN folds USING (subject) JOIN m USING (seed, feature) GROUP BY ALL""",
    "class_weights": f"""WITH {_F}, {_LONG.format("long", 1)}, {_FOLDS}, {_TRAIN}, c AS (SELECT seed, train, y, count(*) AS n FROM train_rows GROUP BY ALL)
SELECT seed, CAST(train AS INT) AS train, y, round(sum(n) OVER (PARTITION BY seed, train) / (2.0 * n), 6) AS weight FROM c""",
    "effect_sizes": f"""WITH {_F}, {_LONG.format("long", 64)}, {_MOMENTS.format(k="", t="long")},
e AS (SELECT feature, (m1 - m0) / sqrt(0.5 * (v0 + v1) + 1e-8) AS s, (m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS d FROM moments),
n AS (SELECT *, (abs(s) - min(abs(s)) OVER ()) / (max(abs(s)) OVER () - min(abs(s)) OVER ()) AS base FROM e),
c AS (SELECT {_hz("a", 0.65)} AS cut FROM (SELECT list(base ORDER BY base) AS a FROM n)),
b AS (SELECT *, CASE WHEN base >= cut THEN base ELSE 0.25 * base END AS d_ FROM n, c)
SELECT feature, round(abs(s), 6) AS effect, round(s, 6) AS signed_effect, round(d, 6) AS cohens_d, round(base, 6) AS base, round(d_ * CASE WHEN s >= 0 THEN 1 ELSE 0.65 END, 6) AS decline_score, round(d_ * CASE WHEN s <= 0 THEN 1 ELSE 0.65 END, 6) AS maintain_score, round(d_, 6) AS balanced_score FROM b""",
    "auc_ranking": f"""WITH {_F}, {_LONG.format("long", 64)}, p AS (SELECT feature, y, value AS p FROM long), a AS ({_AUC.format(k="feature")}) SELECT feature, round(abs(auc - 0.5), 6) AS auc_distance FROM a""",
    "fold_top_features": f"WITH {_F}, {_LONG.format('long', 64)}, {_FOLDS}, {_TRAIN}, {_MOMENTS.format(k='seed, train,', t='train_rows')}, {_TOP} SELECT seed, CAST(train AS INT) AS train, string_agg(feature, ',' ORDER BY feature) AS features FROM top GROUP BY ALL",
    "selection_stability": f"""WITH {_F}, {_LONG.format("long", 64)}, {_FOLDS}, {_TRAIN}, {_MOMENTS.format(k="seed, train,", t="train_rows")}, {_TOP}
SELECT seed, feature, count(top.train) AS times, round(count(top.train) / {K}.0, 6) AS stability FROM (SELECT DISTINCT seed FROM folds) s CROSS JOIN (SELECT 'f' || i AS feature FROM range(0, 64) t(i)) n LEFT JOIN top USING (seed, feature) GROUP BY ALL""",
    "redundancy": f"WITH {_F}, v AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM f, range(0, 64) t(i)) SELECT round(avg(r), 6) AS redundancy FROM (SELECT abs(corr(a.x, b.x)) AS r FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i)",
    "imputed": f"WITH {_F}, x AS (SELECT vec_id, {', '.join(f'CASE WHEN embedding[{i + 1}]::DOUBLE <= 0.2 THEN embedding[{i + 1}]::DOUBLE END AS f{i}' for i in range(64))} FROM f), m AS (SELECT {', '.join(f'coalesce(median(f{i}), 0) AS m{i}' for i in range(64))} FROM x) SELECT vec_id, {', '.join(f'round(coalesce(f{i}, m{i}), 6) AS f{i}' for i in range(64))} FROM x, m",
    "task_rows": """SELECT task, y, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM (
SELECT 'a' AS task, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 END AS y, c_acctbal FROM customer UNION ALL
SELECT 'b', CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 0 WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 1 END, c_acctbal FROM customer) WHERE y IS NOT NULL GROUP BY ALL""",
    "evaluation": _EVAL,
    "attribution_spread": _SPREAD,
    "case_contributions": _CASES,
    "thresholds": f"""WITH {_PRED}, grid AS (SELECT unnest([0.05, 0.1, 0.9, 0.95] || list_transform(range(15, 86), lambda i: i / 100.0)) AS t),
cand AS (SELECT DISTINCT lang, p AS t FROM p UNION SELECT lang, t FROM (SELECT DISTINCT lang FROM p), grid),
s AS (SELECT lang, t, (count(*) FILTER (y = 1 AND p >= t) / nullif(count(*) FILTER (y = 1), 0) + count(*) FILTER (y = 0 AND p < t) / nullif(count(*) FILTER (y = 0), 0)) / 2.0 AS ba FROM cand JOIN p USING (lang) GROUP BY ALL)
SELECT lang, round(first(t ORDER BY round(ba, 12) DESC, t), 9) AS threshold, round(max(ba), 6) AS train_ba FROM s GROUP BY lang""",
    "metric_summary": f"""WITH {_PRED.replace("AS row_id, lang", "AS row_id, lang || '|' || doc_id % 2 AS lang")}, aucs AS ({_AUC.format(k="lang")}), b AS (SELECT lang, avg((p - y) * (p - y)) AS brier FROM p GROUP BY lang)
SELECT CAST(split_part(lang, '|', 2) AS BIGINT) AS half, count(*) AS runs, round(avg(brier), 6) AS brier_mean, round(stddev_samp(brier), 6) AS brier_std, round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_std FROM b JOIN aucs USING (lang) GROUP BY 1""",
    "posterior_scores": f"""WITH {_F}, z AS (SELECT vec_id, {_MU} AS mu, sqrt(greatest({_V}, 0)) AS s FROM f), m AS (SELECT *, {_P} AS p, {_P2} AS p2 FROM z)
SELECT vec_id, round(p, 6) AS p, round(sqrt(greatest(p2 - p * p, 0)), 6) AS p_std, round({_sig("(mu - 1.959963984540054 * s)")}, 6) AS ci_lo, round({_sig("(mu + 1.959963984540054 * s)")}, 6) AS ci_hi, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS entropy FROM m""",
    "sweep_ranges": _sweep_sql(101, "SELECT vec_id, feature, points, round(min_z, 6) AS min_z, round(max_z, 6) AS max_z, round(width, 6) AS width FROM ranges"),
    "sweep_surface": _sweep_sql(101, f"SELECT feature, {', '.join(f'round(avg(p) FILTER (index = {i}), 6) AS i{i}' for i in range(101))} FROM swept GROUP BY feature"),
    "sweep_uncertainty": _sweep_sql(101, f"""SELECT feature, index, count(*) AS n, round(avg(sqrt(greatest(p2 - p * p, 0))), 6) AS p_std, round(avg({_sig("(mu - 1.959963984540054 * s)")}), 6) AS ci_lo, round(avg({_sig("(mu + 1.959963984540054 * s)")}), 6) AS ci_hi,
  round(avg(bj * z), 6) AS logit, round(avg(abs(z) * sqrt(cjj)), 6) AS logit_std, round(avg(z * a), 6) AS prob, round(avg(abs(z) * sqrt(greatest(b - a * a, 0))), 6) AS prob_std
FROM (SELECT *, {_P2} AS p2, {_FIRST} AS a, {_SQUARE} AS b FROM (SELECT *, (cx + off * cjj) / s AS share FROM swept)) GROUP BY feature, index"""),
    "repeat_metrics": f"""WITH {_PRED.replace("AS row_id, lang", "AS row_id, doc_id % 3 AS seed, doc_id // 3 % 4 AS fold")}, aucs AS ({_AUC.format(k="seed, fold")}), b AS (SELECT seed, fold, avg((p - y) * (p - y)) AS brier FROM p GROUP BY seed, fold),
r AS (SELECT seed, avg(brier) AS brier, avg(auc) AS auc FROM b JOIN aucs USING (seed, fold) GROUP BY seed)
SELECT count(*) AS runs, round(avg(brier), 6) AS brier_mean, round(stddev_samp(brier), 6) AS brier_std, round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_std FROM r""",
    "uncertainty_means": f"""WITH {_F.replace("CAST(label = 0", "label, CAST(label = 0")}, z AS (SELECT label % 2 AS parity, y, {_MU} AS mu, sqrt(greatest({_V}, 0)) AS s FROM f), m AS (SELECT *, {_P} AS p, {_P2} AS p2 FROM z),
u AS (SELECT parity, y, sqrt(greatest(p2 - p * p, 0)) AS p_std, -(p * ln(p) + (1 - p) * ln(1 - p)) AS entropy, {_sig("(mu + 1.959963984540054 * s)")} - {_sig("(mu - 1.959963984540054 * s)")} AS ci_width FROM m)
SELECT parity, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS {c}_mean, round(avg({c}) FILTER (y = 0), 6) AS {c}_mean0, round(avg({c}) FILTER (y = 1), 6) AS {c}_mean1" for c in ("p_std", "entropy", "ci_width"))} FROM u GROUP BY parity""",
    "range_summary": _sweep_sql(101, "SELECT feature, round(avg(width), 6) AS width_mean, round(stddev_samp(width), 6) AS width_std, round(median(width), 6) AS width_med, round(avg(abs(width)), 6) AS width_abs FROM ranges GROUP BY feature"),
    "candidate_ranking": """WITH b AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY round(p_retailprice, 0) DESC, p_size DESC, p_partkey % 7 DESC, p_size, p_partkey) AS r FROM part)
SELECT p_partkey AS individual, replace(p_type, ' ', ',') AS features, round(p_retailprice, 0) AS fitness, p_size AS n_features FROM b WHERE r = 1 ORDER BY round(p_retailprice, 0) DESC, p_size DESC, p_partkey % 7 DESC, p_partkey LIMIT 20""",
    "search_log": """SELECT p_brand AS phase, p_size AS generation, max(round(p_retailprice, 0)) AS best, round(avg(round(p_retailprice, 0)), 6) AS mean, round(stddev_samp(round(p_retailprice, 0)), 6) AS std,
  replace(first(p_type ORDER BY round(p_retailprice, 0) DESC, p_partkey DESC), ' ', ',') AS best_features, first(p_size ORDER BY round(p_retailprice, 0) DESC, p_partkey DESC) AS best_n_features,
  round(first(p_size / 50.0 ORDER BY round(p_retailprice, 0) DESC, p_partkey DESC), 6) AS best_balanced_accuracy, round(first(p_partkey % 7 / 7.0 ORDER BY round(p_retailprice, 0) DESC, p_partkey DESC), 6) AS best_auc FROM part GROUP BY ALL""",
    "elite_features": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice, 0) DESC, p_size, p_partkey) AS r FROM part),
w AS (SELECT p_brand, unnest(string_split(p_type, ' ')) AS feature FROM t WHERE r <= 5) SELECT p_brand AS phase, feature, round(count(*) / 5.0, 6) AS share FROM w GROUP BY ALL""",
    "kind_parameters": f"""WITH {_F}, {_LONG.format("long", 64).replace("CAST(embedding[i + 1] AS DOUBLE)", "abs(CAST(embedding[i + 1] AS DOUBLE))").replace("'f' || i", "'ch1_theta_rel_f' || i")}, {_FOLDS}, {_TRAIN},
g AS (SELECT seed, train, feature, median(value) AS med, min(value) AS least, list(ln(value + 2.220446049250313e-16) ORDER BY value) AS a FROM train_rows GROUP BY ALL),
lim AS (SELECT *, {_hz("a", 0.01)} AS low, {_hz("a", 0.99)} AS high FROM g),
x AS (SELECT seed, train, feature, greatest(least(ln(value + 2.220446049250313e-16), high), low) AS v FROM train_rows t JOIN lim l USING (seed, train, feature)),
m AS (SELECT seed, train, feature, avg(v) AS mean, stddev_samp(v) AS sd FROM x GROUP BY ALL)
SELECT seed, CAST(train AS INT) AS train, feature, round(med, 6) AS med, round(least, 6) AS least, round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean, round(CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS sd FROM lim JOIN m USING (seed, train, feature)""",
    "feature_groups": f"""WITH {_F} SELECT vec_id, ['Theta', 'ThetaAlphaRatio', 'Connectivity', 'SEF', 'Other'][vec_id % 5 + 1] AS grp, round(sign({_X[1]}) * ln(1 + abs({_X[1]})), 6) AS slog, round({_sig(f"({_X[2]} * 10)")}, 6) AS sig,
  round(-(e * ln(e) + (1 - e) * ln(1 - e)), 6) AS ent, round(({_X[4]} + 1) / 2, 6) AS mm, CASE WHEN {_X[5]} + 0.5 >= 0.975 THEN 'Positive' WHEN {_X[5]} + 0.5 <= 0.025 THEN 'Negative' ELSE 'Uncertain' END AS dir FROM (SELECT *, least(greatest(abs({_X[3]}), 1e-12), 1 - 1e-12) AS e FROM f)""",
}
QUERIES = {
    f.__name__: f
    for f in (
        subject_folds, record_folds, valid_seeds, class_subjects, fold_parameters, scaled_features, class_weights, effect_sizes, auc_ranking, fold_top_features,
        selection_stability, redundancy, imputed, task_rows, evaluation, thresholds, metric_summary, posterior_scores, posterior_draws, bayes_fit, sweep_ranges,
        sweep_surface, sweep_uncertainty, repeat_metrics, uncertainty_means, range_summary, case_contributions, attribution_spread, feature_groups, validation_metrics, validation_grid, benchmark_runs, subset_search,
        signature_analysis, candidate_ranking, search_log, elite_features, kind_parameters,
    )
}
