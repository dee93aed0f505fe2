"""Segments of the events of each user, and spectra of the embeddings taken as signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import segments as S
from ..operators import signal, trajectory
from ..plans import extraction
from ..sources import tables
from ..sources.shared import new_folder

LENGTH, HOP, CAP, SEED = 20, 10, 3, 11
NAMES = ["mean", "std", "rms", "range", "mean_jump"]


def _segments(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select("user_id", "ts", "event_id", "value")
    x = S.robust_scale(e, "user_id", "value")
    return S.describe_segments(S.cut_segments(x, "user_id", ["ts", "event_id"], LENGTH, HOP), "user_id", limit=7.99)


def segment_features(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).withColumns({c: F.round(c, 6) for c in NAMES})


def segment_rollup(spark: SparkSession, d: str) -> DataFrame:
    good = S.cap_segments(_segments(spark, d).filter("NOT bad"), "user_id", CAP, SEED)
    out = S.roll_up(good, "user_id", NAMES)
    return out.select("user_id", "num_segments", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("user_id", "num_segments")])


def welch_features(spark: SparkSession, d: str) -> DataFrame:
    """Spectral descriptors of 64-sample signals at 90 Hz, windows of 32 samples."""
    e = tables.read(spark, d, "embeddings").select("vec_id", "embedding")
    out = signal.describe_arrays(e, ["vec_id"], "embedding", 90.0, 32, 16)
    return out.withColumns({c: F.round(c, 6) for c in signal.NAMES})


def cleaned_features(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "embeddings").select("vec_id", "embedding")
    return signal.describe_arrays(e, ["vec_id"], "embedding", 90.0, 32, 16, cleaned=True)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring ids 2n and 2n + 1 as the two channels of one signal."""
    e = tables.read(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 2).alias("pair"), F.col("embedding").cast("array<double>").alias("x"))
    even, odd = (e.filter(F.col("vec_id") % 2 == i).select("pair", F.col("x").alias(f"ch{i + 1}")) for i in (0, 1))
    return even.join(odd, "pair")


def two_channel_features(spark: SparkSession, d: str) -> DataFrame:
    """All 16 descriptors of two-channel signals of 64 samples, each one segment."""
    out = signal.segment_channels(_pairs(spark, d), ["pair"], ["ch1", "ch2"], 90.0, 64, 64, 32, cleaned=False)
    return out.select("pair", *[F.round(c, 6).alias(c) for c in signal.channel_names(["ch1", "ch2"])])


def file_features(spark: SparkSession, d: str) -> DataFrame:
    """The 64 features of two-channel signals: cleaned, cut into three segments, rolled up."""
    return extraction.file_features(_pairs(spark, d), "pair", rate=90.0, seconds=32 / 90, overlap=0.5, window=16)


def signal_files(spark: SparkSession, d: str) -> DataFrame:
    """Two-channel signals written as text files with a header, listed, parsed and counted; every seventh has only two columns and fails."""
    rows = _pairs(spark, d).select("pair", F.posexplode(F.arrays_zip("ch1", "ch2")).alias("i", "v"))
    line = F.concat_ws(" ", (F.col("i") / 90.0).cast("string"), F.col("v.ch1").cast("string"), F.when(F.col("pair") % 7 != 0, F.col("v.ch2").cast("string")))
    lines = rows.select("pair", F.struct("i", line.alias("line")).alias("l")).groupBy("pair").agg(F.array_sort(F.collect_list("l")).alias("l"))  # 64 samples a signal
    body = F.concat(F.lit("Time A B\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    texts = lines.select("pair", body.alias("value"))
    groups = tables.signal_groups(texts, "pair", _pairs(spark, d).count(), new_folder(spark, "texts"))
    folder, found = new_folder(spark, "signals"), new_folder(spark, "found")
    for i, group in enumerate(groups):
        tables.write_signals(group, "pair", f"{folder}/{i}")
        tables.write(_counted(spark, f"{folder}/{i}"), found, append=True)
    return spark.read.schema("pair long, n int, status string, last double, sum1 double, sum2 double").parquet(found)


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    """The signal files below a folder, listed, parsed in one pass and counted."""
    pair = F.regexp_extract("path", "pair=([0-9]+)", 1).cast("long").alias("pair")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    values = {"last": F.round(F.try_element_at("time", F.lit(-1)), 6), "sum1": total("ch1"), "sum2": total("ch2")}
    read = tables.read_signals(spark, folder)
    found = read.select(pair, "n", "status", *[F.when(F.col("status") == "ok", v).alias(c) for c, v in values.items()])
    return found.join(tables.list_signals(spark, folder).select(pair), "pair")


def csv_tables(spark: SparkSession, d: str) -> DataFrame:
    """The parts written as text with headers, read with a schema and renamed."""
    folder = new_folder(spark, "csv")
    p = tables.read(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    tables.write(p, folder, kind="csv")
    schema = T.StructType([T.StructField(c, t) for c, t in (("p_partkey", T.LongType()), ("p_brand", T.StringType()), ("p_size", T.IntegerType()), ("p_retailprice", T.DoubleType()))])
    back = tables.read_csv(spark, folder, schema, {"p_brand": "brand", "p_size": "size"})
    return back.groupBy("brand").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.round(F.sum("p_retailprice"), 2).alias("price"))


def matched_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the first page of their key, and how many have none, by language."""
    docs = tables.read(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit("k"), F.col("doc_id") % 500).alias("file_key"))
    pages = tables.read(spark, d, "pages").select(F.col("url").alias("path"), F.concat(F.lit("k"), F.col("page_id") % 700).alias("file_key"))
    found, missing = trajectory.match_files(docs, pages)
    of = found.groupBy("lang").agg(F.count("*").alias("n_found"), F.countDistinct("path").alias("n_paths"), F.min("path").alias("first_path"))
    return of.join(missing.groupBy("lang").agg(F.count("*").alias("n_missing")), "lang", "full").select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_found", "n_paths", "n_missing")], "first_path")


_SEGMENTS = f"""
e AS (SELECT user_id, ts, event_id, value, median(value) OVER (PARTITION BY user_id) AS m, stddev_samp(value) OVER (PARTITION BY user_id) AS s FROM events),
mads AS (SELECT user_id, median(abs(value - m)) AS mad FROM e GROUP BY user_id),
x AS (SELECT user_id, greatest(least((value - m) / CASE WHEN mad > 0 THEN mad * 1.4826 WHEN s > 0 THEN s ELSE 1 END, 8), -8) AS x,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e JOIN mads USING (user_id)),
cut AS (SELECT user_id, k AS segment, i - k * {HOP} AS i, x FROM (SELECT *, unnest(range(0, n // {HOP} + 1)) AS k FROM x) WHERE i >= k * {HOP} AND i < k * {HOP} + {LENGTH} AND k * {HOP} + {LENGTH} <= n),
jumps AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY user_id, segment ORDER BY i)) AS j FROM cut),
seg AS (SELECT user_id, CAST(segment AS INT) AS segment, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std, sqrt(avg(x * x)) AS rms, max(x) - min(x) AS "range", avg(j) AS mean_jump,
    max(abs(x)) > 7.99 OR coalesce(stddev_samp(x), 0) < 0.05 OR max(j) > 5 OR avg(CASE WHEN abs(x) > 5 THEN 1.0 ELSE 0.0 END) > 0.05 AS bad FROM jumps GROUP BY user_id, segment)
"""


def _hazen(c: str, p: float) -> str:
    r = f"least(greatest(n * {p} + 0.5, 1), n)"
    k = f"CAST(floor({r}) AS BIGINT)"
    return f"({c}[{k}] + ({c}[least({k} + 1, n)] - {c}[{k}]) * ({r} - floor({r})))"


_ROLL = ", ".join(f"avg({c}) AS {c}_mean, coalesce(stddev_samp({c}), 0) AS {c}_std, median({c}) AS {c}_med, list({c} ORDER BY {c}) AS {c}_l" for c in ("mean", "std", "rms", '"range"', "mean_jump")).replace('"range"_', "range_")
_WINDOWS = ", ".join(
    f"list_sum(list_transform(range(0, 32), lambda t: CAST(embedding[{s} + t + 1] AS DOUBLE) * (0.54 - 0.46 * cos(2 * pi() * t / 31)) * cos(2 * pi() * k * t / 32))) AS c{s}, "
    f"list_sum(list_transform(range(0, 32), lambda t: CAST(embedding[{s} + t + 1] AS DOUBLE) * (0.54 - 0.46 * cos(2 * pi() * t / 31)) * sin(2 * pi() * k * t / 32))) AS s{s}"
    for s in (0, 16, 32)
)


def _band(a: float, b: float) -> str:
    return f"sum(CASE WHEN f BETWEEN {a} AND {b} AND k < 16 THEN p ELSE 0 END)"


SQL = {
    "segment_features": f"WITH {_SEGMENTS} SELECT user_id, segment, round(mean, 6) AS mean, round(std, 6) AS std, round(rms, 6) AS rms, round(\"range\", 6) AS \"range\", round(mean_jump, 6) AS mean_jump, bad FROM seg",
    "segment_rollup": f"""WITH {_SEGMENTS},
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('{SEED}|' || user_id || '|' || segment)) AS r FROM seg WHERE NOT bad) WHERE r <= {CAP}),
g AS (SELECT user_id, count(*) AS n, {_ROLL} FROM capped GROUP BY user_id)
SELECT user_id, n AS num_segments, {", ".join(f"round({c}_mean, 6) AS {c}_mean, round({c}_std, 6) AS {c}_std, round({c}_med, 6) AS {c}_med, round({_hazen(c + '_l', 0.75)} - {_hazen(c + '_l', 0.25)}, 6) AS {c}_iqr" for c in NAMES)} FROM g""",
    "welch_features": f"""WITH dft AS (SELECT vec_id, k, k * 90.0 / 32 AS f, {_WINDOWS} FROM embeddings, range(0, 17) t(k)),
power AS (SELECT vec_id, k, f, (c0 * c0 + s0 * s0 + c16 * c16 + s16 * s16 + c32 * c32 + s32 * s32) / 3 AS p FROM dft WHERE f <= 45),
shares AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY k) / sum(p) OVER (PARTITION BY vec_id) AS share FROM power)
SELECT vec_id, round({_band(4, 8)} / {_band(1, 45)}, 6) AS theta_rel, round({_band(8, 13)} / {_band(1, 45)}, 6) AS alpha_rel, round({_band(13, 30)} / {_band(1, 45)}, 6) AS beta_rel,
  round({_band(4, 8)} / {_band(8, 13)}, 6) AS theta_alpha_ratio, round(min(f) FILTER (share >= 0.5), 6) AS median_freq, round(min(f) FILTER (share >= 0.95), 6) AS sef95 FROM shares GROUP BY vec_id""",
}
_W = SQL["welch_features"]
_GOOD = "g AS (SELECT vec_id // 2 AS pair, stddev_samp(v) AS s, max(abs(v)) AS m, max(abs(v - b)) AS j, avg(CASE WHEN abs(v) > 5 THEN 1.0 ELSE 0.0 END) AS h FROM (SELECT vec_id, v, lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS b FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS i FROM embeddings)) GROUP BY vec_id), good AS (SELECT pair FROM g GROUP BY pair HAVING count(*) = 2 AND min(s) >= 0.05 AND max(m) <= 8 AND max(j) <= 5 AND avg(h) <= 0.05)"
SQL["two_channel_features"] = f"""WITH w AS ({_W.replace("round(", "(").replace(", 6)", ")")}), {_GOOD},
r AS (SELECT pair, corr(a, b) AS ch1_ch2_corr FROM (SELECT x.vec_id // 2 AS pair, unnest(x.embedding)::DOUBLE AS a, unnest(y.embedding)::DOUBLE AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0) GROUP BY pair)
SELECT pair, {", ".join(f"round({t}.{n}, 6) AS ch{i}_{n}" for i, t in ((1, "a"), (2, "b")) for n in signal.NAMES)}, round(ch1_ch2_corr, 6) AS ch1_ch2_corr, {", ".join(f"round((a.{n} + b.{n}) / 2, 6) AS mean_{n}" for n in signal.NAMES[3:])}
FROM good JOIN w a ON a.vec_id = 2 * pair JOIN w b ON b.vec_id = 2 * pair + 1 JOIN r USING (pair)"""
SQL["signal_files"] = """WITH v AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT pair, CAST(count(*) / 2 AS INT) AS n, sum(v) FILTER (side = 0) AS s1, sum(v) FILTER (side = 1) AS s2 FROM v GROUP BY pair HAVING count(DISTINCT side) = 2)
SELECT pair, CASE WHEN pair % 7 = 0 THEN 0 ELSE n END AS n, CASE WHEN pair % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN pair % 7 <> 0 THEN round((n - 1) / 90.0, 6) END AS "last",
  CASE WHEN pair % 7 <> 0 THEN round(s1, 4) END AS sum1, CASE WHEN pair % 7 <> 0 THEN round(s2, 4) END AS sum2 FROM g"""
SQL["csv_tables"] = "SELECT p_brand AS brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1"
SQL["matched_files"] = """WITH first AS (SELECT 'k' || page_id % 700 AS file_key, min(url) AS path FROM pages GROUP BY 1),
d AS (SELECT lang, path FROM documents LEFT JOIN first ON file_key = 'k' || doc_id % 500)
SELECT lang, count(path) AS n_found, count(DISTINCT path) AS n_paths, count(*) - count(path) AS n_missing, min(path) AS first_path FROM d GROUP BY lang"""
QUERIES = {f.__name__: f for f in (segment_features, segment_rollup, welch_features, cleaned_features, two_channel_features, file_features, signal_files, csv_tables, matched_files)}
