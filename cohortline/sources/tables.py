"""Reading and writing of tables and signal files."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, names: dict[str, str] | None = None) -> DataFrame:
    """A table of texts with its headers kept, then renamed by the map given."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumnsRenamed(names or {})


def optional(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the same columns where there is none: joins then give nulls."""
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def _few_tasks(df: DataFrame) -> DataFrame:
    """A few tasks for each core, where Spark would deal a few small files to each of very many."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def list_signals(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """(path, name, file_key) of all signal files below a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path")
    files = _few_tasks(files)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("name"), text.file_key(name).alias("file_key"))


#: Files of one group and folders that hold them. The driver keeps a record of every file that a DataFrame reads and of every task,
#: so many signals are written, listed and read group by group; a folder's files are listed by one task and moved into place together.
GROUP, SHELVES = 10_000, 100


def signal_groups(texts: DataFrame, key: str, rows: int, folder: str) -> list[DataFrame]:
    """texts (key, value), kept once in a folder, as groups (key, value, shelf) of about GROUP rows; rows: how many there are."""
    n = max(1, math.ceil(rows / GROUP))
    at = F.pmod(F.xxhash64(key), F.lit(n * SHELVES))
    kept = texts.select(key, "value", F.floor(at / n).cast("int").alias("shelf"), (at % n).cast("int").alias("part"))
    kept.repartition("part", "shelf").write.partitionBy("part").parquet(folder)
    back = texts.sparkSession.read.schema(kept.schema).parquet(folder)
    return [back.filter(F.col("part") == i).drop("part") for i in range(n)]


def write_signals(group: DataFrame, key: str, folder: str) -> None:
    """A text file for each row, below a folder named key=... that tells whose it is."""
    tasks = min(SHELVES, 4 * group.sparkSession.sparkContext.defaultParallelism)
    group.repartition(tasks, "shelf").write.partitionBy("shelf", key).text(folder)


SIGNAL = "path string, n int, time array<double>, ch1 array<double>, ch2 array<double>, status string, error string"


def _columns(body: str) -> np.ndarray:
    """The first three numbers of each line from the first numeric one on (line, number); a later line of other text is NaN, one with fewer numbers is left out."""
    text_ = body.replace(",", " ").replace(";", " ")
    at = 0
    while at < len(text_):  # the header
        end = text_.find("\n", at)
        line = text_[at : end if end >= 0 else len(text_)].split()
        if line and _numbers(line[:3]):
            break
        at = end + 1 if end >= 0 else len(text_)
    if at >= len(text_):
        return np.zeros((0, 3))
    try:  # all at once
        return np.loadtxt(io.StringIO(text_[at:]), comments=None, usecols=(0, 1, 2), ndmin=2)
    except (ValueError, IndexError):
        rows = []
    for line in text_[at:].splitlines():
        parts = line.split()
        if not parts:
            continue
        found = _numbers(parts[:3])
        rows.append([np.nan] * 3 if found is None else found)
    return np.array([r for r in rows if len(r) == 3]).reshape(-1, 3)


def _numbers(parts: list[str]) -> list[float] | None:
    try:
        return [float(x) for x in parts]
    except ValueError:
        return None


def parse_signal(body: str, rate: float = 250.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time and two channels of a signal text: lines before the first numeric one are skipped.

    Times that aren't finite or don't rise become i / rate. Fails without three columns.
    """
    rows = _columns(body)
    if not len(rows):
        raise ValueError("a signal needs a time and two channels")
    t, a, b = rows.T
    if not np.isfinite(t).all() or (np.diff(t) <= 0).any():
        t = np.arange(len(t)) / rate
    return t, a, b


def read_signals(spark: SparkSession, paths: str | list[str], rate: float = 250.0) -> DataFrame:
    """Parsed signal files at and below the paths, one row each; a file that can't be parsed has the status 'error' and says why.

    The driver keeps a record of each file: a few ten thousand at once are fine, more are read by groups.
    """
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    files = _few_tasks(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                try:
                    t, a, b = parse_signal(body or "", rate)
                    row = [path, len(t), t.tolist(), a.tolist(), b.tolist(), "ok", None]
                except ValueError as e:
                    row = [path, 0, [], [], [], "error", str(e)]
                kinds = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["path", "n", "time", "ch1", "ch2", "status", "error"])

    return files.mapInArrow(run, SIGNAL)


def good_and_bad(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed files, and (path, status, error) of the others."""
    return signals.filter("status = 'ok'"), signals.filter("status <> 'ok'").select("path", "status", "error")


def write(df: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet", append: bool = False) -> None:
    """A result table; append adds a part, such as one repeat of a job that can be taken up again."""
    w = df.write.mode("append" if append else "overwrite")
    w = w.partitionBy(*by) if by else w
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


#: The form in which models are saved; others aren't read.
MODEL_VERSION = 2


def save_model(spark: SparkSession, path: str, features: list[str], mean: list[float], sd: list[float], b: list[float], cov: list[list[float]], draws: np.ndarray | None = None, cases: DataFrame | None = None) -> None:
    """A fitted model as a folder: one row of arrays with its version, the draws (draw, b0, b1, ...) that its analysis took, and its cases (row, kind, ...)."""
    parts = [p for p, x in (("draws", draws), ("cases", cases)) if x is not None]
    row = [(MODEL_VERSION, parts, features, [float(x) for x in mean], [float(x) for x in sd], [float(x) for x in b], [float(x) for r in cov for x in r])]
    spark.createDataFrame(row, "version int, parts array<string>, features array<string>, mean array<double>, sd array<double>, b array<double>, cov array<double>").write.mode("overwrite").parquet(f"{path}/model")
    if draws is not None:
        names = ["draw", *[f"b{i}" for i in range(draws.shape[1])]]
        table = pa.table([pa.array(range(len(draws)), pa.int64()), *[pa.array(c) for c in draws.T.astype(float)]], names=names)
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/draws")
    if cases is not None:
        cases.write.mode("overwrite").parquet(f"{path}/cases")


def load_model(spark: SparkSession, path: str) -> dict:
    """The model as arrays, with draws and cases as DataFrames where they were saved (else None); a model of another version is an error."""
    r = spark.read.parquet(f"{path}/model").head()
    if r["version"] != MODEL_VERSION:
        raise ValueError(f"a model of version {r['version']}; {MODEL_VERSION} is read")
    n = len(r["b"])
    out = {"features": list(r["features"]), "mean": np.array(r["mean"]), "sd": np.array(r["sd"]), "b": np.array(r["b"]), "cov": np.array(r["cov"]).reshape(n, n)}
    return out | {p: spark.read.parquet(f"{path}/{p}") if p in r["parts"] else None for p in ("draws", "cases")}


def load_signature(results: DataFrame, name: str) -> DataFrame:
    """(feature) of the signature of that name in a result table (FeatureSet, SelectedFeatures as a comma list)."""
    return results.filter(F.col("FeatureSet") == name).limit(1).select(F.explode(text.split_list(F.col("SelectedFeatures"))).alias("feature"))
