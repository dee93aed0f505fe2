"""Feature tables: columns by rule, values to arrays or long form, tasks, missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats


def feature_columns(df: DataFrame, meta: list[str]) -> list[str]:
    """All numeric columns but the metadata, in their order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in meta]


def need_columns(df: DataFrame, names: list[str]) -> list[str]:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")
    return names


def subject_column(df: DataFrame) -> str | None:
    """The column that names the subject, by the usual names whatever their case; None if there is none."""
    by_name = {c.lower(): c for c in reversed(df.columns)}
    return next((by_name[n.lower()] for n in ("ObjectID", "SubjectID", "subject_id", "ID", "OID") if n.lower() in by_name), None)


def to_long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, feature, value), one row for each feature."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])
    return df.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.feature", "e.value")


def unpack(df: DataFrame, array: str, prefix: str, n: int) -> DataFrame:
    """The first n elements of an array as columns."""
    return df.select("*", *[F.get(array, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(n)])


def pick_task(df: DataFrame, source: str, zero: list[str], one: list[str], names: tuple[str, str]) -> DataFrame:
    """Rows of two classes with task_class and y (0 or 1)."""
    y = F.when(F.col(source).isin(zero), 0).when(F.col(source).isin(one), 1)
    return df.withColumn("y", y).filter("y IS NOT NULL").withColumn("task_class", F.when(F.col("y") == 0, names[0]).otherwise(names[1]))


#: The core tasks and the pairwise ones (name, column, values of class 0, values of class 1).
CORE_TASKS = [
    ("MaintainNormal_vs_DeclineToDEM", "simple_subtype", ["Maintain_CN", "Maintain_SCD"], ["Decline_MCI_to_DEM", "Decline_Normal_to_DEM"]),
    ("Relaxed_MaintainNormal_vs_DeclineToDEM", "simple_subtype", ["Maintain_CN", "Maintain_SCD"], ["Decline_MCI_to_DEM", "Decline_Normal_to_DEM", "Decline_to_DEM_Other"]),
    ("MaintainNormal_vs_DeclineToMCI", "simple_subtype", ["Maintain_CN", "Maintain_SCD"], ["Decline_to_MCI"]),
    ("DeclineToMCI_vs_DeclineToDEM", "simple_subtype", ["Decline_to_MCI"], ["Decline_MCI_to_DEM", "Decline_Normal_to_DEM", "Decline_to_DEM_Other"]),
]
PAIRWISE_TASKS = [
    ("CN_SCD_vs_MCI", "current_dx", ["CN", "SCD"], ["MCI"]),
    ("CN_SCD_vs_DEM", "current_dx", ["CN", "SCD"], ["DEM/D"]),
    ("CN_vs_MCI", "current_dx", ["CN"], ["MCI"]),
    ("CN_vs_DEM", "current_dx", ["CN"], ["DEM/D"]),
    ("MCI_vs_DEM", "current_dx", ["MCI"], ["DEM/D"]),
    ("SCD_vs_MCI", "current_dx", ["SCD"], ["MCI"]),
    ("MaintainCN_vs_DeclineNormalToDEM", "simple_subtype", ["Maintain_CN"], ["Decline_Normal_to_DEM"]),
    ("MaintainCN_vs_DeclineMCIToDEM", "simple_subtype", ["Maintain_CN"], ["Decline_MCI_to_DEM"]),
]


def all_tasks(df: DataFrame, tasks: list[tuple[str, str, list[str], list[str]]] = CORE_TASKS) -> DataFrame:
    """Each row once for every task that it belongs to, with task and y, in one pass."""
    found = []
    for name, source, zero, one in tasks:
        y = F.when(F.col(source).isin(zero), 0).when(F.col(source).isin(one), 1)
        found.append(F.when(y.isNotNull(), F.struct(F.lit(name).alias("task"), y.alias("y"))))
    return df.withColumn("_t", F.explode(F.filter(F.array(*found), lambda t: t.isNotNull()))).select(*df.columns, "_t.*")


def impute_median(df: DataFrame, names: list[str], finite_only: bool = True) -> DataFrame:
    """Missing values replaced by the column's median, 0 where it has none. finite_only: infinities are missing too."""
    value = lambda c: stats.finite(F.col(c).cast("double")) if finite_only else F.nanvl(F.col(c).cast("double"), F.lit(None))
    clean = df.withColumns({c: value(c) for c in names})
    found = stats.hazen_percentiles(to_long(clean, [], names), ["feature"], "value", {"m": 0.5}).collect()  # one median a column
    medians = {r["feature"]: r["m"] for r in found}
    return clean.withColumns({c: F.coalesce(c, F.lit(medians.get(c, 0.0))) for c in names})
