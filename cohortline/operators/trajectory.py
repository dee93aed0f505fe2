"""Trajectory labels: each examination is matched to the nearest entry of its person's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text


def complete_exams(exams: DataFrame, fields: list[str], files: list[str], prefix: str = "ID") -> DataFrame:
    """Rows with a valid text in every field and file names that begin with the prefix."""
    keep = F.lit(True)
    for c in fields:
        keep = keep & text.valid_text(F.col(c))
    for c in files:
        keep = keep & text.valid_text(F.col(c)) & F.upper(F.trim(F.col(c))).startswith(prefix)
    return exams.filter(keep)


def first_history(history: DataFrame, subject: str, order: str) -> DataFrame:
    """The first row of each person: (object_id, dates, diagnoses); persons with under two entries of either are left out.

    One aggregation with partial results, so a person with very many rows is no large group.
    """
    rows = history.select(text.last_number(F.col(subject)).alias("object_id"), F.struct(order, "date_seq", "dx_seq").alias("r")).filter("object_id IS NOT NULL")
    first = rows.groupBy("object_id").agg(F.min("r").alias("r"))
    parsed = first.select("object_id", text.parse_dates(F.col("r.date_seq")).alias("dates"), text.parse_diagnoses(F.col("r.dx_seq")).alias("diagnoses"))
    return parsed.filter((F.size("dates") >= 2) & (F.size("diagnoses") >= 2))


def nearest_entry(dates: Column, yyyymm: Column) -> Column:
    """(diff, seq, visit) of the entry with the smallest distance in months, the first of equals."""
    return F.array_min(F.transform(dates, lambda v: F.struct(F.abs(text.month_distance(yyyymm, v["yyyymm"])).alias("diff"), v["seq"].alias("seq"), v["visit"].alias("visit"))))


def label_trajectories(exams: DataFrame, history: DataFrame, max_months: int = 3) -> DataFrame:
    """exams (object_id, yyyymm, ...) with the matched visit, its neighbours, their diagnoses and the label.

    history: as first_history gives it. Exams without history or with no entry within
    max_months are left out. The visit before gives its last record, the one after its first;
    diagnoses are taken by the position of the date in its sequence. What is worked out comes as one
    exploded struct: a filter on it isn't moved below an explode, where every column would stand for its whole expression.
    """
    m = exams.filter("object_id IS NOT NULL AND yyyymm IS NOT NULL").join(history, "object_id").withColumn("near", nearest_entry(F.col("dates"), F.col("yyyymm")))
    m = m.filter(F.col("near.diff") <= max_months).withColumn("visits", F.array_distinct(F.transform("dates", lambda d: d["visit"])))
    m = m.withColumn("at", F.array_position("visits", F.col("near.visit")).cast("int"))
    m = m.withColumns({"has_prev": F.col("at") > 1, "has_next": F.col("at") < F.size("visits")})
    m = m.withColumns({"prev_visit": F.get("visits", F.col("at") - 2), "next_visit": F.get("visits", F.col("at"))})
    of = lambda v: F.filter("dates", lambda d: d["visit"] == F.col(v))
    seqs = {"prev": F.try_element_at(of("prev_visit"), F.lit(-1))["seq"], "current": F.col("near.seq"), "next": F.try_element_at(of("next_visit"), F.lit(1))["seq"]}
    m = m.withColumns({f"{k}_seq": s for k, s in seqs.items()})
    by_seq = lambda s: F.try_element_at(F.filter("diagnoses", lambda d: d["seq"] == F.col(s)), F.lit(1))["dx"]
    raw = {f"{k}_dx_raw": by_seq(f"{k}_seq") for k in seqs}
    m = m.withColumns(raw).withColumns({f"{k}_dx": text.strict_diagnosis(F.col(f"{k}_dx_raw")) for k in seqs})
    m = m.withColumn("c", rules.classify_trajectory(F.col("prev_dx"), F.col("current_dx"), F.col("next_dx"), F.col("has_prev"), F.col("has_next")))
    out = F.struct(
        F.col("near.visit").alias("current_visit"),
        F.col("near.diff").alias("month_difference"),
        "has_prev", "has_next", "prev_visit", "next_visit",
        *raw, *[f"{k}_dx" for k in seqs],
        F.col("c.label").alias("strict_label"), F.col("c.subtype").alias("strict_subtype"), F.col("c.reason").alias("exclude_reason"),
        (F.col("c.label") != "Exclude").alias("include_final"),
    )
    return m.select(*exams.columns, F.explode(F.array(out)).alias("_out")).select(*exams.columns, "_out.*")


def mean_scores(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of the finite values of each key."""
    v = F.col(value).try_cast("double")
    return scores.withColumn("_v", v).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf"))).groupBy(*keys).agg(F.avg("_v").alias("z"))


def with_scores(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """labels with prev_z, current_z, next_z and the three slopes; scores: (object_id, visit, z), one row for each.

    The scores of a person are one map, so three look-ups cost one join.
    """
    by_person = scores.filter("visit IS NOT NULL").groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct("visit", "z"))).alias("zs"))
    out = labels.join(by_person, "object_id", "left")
    out = out.withColumns({f"{k}_z": F.when(F.col(f"{k}_visit").isNotNull(), F.try_element_at("zs", F.coalesce(f"{k}_visit", F.lit(-1)))) for k in ("prev", "current", "next")})
    return out.withColumns({
        "slope_prev_to_current": F.col("current_z") - F.col("prev_z"),
        "slope_current_to_next": F.col("next_z") - F.col("current_z"),
        "slope_prev_to_next": F.col("next_z") - F.col("prev_z"),
    }).drop("zs")


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def match_files(rows: DataFrame, files: DataFrame, key: str = "file_key") -> tuple[DataFrame, DataFrame]:
    """rows with the path of the file of their key (the first path of several), and the rows without a file."""
    first = files.groupBy(key).agg(F.min("path").alias("path"))
    return rows.join(first, key), rows.join(first, key, "left_anti")


def best_per_key(df: DataFrame, key: str, order: list[Column], n: int | None = None) -> DataFrame:
    """The first row of each key in the order given, ranked over all keys; the first n of them."""
    top = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
    return top.orderBy(*order).limit(n) if n else top
