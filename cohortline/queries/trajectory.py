"""Trajectory labels over orders: open ones are a customer's history, finished ones the examinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import features
from ..operators import trajectory as T
from ..sources import tables

DX = {"1-URGENT": "CN", "2-HIGH": "SCD", "3-MEDIUM": "MCI", "4-NOT SPECIFIED": "DEM", "5-LOW": "NOS"}


def _history(spark: SparkSession, d: str) -> DataFrame:
    """Histories as texts, two records for each visit, in the form that the parsers read."""
    o = tables.read(spark, d, "orders").filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    dx = F.create_map(*[F.lit(x) for kv in DX.items() for x in kv])[F.col("o_orderpriority")]
    entry = F.struct("o_orderdate", "o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("ym"), dx.alias("dx"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    join = lambda f: F.array_join(F.transform("e", lambda e, i: F.concat(F.floor(i / 2 + 1).cast("string"), F.lit("차 : "), e[f])), ", ")
    return g.select(F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("subject"), join("ym").alias("date_seq"), join("dx").alias("dx_seq"), F.lit(1).alias("source_row"))


def _exams(spark: SparkSession, d: str) -> DataFrame:
    o = tables.read(spark, d, "orders").filter("o_orderstatus = 'F'")
    exam = o.select(
        F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("object_text"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("visit_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("exam_date"),
        F.concat(F.lit("id"), F.col("o_orderkey").cast("string")).alias("file"),
    )
    exam = T.complete_exams(exam, ["object_text", "visit_text", "exam_date"], ["file"])
    return exam.select(text.last_number(F.col("object_text")).alias("object_id"), "visit_text", text.visit_number(F.col("visit_text")).alias("visit_num"), "exam_date", text.year_month(F.col("exam_date")).alias("yyyymm"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return T.label_trajectories(_exams(spark, d), T.first_history(_history(spark, d), "subject", "source_row"))


def trajectory_labels(spark: SparkSession, d: str) -> DataFrame:
    o = tables.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("object_id"))
    li = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("visit"), "l_quantity")
    scores = T.mean_scores(li.join(o, "o_orderkey"), ["object_id", "visit"], "l_quantity")
    out = T.with_scores(_labels(spark, d), scores)
    zs = [c for c in out.columns if c.endswith("_z") or c.startswith("slope")]
    return out.withColumns({c: F.round(c, 6) for c in zs})


def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    out = _labels(spark, d).withColumn("simple_subtype", rules.simplify_subtype(F.col("strict_label"), F.col("strict_subtype"), F.col("current_dx")))
    return out.groupBy("strict_label", "strict_subtype", "simple_subtype").agg(F.count("*").alias("n"), F.countDistinct("object_id").alias("n_subjects"))


def exclude_reasons(spark: SparkSession, d: str) -> DataFrame:
    return T.counts(_labels(spark, d).filter("NOT include_final"), "exclude_reason")


def unmatched_exams(spark: SparkSession, d: str) -> DataFrame:
    """Examinations of persons with a history but without an entry close in time, by year and person's segment."""
    exams, labels = _exams(spark, d), _labels(spark, d)
    left = exams.join(labels.select("object_id", "visit_text"), ["object_id", "visit_text"], "left_anti")
    c = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), "c_mktsegment")
    return left.join(c, "object_id").groupBy("c_mktsegment", F.substring("exam_date", 1, 4).alias("year")).agg(F.count("*").alias("n"))


def task_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Examinations of each task and class, all tasks in one pass."""
    out = _labels(spark, d).withColumn("simple_subtype", rules.simplify_subtype(F.col("strict_label"), F.col("strict_subtype"), F.col("current_dx")))
    return features.all_tasks(out, features.CORE_TASKS + features.PAIRWISE_TASKS).groupBy("task", "y").agg(F.count("*").alias("n"), F.countDistinct("object_id").alias("n_subjects"))


def text_rules(spark: SparkSession, d: str) -> DataFrame:
    """The scalar parsers over texts made from the events and parts."""
    p = tables.read(spark, d, "part")
    name, key = F.col("p_name"), F.col("p_partkey").cast("string")
    return p.select(
        "p_partkey",
        text.last_number(F.concat(name, F.lit("-0"), key)).alias("last_no"),
        text.leading_number(F.concat(key, name)).alias("lead_no"),
        text.visit_number(F.concat(F.lit("a"), key, F.lit("-"), F.col("p_size").cast("string"))).alias("visit_no"),
        text.year_month(F.concat(F.lit("2018"), F.lit("/"), (F.col("p_partkey") % 12 + 1).cast("string"))).alias("ym"),
        text.year_month(F.concat(F.lit("exam "), key, F.lit(" of 2018-"), (F.col("p_partkey") % 12 + 1).cast("string"), F.lit(" (late)"))).alias("ym_inside"),
        text.year_month(F.concat(F.lit("v2019"), F.lpad((F.col("p_partkey") % 12 + 1).cast("string"), 2, "0"), F.lit("x"))).alias("ym_six"),
        text.file_key(F.concat(F.lit(" Rec "), key, F.lit("_9h_5m_12s(L1)_B_raw.txt"))).alias("file_key_other"),
        text.month_distance(F.lit(201901), F.lit(201801) + F.col("p_partkey") % 12).alias("months"),
        text.loose_diagnosis(F.element_at(F.array(*[F.lit(x) for x in ("cn", "aMCI", "DEMENTED", "NOS", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("loose_dx"),
        text.file_key(F.concat(F.lit("ID"), key, F.lit("-2018y-07m_17d_9h_5m.TXT"))).alias("file_key"),
        text.valid_text(F.when(F.col("p_partkey") % 3 == 0, F.lit(" NaN ")).otherwise(name)).alias("valid"),
    )


_LABELS = """
hist AS (SELECT o_custkey AS object_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS seq,
    CAST(strftime(o_orderdate, '%Y%m') AS INT) AS ym,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CN' WHEN '2-HIGH' THEN 'SCD' WHEN '3-MEDIUM' THEN 'MCI' WHEN '4-NOT SPECIFIED' THEN 'DEM' ELSE 'NOS' END AS raw
    FROM orders WHERE o_orderstatus <> 'F'),
h AS (SELECT *, (seq + 1) // 2 AS visit, count(*) OVER (PARTITION BY object_id) AS total,
    CASE raw WHEN 'DEM' THEN 'DEM/D' ELSE raw END AS dx FROM hist),
exams AS (SELECT o_custkey AS object_id, o_custkey || '-' || o_orderkey AS visit_text, CAST(o_orderkey AS INT) AS visit_num, strftime(o_orderdate, '%Y-%m-%d') AS exam_date, CAST(strftime(o_orderdate, '%Y%m') AS INT) AS yyyymm FROM orders WHERE o_orderstatus = 'F'),
near AS (SELECT * FROM (SELECT e.*, seq, visit, total, raw, dx, abs((yyyymm // 100 - ym // 100) * 12 + (yyyymm % 100 - ym % 100)) AS diff,
    row_number() OVER (PARTITION BY visit_text ORDER BY abs((yyyymm // 100 - ym // 100) * 12 + (yyyymm % 100 - ym % 100)), seq) AS r FROM exams e JOIN h USING (object_id) WHERE total >= 2) WHERE r = 1 AND diff <= 3),
around AS (SELECT n.*, n.visit > 1 AS has_prev, n.visit < (n.total + 1) // 2 AS has_next, p.raw AS prev_raw, coalesce(p.dx, 'Unknown') AS prev_dx, x.raw AS next_raw, coalesce(x.dx, 'Unknown') AS next_dx
    FROM near n LEFT JOIN h p ON p.object_id = n.object_id AND p.seq = 2 * (n.visit - 1) LEFT JOIN h x ON x.object_id = n.object_id AND x.seq = 2 * n.visit + 1),
steps AS (SELECT *, concat_ws('_to_', CASE WHEN has_prev THEN prev_dx END, dx, CASE WHEN has_next THEN next_dx END) AS path,
    concat_ws('__', CASE WHEN has_prev THEN prev_dx || '_to_' || dx END, CASE WHEN has_next THEN dx || '_to_' || next_dx END) AS pairs,
    (NOT has_prev OR prev_dx = dx OR (prev_dx IN ('CN', 'SCD') AND dx IN ('MCI', 'DEM/D')) OR (prev_dx = 'MCI' AND dx = 'DEM/D')) AND
    (NOT has_next OR next_dx = dx OR (dx IN ('CN', 'SCD') AND next_dx IN ('MCI', 'DEM/D')) OR (dx = 'MCI' AND next_dx = 'DEM/D')) AS clear,
    (has_prev AND prev_dx <> dx) OR (has_next AND next_dx <> dx) AS moves FROM around),
why AS (SELECT *, CASE WHEN dx = 'NOS' THEN 'Invalid current diagnosis'
    WHEN has_prev AND has_next AND (prev_dx = 'NOS' OR next_dx = 'NOS') THEN 'Invalid prev or next diagnosis'
    WHEN has_prev AND has_next AND prev_dx = dx AND dx = next_dx AND dx IN ('CN', 'SCD') THEN 'Accepted: stable CN/SCD across three visits'
    WHEN has_prev AND prev_dx = 'NOS' THEN 'Invalid previous diagnosis' WHEN has_next AND next_dx = 'NOS' THEN 'Invalid next diagnosis'
    WHEN NOT has_prev AND NOT has_next THEN 'Not enough visits'
    WHEN NOT clear THEN 'Excluded: ambiguous, oscillating, or improving transition (' || path || ')'
    WHEN NOT moves THEN 'Excluded: no worsening transition (' || path || ')'
    ELSE 'Accepted: strict worsening sequence (' || path || ')' END AS reason FROM steps),
labels AS (SELECT *, CASE WHEN reason LIKE '%stable%' THEN 'Maintain' WHEN reason LIKE 'Accepted%' THEN 'Declining' ELSE 'Exclude' END AS label,
    CASE WHEN reason LIKE '%stable%' THEN dx || '_Stable' WHEN reason LIKE 'Accepted%' THEN pairs ELSE 'Exclude' END AS subtype FROM why)
"""
_SIMPLE = """CASE label WHEN 'Maintain' THEN 'Maintain_' || dx WHEN 'Declining' THEN
  CASE WHEN subtype LIKE '%CN_to_MCI%' OR subtype LIKE '%SCD_to_MCI%' THEN 'Decline_to_MCI' WHEN subtype LIKE '%CN_to_DEM%' OR subtype LIKE '%SCD_to_DEM%' THEN 'Decline_Normal_to_DEM'
  ELSE 'Decline_MCI_to_DEM' END ELSE 'Other' END"""


def _task_sql() -> str:
    column = {"simple_subtype": "simple", "current_dx": "dx"}
    lists = lambda v: ", ".join(f"'{x}'" for x in v)
    parts = [f"SELECT '{n}' AS task, CASE WHEN {column[c]} IN ({lists(a)}) THEN 0 WHEN {column[c]} IN ({lists(b)}) THEN 1 END AS y, object_id FROM s" for n, c, a, b in features.CORE_TASKS + features.PAIRWISE_TASKS]
    return f"WITH {_LABELS}, s AS (SELECT *, {_SIMPLE} AS simple FROM labels) SELECT task, y, count(*) AS n, count(DISTINCT object_id) AS n_subjects FROM ({' UNION ALL '.join(parts)}) WHERE y IS NOT NULL GROUP BY ALL"


SQL = {
    "task_catalogue": _task_sql(),
    "trajectory_labels": f"""WITH {_LABELS},
scores AS (SELECT o_custkey AS object_id, l_linenumber AS v, avg(l_quantity) AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT l.object_id, visit_text, visit_num, exam_date, yyyymm, visit AS current_visit, diff AS month_difference, has_prev, has_next,
  CASE WHEN has_prev THEN visit - 1 END AS prev_visit, CASE WHEN has_next THEN visit + 1 END AS next_visit,
  prev_raw AS prev_dx_raw, raw AS current_dx_raw, next_raw AS next_dx_raw, prev_dx, dx AS current_dx, next_dx,
  label AS strict_label, subtype AS strict_subtype, reason AS exclude_reason, label <> 'Exclude' AS include_final,
  round(a.z, 6) AS prev_z, round(b.z, 6) AS current_z, round(c.z, 6) AS next_z,
  round(b.z - a.z, 6) AS slope_prev_to_current, round(c.z - b.z, 6) AS slope_current_to_next, round(c.z - a.z, 6) AS slope_prev_to_next
FROM labels l LEFT JOIN scores a ON a.object_id = l.object_id AND has_prev AND a.v = visit - 1
  LEFT JOIN scores b ON b.object_id = l.object_id AND b.v = visit LEFT JOIN scores c ON c.object_id = l.object_id AND has_next AND c.v = visit + 1""",
    "trajectory_summary": f"""WITH {_LABELS}
SELECT label AS strict_label, subtype AS strict_subtype, CASE label WHEN 'Maintain' THEN 'Maintain_' || dx WHEN 'Declining' THEN
  CASE WHEN subtype LIKE '%CN_to_MCI%' OR subtype LIKE '%SCD_to_MCI%' THEN 'Decline_to_MCI' WHEN subtype LIKE '%CN_to_DEM%' OR subtype LIKE '%SCD_to_DEM%' THEN 'Decline_Normal_to_DEM'
  ELSE 'Decline_MCI_to_DEM' END ELSE 'Other' END AS simple_subtype, count(*) AS n, count(DISTINCT object_id) AS n_subjects FROM labels GROUP BY ALL""",
    "exclude_reasons": f"WITH {_LABELS} SELECT reason AS exclude_reason, count(*) AS n FROM labels WHERE label = 'Exclude' GROUP BY ALL",
    "unmatched_exams": f"""WITH {_LABELS} SELECT c_mktsegment, substr(exam_date, 1, 4) AS year, count(*) AS n FROM exams JOIN customer ON c_custkey = object_id
WHERE visit_text NOT IN (SELECT visit_text FROM labels) GROUP BY ALL""",
    "text_rules": """SELECT p_partkey, p_partkey AS last_no, CAST(regexp_extract(p_partkey || p_name, '^(\\d+)', 1) AS BIGINT) AS lead_no, p_size AS visit_no,
  CAST(201801 + p_partkey % 12 AS INT) AS ym, CAST(201801 + p_partkey % 12 AS INT) AS ym_inside, CAST(201901 + p_partkey % 12 AS INT) AS ym_six, 'rec' || p_partkey || '_9h_5m' AS file_key_other, CAST(12 - p_partkey % 12 AS INT) AS months, ['CN', 'MCI', 'DEM/D', 'Unknown', 'Unknown'][p_partkey % 5 + 1] AS loose_dx,
  'id' || p_partkey || '_20180717_0905' AS file_key, p_partkey % 3 <> 0 AND p_name IS NOT NULL AS valid FROM part""",
}
QUERIES = {f.__name__: f for f in (trajectory_labels, trajectory_summary, exclude_reasons, unmatched_exams, task_catalogue, text_rules)}
