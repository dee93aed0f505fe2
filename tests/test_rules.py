"""Scalar rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cohortline.functions import rules, text
from cohortline.operators import trajectory


def one(spark, value, kind="string", **columns):
    row = spark.createDataFrame([(value,)], f"c {kind}").select(*[f(F.col("c")).alias(k) for k, f in columns.items()]).head()
    return row[0] if len(columns) == 1 else row


@pytest.mark.parametrize("value", ["", " NaN ", "missing", "없음", "진단중", None, "<missing>"])
def test_invalid_text(spark, value):
    assert one(spark, value, x=text.valid_text) is False


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.last_number, "AB-0012-345", 345), (text.last_number, "none", None), (text.leading_number, "12ab", 12), (text.leading_number, "ab", None),
        (text.visit_number, "12-3", 3), (text.visit_number, "3", None),
        (text.year_month, "2018-07-17", 201807), (text.year_month, "2018/7", 201807), (text.year_month, "201807", 201807), (text.year_month, "x", None), (text.year_month, None, None),
        (text.file_key, "ID12-2018y-07m_17d_9h_5m.TXT", "id12_20180717_0905"), (text.file_key, " A.txt", "a"),
        (text.year_month, "exam 2018-07-17", 201807), (text.year_month, "visit 201807", 201807), (text.year_month, "201807abc", 201807), (text.year_month, "2018.7.", 201807),
        (text.file_key, "x id7-2018y-07m_17d_19h_5m b.txt", "id7_20180717_1905"), (text.file_key, "Rec 1_B_raw.txt", "rec1"), (text.file_key, "rec-raw", "rec"), (text.file_key, "r(a b)_9h_5m_12s_", "r_9h_5m"),
        (text.strict_diagnosis, "normal", "CN"), (text.strict_diagnosis, "aMCI", "MCI"), (text.strict_diagnosis, "AD", "DEM/D"), (text.strict_diagnosis, "NOS", "NOS"),
        (text.strict_diagnosis, "scd ", "SCD"), (text.strict_diagnosis, "XYZ", "Unknown"), (text.strict_diagnosis, None, "Unknown"), (text.strict_diagnosis, "진단중", "Unknown"),
        (text.loose_diagnosis, "NOS", "Unknown"), (text.loose_diagnosis, "DEMENTED", "DEM/D"), (text.loose_diagnosis, "NORMAL", "Unknown"),
        (text.split_list, " a, ,b", ["a", "b"]),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, x=f) == want


def test_sequences(spark):
    d = one(spark, "1차 : 201703, 2차 : 없음, 3차 : 201909", x=text.parse_dates)
    assert [tuple(x) for x in d] == [(1, 1, 201703), (2, 3, 201909)]
    d = one(spark, "1차 : CN, 2차 : DEM/D", x=text.parse_diagnoses)
    assert [tuple(x) for x in d] == [(1, 1, "CN"), (2, 2, "DEM")]
    assert one(spark, 201901, "int", x=lambda c: text.month_distance(c, F.lit(201811))) == 2


@pytest.mark.parametrize(
    ("path", "label", "subtype"),
    [
        (("CN", "CN", "CN"), "Maintain", "CN_Stable"), (("MCI", "MCI", "MCI"), "Exclude", "Exclude"), ((None, "CN", "CN"), "Exclude", "Exclude"),
        (("CN", "CN", "MCI"), "Declining", "CN_to_CN__CN_to_MCI"), ((None, "MCI", "DEM/D"), "Declining", "MCI_to_DEM/D"), (("MCI", "CN", "CN"), "Exclude", "Exclude"),
        (("CN", "SCD", "MCI"), "Exclude", "Exclude"), (("CN", "CN", "NOS"), "Exclude", "Exclude"), ((None, "CN", None), "Exclude", "Exclude"), (("CN", "NOS", "CN"), "Exclude", "Exclude"),
    ],
)
def test_trajectory(spark, path, label, subtype):
    a, b, c = path
    row = spark.range(1).select(rules.classify_trajectory(F.lit(a), F.lit(b), F.lit(c), F.lit(a is not None), F.lit(c is not None)).alias("x")).head()["x"]
    assert (row["label"], row["subtype"]) == (label, subtype)


def test_every_path_has_a_label(spark):
    names = ["CN", "SCD", "MCI", "DEM/D", "NOS", "Unknown", None]
    rows = spark.createDataFrame([(a, b, c) for a in names for b in names[:-1] for c in names], "a string, b string, c string")
    out = rows.select(rules.classify_trajectory(F.col("a"), F.col("b"), F.col("c"), F.col("a").isNotNull(), F.col("c").isNotNull()).alias("x")).select("x.*")
    assert out.filter("label IS NULL OR subtype IS NULL OR reason IS NULL OR reason = ''").count() == 0


def test_nearest_entry_takes_the_first_of_equals(spark):
    h = spark.createDataFrame([("S-1", "1차 : 201805, 2차 : 201807", "1차 : CN, 2차 : MCI", 1), ("S-1", "1차 : 201806, 2차 : 201806", "1차 : MCI, 2차 : MCI", 2)], "subject string, date_seq string, dx_seq string, source_row int")
    e = spark.createDataFrame([(1, 201806), (1, 201901), (2, 201806), (None, 201806)], "object_id long, yyyymm int")
    out = trajectory.label_trajectories(e, trajectory.first_history(h, "subject", "source_row")).collect()
    assert [(r["yyyymm"], r["current_visit"], r["month_difference"], r["strict_subtype"]) for r in out] == [(201806, 1, 1, "CN_to_MCI")]


def test_filter_on_labels_stays_above_them(spark):
    h = spark.createDataFrame([("S-1", "1차 : 201805, 1차 : 201806, 2차 : 201905", "1차 : CN, 1차 : NOS, 2차 : MCI", 1)], "subject string, date_seq string, dx_seq string, source_row int")
    e = spark.createDataFrame([(1, 201805), (1, 201806)], "object_id long, yyyymm int")
    out = trajectory.label_trajectories(e, trajectory.first_history(h, "subject", "source_row"))
    left = out.filter("NOT include_final")
    assert [(r["yyyymm"], r["exclude_reason"]) for r in left.collect()] == [(201806, "Invalid current diagnosis")]
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (out, left)]
    assert len(plans[1]) < 1.1 * len(plans[0])  # with the rules written out in the filter it was many times as long


def test_simple_subtype(spark):
    f = lambda a, b, c: spark.range(1).select(rules.simplify_subtype(F.lit(a), F.lit(b), F.lit(c)).alias("x")).head()["x"]
    assert f("Declining", "SCD_to_MCI__MCI_to_DEM/D", "MCI") == "Decline_to_MCI"
    assert f("Maintain", "SCD_Stable", "SCD") == "Maintain_SCD"
    assert f("Exclude", "Exclude", "CN") == "Other"


@pytest.mark.parametrize(
    ("name", "group", "kind"),
    [("ch1_theta_alpha_ratio_med", "ThetaAlphaRatio", "log"), ("ch1_ch2_corr_mean", "Connectivity", "atanh"), ("ch1_ch2_corr_std", "Connectivity", "log"), ("ch1_sef95_std", "SEF", "log"), ("x", "Other", "none")],
)
def test_feature_names(spark, name, group, kind):
    assert one(spark, name, x=rules.feature_group) == group
    assert rules.transform_kind(name) == kind
