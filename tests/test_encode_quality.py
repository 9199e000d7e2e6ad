import pytest
from results import rows

from cohortpulse.operators import encode as E
from cohortpulse.operators import quality as Q
from cohortpulse.schemas import STUDENT_INFO, length_limits


def test_one_hot_of_null_and_unlisted(spark):
    df = spark.createDataFrame([(1, "F"), (2, "M"), (3, None), (4, "X")], "id int, gender string")
    got = E.one_hot(df, {"gender": ["M", "F"]})
    assert got.columns == ["id", "gender_F", "gender_M"]
    assert rows(got) == [(1, 1, 0), (2, 0, 1), (3, 0, 0), (4, 0, 0)]
    assert "gender" in E.one_hot(df, {"gender": ["M"]}, keep_source=True).columns


def test_observed_categories(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "x")], "p string, q string")
    assert E.observed_categories(df, ["p", "q"]) == {"p": ["a", "b"], "q": ["x"]}
    with pytest.raises(ValueError):
        E.observed_categories(df, ["p", "q"], limit=2)


def test_clean_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`age_band_55<=` int, `region_North Western Region` int")
    assert E.clean_columns(df).columns == ["age_band_55+", "region_North_Western_Region"]


def test_modelling_frame_refuses_an_absent_column(spark):
    with pytest.raises(Exception):
        E.modelling_frame(spark.createDataFrame([(1,)], "studied_credits int"))


def test_non_zero_columns(spark):
    df = spark.createDataFrame(
        [(1, 0, None, False, 0.0), (1, 0, None, False, 3.0), (2, 5, 1.0, True, 0.0)],
        "g int, zero int, gone double, no boolean, mixed double",
    )
    kept = E.non_zero_columns(df, ["zero", "gone", "no", "mixed"], "g")
    assert kept == {1: ["gone", "mixed"], 2: ["zero", "gone", "no"]}
    assert rows(E.non_zero_flags(df, ["zero", "gone"])) == [(1, 1)]
    with pytest.raises(ValueError):
        E.non_zero_columns(df, ["zero"], "g", limit=1)


def test_fill_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,)], "x double")
    assert rows(E.fill_missing(df, ["x"], fill=-1.0)) == [(-1.0, 1), (-1.0, 1), (2.0, 0)]


def test_key_violations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (3, None), (3, None)], "k int, m string")
    got = {(r.k, r.m): (r.n_rows, r.problem) for r in Q.key_violations(df, ["k", "m"]).collect()}
    assert got == {(1, "a"): (2, "duplicate key"), (None, "b"): (1, "null key"), (3, None): (2, "null key")}


def test_orphans_skip_null_keys(spark):
    child = spark.createDataFrame([(1,), (7,), (7,), (None,)], "id_site int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "site int")
    assert rows(Q.orphans(child, parent, ["id_site"], ["site"])) == [(7, 2)]


def test_overlong(spark):
    df = spark.createDataFrame([("FEMALE", "N"), ("F", None)], "gender string, disability string")
    limits = {c: n for c, n in length_limits(STUDENT_INFO).items() if c in df.columns}
    assert limits == {"gender": 3, "disability": 3}
    assert rows(Q.overlong(df, limits)) == [("disability", 3, 0, 1), ("gender", 3, 1, 6)]
    assert [r.gender for r in Q.overlong_rows(df, limits).collect()] == ["FEMALE"]
    assert rows(Q.overlong(df.limit(0), {"gender": 3})) == [("gender", 3, 0, None)]


def test_all_declared_keys_and_references(spark):
    run = "code_module string, code_presentation string"
    info = spark.createDataFrame([(1, "A", "x"), (1, "A", "x"), (None, "A", "x"), (2, "A", None)], f"id_student int, {run}")
    courses = spark.createDataFrame([("A", "x"), ("B", "x")], run)
    tests = spark.createDataFrame([(7, "A", "x"), (8, "C", "x")], f"id_assessment int, {run}")
    scores = spark.createDataFrame([(1, 7), (5, 7), (1, 9), (None, 8)], "id_student int, id_assessment int")
    tables = {"courses": courses, "studentInfo": info, "assessments": tests, "studentAssessment": scores}
    assert rows(Q.check_keys(tables)) == [
        ("studentInfo", "1-A-x", 2, "duplicate key"),
        ("studentInfo", "2-A-NULL", 1, "null key"),
        ("studentInfo", "NULL-A-x", 1, "null key"),
    ]
    assert rows(Q.check_references(tables)) == [
        ("assessments(code_module,code_presentation)->courses", "C-x", 1),
        ("studentAssessment(id_assessment)->assessments", "9", 1),
        ("studentAssessment(id_student,code_module,code_presentation)->studentInfo", "5-A-x", 1),
    ]
