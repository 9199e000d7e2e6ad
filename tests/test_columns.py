import pytest
from pyspark.sql import functions as F

from cohortpulse import schemas as S
from cohortpulse.functions import columns as K


def test_keys_are_null_as_soon_as_one_part_is(spark):
    df = spark.createDataFrame(
        [(11, "AAA", "2013J"), (11, "AAA", None), (None, "AAA", "2013J")],
        "id_student int, code_module string, code_presentation string",
    )
    got = df.select(K.student_module_pres(), K.module_pres(), K.student_and_module()).collect()
    assert [tuple(r) for r in got] == [
        ("11-AAA-2013J", "AAA-2013J", "11AAA"),
        (None, None, "11AAA"),
        (None, "AAA-2013J", None),
    ]


def test_presentation_group_covers_22_runs_and_13_groups(spark):
    pairs = [(m, f"{y}{h}") for m in sorted({k[:3] for k in S.PRESENTATION_GROUPS}) for y in (2013, 2014) for h in "BJ"]
    df = spark.createDataFrame([*pairs, ("AAA", None), ("ZZZ", "2013J")], "code_module string, code_presentation string")
    got = {(r[0], r[1]): r[2] for r in df.withColumn("g", K.presentation_group()).collect()}
    mapped = {k: v for k, v in got.items() if v is not None}
    assert len(mapped) == 22 and sorted(set(mapped.values())) == S.GROUPS
    assert got["BBB", "2013B"] == got["BBB", "2014B"] == 1
    assert got["EEE", "2014B"] == 8 and got["GGG", "2014B"] == 12
    assert got["AAA", "2013B"] is None and got["CCC", "2013J"] is None
    assert got["AAA", None] is None and got["ZZZ", "2013J"] is None


@pytest.mark.parametrize(
    "band,decile", [("0-10%", 1), ("10-20%", 2), ("90-100%", 10), ("10-20", None), (None, None), ("?", None)]
)
def test_decile(spark, band, decile):
    df = spark.createDataFrame([(band,)], "imd_band string")
    assert df.select(K.deprivation_decile()).first()[0] == decile


def test_degree_flag_and_label(spark):
    df = spark.createDataFrame(
        [("HE Qualification", None), ("No Formal quals", "Pass"), (None, "Distinction"), ("x", "Fail")],
        "highest_education string, final_result string",
    )
    got = df.select(K.degree_flag(), K.distinction_label()).collect()
    assert [tuple(r) for r in got] == [(1, 0), (0, 0), (None, 1), (None, 0)]


def test_clean_name():
    assert K.clean_name("age_band_55<=") == "age_band_55+"
    assert K.clean_name("region_North Western Region") == "region_North_Western_Region"
    assert K.clean_name("a, b") == "a_b"


def test_percentage_rounds_half_even(spark):
    df = spark.createDataFrame([(0.12345,), (0.5,)], "x double")
    assert [r[0] for r in df.select(K.percentage(F.col("x"))).collect()] == [100.0 * 0.1234, 50.0]


def test_modelling_frame_has_53_columns():
    names = S.modelling_columns()
    assert len(names) == len(set(names)) == 53
    assert names[:3] == ["studied_credits", "total_clicks_url", "total_clicks_forumng"]
    assert names[21:24] == ["pres_groups", "dep_dec", "distinction"]
    assert names[-4:] == S.MOMENT_COLUMNS
