from collections import defaultdict
from random import Random

import pytest
from results import executed_plan, rows
from pyspark.sql import functions as F

from cohortpulse.operators import clicks as C
from cohortpulse.schemas import ENROLMENT_KEYS

CLICKS = "id_site int, id_student int, code_module string, code_presentation string, click_date int, sum_click int"
TYPES = ["forumng", "quiz", "url"]


@pytest.fixture
def vle(spark):
    return spark.createDataFrame(
        [(1, "forumng"), (2, "quiz"), (3, "url"), (4, None)], "id_site int, activity_type string"
    )


@pytest.fixture
def clicks(spark):
    return spark.createDataFrame(
        [
            (1, 10, "AAA", "2013J", 0, 5),
            (1, 10, "AAA", "2013J", 1, 2),
            (2, 10, "AAA", "2013J", 1, None),
            (4, 10, "AAA", "2013J", 1, 3),
            (9, 10, "AAA", "2013J", 1, 4),
            (2, 11, "AAA", "2013J", 1, None),
            (2, 13, None, "2013J", 1, 8),
        ],
        CLICKS,
    )


@pytest.fixture
def info(spark):
    return spark.createDataFrame(
        [(10, "AAA", "2013J"), (11, "AAA", "2013J"), (12, "AAA", "2013J"), (13, None, "2013J")],
        "id_student int, code_module string, code_presentation string",
    )


def test_unknown_site_has_no_type_and_keeps_its_row(clicks, vle):
    got = C.with_activity_type(clicks, vle)
    assert got.count() == clicks.count()
    assert [r.activity_type for r in got.where("id_site = 9").collect()] == [None]


def test_total_defaults_to_zero_but_all_null_stays_null(info, clicks):
    got = rows(C.attach_totals(info, C.total_clicks(clicks)).select("id_student", "total_clicks"))
    assert got == [(10, 14), (11, None), (12, 0), (13, 0)]


def test_pivot_default_zero_against_null(info, clicks, vle):
    totals = C.clicks_by_type(clicks, vle, TYPES)
    got = rows(
        C.attach_totals(info, totals).select("id_student", *[C.click_column(t) for t in TYPES])
    )
    # 'url' is never clicked; 'quiz' has only null counts.
    assert got == [(10, 7, None, 0), (11, 0, None, 0), (12, 0, 0, 0), (13, 0, 0, 0)]


def test_one_type_equals_its_pivot_column(info, clicks, vle):
    for t in TYPES:
        one = C.attach_totals(info, C.clicks_of_type(clicks, vle, t))
        pivot = C.attach_totals(info, C.clicks_by_type(clicks, vle, TYPES)).select(one.columns)
        assert rows(one) == rows(pivot)


def test_more_types_than_one_mask_holds(spark):
    types = [f"t{i:03}" for i in range(130)]
    vle = spark.createDataFrame(list(enumerate(types)), "id_site int, activity_type string")
    random = Random(3)
    data = [
        (random.randrange(130), random.randrange(4), "AAA", "2013J", 0, random.choice([None, 1, 2]))
        for _ in range(600)
    ]
    got = C.clicks_by_type(spark.createDataFrame(data, CLICKS), vle, types).collect()
    want = defaultdict(list)
    for site, student, *_, count in data:
        want[student, types[site]].append(count)
    for r in got:
        for t in types:
            seen = want.get((r.id_student, t))
            known = [c for c in seen or [] if c is not None]
            expected = 0 if seen is None else (sum(known) if known else None)
            assert r[C.click_column(t)] == expected, (r.id_student, t)


@pytest.mark.parametrize("odd", ["a.b c", "back`tick", "it's", 'say "x"', "back\\slash", "100%", ""])
def test_type_with_odd_characters(spark, odd):
    vle = spark.createDataFrame([(1, odd), (2, "quiz")], "id_site int, activity_type string")
    clicks = spark.createDataFrame([(1, 10, "AAA", "2013J", 0, 5), (2, 10, "AAA", "2013J", 0, 1)], CLICKS)
    got = C.clicks_by_type(clicks, vle, [odd, "quiz"]).first()
    assert got[C.click_column(odd)] == 5 and got["total_clicks_quiz"] == 1


def test_totals_per_type_add_up(spark):
    random = Random(5)
    vle = spark.createDataFrame([(i, TYPES[i % 3]) for i in range(9)], "id_site int, activity_type string")
    data = [
        (random.randrange(9), random.randrange(5), "AAA", "2013J", random.randrange(90), random.randrange(9))
        for _ in range(400)
    ]
    clicks = spark.createDataFrame(data, CLICKS)
    both = C.total_clicks(clicks).join(C.clicks_by_type(clicks, vle, TYPES), ENROLMENT_KEYS)
    added = sum((F.col(C.click_column(t)) for t in TYPES[1:]), F.col(C.click_column(TYPES[0])))
    assert both.where(F.col("total_clicks") != added).count() == 0


def test_activity_counts_keep_the_null_group(clicks, vle):
    got = {r.activity_type: (r.n_rows, r.n_clicks) for r in C.activity_counts(clicks, vle).collect()}
    assert got == {"forumng": (2, 7), "quiz": (3, 8), None: (2, 7)}


def test_vocabulary(vle):
    assert C.activity_vocabulary(vle) == TYPES
    with pytest.raises(ValueError):
        C.activity_vocabulary(vle, limit=2)


def test_default_columns(info):
    got = C.with_default_columns(info, ["a", "b"])
    assert got.columns[-2:] == ["a", "b"] and got.schema["a"].dataType.simpleString() == "int"
    assert {tuple(r) for r in got.select("a", "b").collect()} == {(0, 0)}


def test_hot_site_is_split_when_the_lookup_cannot_be_broadcast(spark, setting):
    setting(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4000",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="8000",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__shuffle__partitions="16",
    )
    # A third of the rows lie on site 0.
    clicks = spark.range(0, 120_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).cast("int").alias("id_site"),
        F.col("id").alias("id_student"),
        F.lit(1).alias("sum_click"),
    )
    vle = spark.range(1000).select(F.col("id").cast("int").alias("id_site"), F.lit("quiz").alias("activity_type"))
    typed = C.with_activity_type(clicks, vle)
    summed = typed.groupBy("activity_type").agg(F.sum("id_student").alias("s"))
    assert "skew=true" in executed_plan(summed)
    assert rows(summed) == [("quiz", 120_000 * 119_999 // 2)]


def test_repeated_enrolment_key_is_split(spark, setting):
    setting(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4000",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="8000",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__shuffle__partitions="16",
    )
    info = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("row")
    )
    clicks = spark.range(0, 5_000, 1, 4).select((F.col("id") % 400).alias("k"), F.lit(2).alias("sum_click"))
    totals = C.total_clicks(clicks, ["k"])
    split = C.attach_totals(info, totals, ["k"], unique_info=False)
    assert "skew=true" in executed_plan(split)
    assert split.columns == ["k", "row", "total_clicks"]
    assert rows(split, "row") == rows(C.attach_totals(info, totals, ["k"]), "row")
