"""Stored sums that increments are added to, and clicks stored by key."""

from random import Random

import pytest
from pyspark.sql import functions as F
from results import executed_plan, rows

from cohortpulse.operators import clicks as C
from cohortpulse.operators import incremental as I
from cohortpulse.operators import moments as M
from cohortpulse.schemas import ENROLMENT_KEYS
from cohortpulse.sources.sinks import write_bucketed

TYPES = ["quiz", "url"]
SCHEMA = "id_site int, id_student int, code_module string, code_presentation string, click_date int, sum_click int, activity_type string"


@pytest.fixture(scope="module")
def typed(spark):
    random = Random(4)
    data = [
        (k, random.randrange(40), random.choice(["AAA", "BBB", None]), "2013J", random.choice([None, *range(-30, 90)]), random.choice([None, 0, 1, 7]), random.choice([*TYPES, "other", None]))
        for k in range(3000)
    ]
    return spark.createDataFrame(data, SCHEMA).cache()


def whole(typed):
    return rows(M.finish_engagement(M.engagement_sums(typed, TYPES), TYPES), *ENROLMENT_KEYS)


def state(spark, path):
    found = I.engagement_from_state(spark, path, TYPES)
    return rows(found, *ENROLMENT_KEYS)


def add(path, typed, batch, part):
    return I.add_increment(path, typed.where(part), batch, TYPES, folders=8)


def test_base_and_increments_equal_the_whole(spark, typed, tmp_path):
    path = str(tmp_path)
    site = F.col("id_site")
    assert add(path, typed, 0, site < 2000) and add(path, typed, 1, (site >= 2000) & (site < 2020)) and add(path, typed, 5, site >= 2020)
    assert state(spark, path) == whole(typed)
    assert I.applied_batches(spark, path) == [0, 1, 5]
    # repeated, and late
    assert not add(path, typed, 1, (site >= 2000) & (site < 2020))
    assert state(spark, path) == whole(typed)
    with pytest.raises(ValueError, match="comes after"):
        add(path, typed, 3, site < 10)
    assert add(path, typed, 6, F.lit(False)) and state(spark, path) == whole(typed)


def test_an_increment_cut_short_is_finished(spark, typed, tmp_path):
    """The driver is lost after some folders were written and before it is listed."""
    path = str(tmp_path)
    site = F.col("id_site")
    add(path, typed, 0, site < 1500)
    for part in (F.col("id_student") % 3 == 0, F.lit(True)):
        add(path, typed, 1, (site >= 1500) & part)
        spark.createDataFrame([(0,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/applied")
    add(path, typed, 1, site >= 1500)
    assert state(spark, path) == whole(typed)


def test_only_touched_folders_are_written(spark, typed, tmp_path):
    path = str(tmp_path)
    add(path, typed, 0, F.lit(True))

    def files():
        return {f.relative_to(tmp_path / "state").parts[0]: f.name for f in (tmp_path / "state").rglob("*.parquet")}

    before = files()
    add(path, typed, 1, (F.col("id_student") == 3) & (F.col("code_module") == "AAA"))
    after = files()
    assert before.keys() == after.keys() and sum(before[k] != after[k] for k in before) == 1
    assert "Exchange" not in executed_plan(I.engagement_from_state(spark, path, TYPES))


def test_fractional_sums_are_refused(spark, typed, tmp_path):
    with pytest.raises(TypeError):
        I.add_increment(str(tmp_path), typed.withColumn("sum_click", F.lit(0.5)), 0, TYPES)


def test_bucketed_clicks_need_no_exchange(spark, typed, tmp_path, setting):
    setting(spark__sql__autoBroadcastJoinThreshold="-1")
    stored = write_bucketed(typed, "clicks_by_key", ENROLMENT_KEYS, 4, str(tmp_path / "t"))
    try:
        assert len(list((tmp_path / "t").glob("*.parquet"))) <= 4
        for found in (
            M.finish_engagement(M.engagement_sums(stored, TYPES), TYPES),
            C.total_clicks(stored),
            M.click_moments(stored),
            stored.groupBy(*ENROLMENT_KEYS, "activity_type").agg(F.sum("sum_click").alias("n")),
        ):
            assert "Exchange" not in executed_plan(found)
        assert rows(M.finish_engagement(M.engagement_sums(stored, TYPES), TYPES), *ENROLMENT_KEYS) == whole(typed)
        # a join with the aggregate moves the enrolments only
        info = typed.select(*ENROLMENT_KEYS).distinct()
        joined = executed_plan(C.attach_totals(info, C.total_clicks(stored)))
        assert joined.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 2
    finally:
        spark.sql("drop table clicks_by_key")


def test_sparse_totals_of_five_thousand_types(spark):
    n = 5000
    vle = spark.range(n).select(F.col("id").cast("int").alias("id_site"), F.concat(F.lit("t"), "id").alias("activity_type"))
    clicks = spark.range(4 * n).select(
        (F.col("id") % n).cast("int").alias("id_site"), (F.col("id") % 7).alias("id_student"), F.lit("AAA").alias("code_module"),
        F.lit("2013J").alias("code_presentation"), F.when(F.col("id") % 11 != 0, F.col("id") % 5).alias("sum_click"),
    )
    with pytest.raises(ValueError, match="more than"):
        C.activity_vocabulary(vle)
    totals = C.clicks_by_type_long(clicks, vle)
    got = {(r.id_student, r.activity_type): r.total_clicks for r in totals.collect()}
    want = {}
    for k in range(4 * n):
        clicked = None if k % 11 == 0 else k % 5
        before = want.get((k % 7, f"t{k % n}"))
        want[k % 7, f"t{k % n}"] = before if clicked is None else clicked + (before or 0)
    assert got == want and len({t for _, t in got}) == n
    maps = C.clicks_by_type_map(totals)
    row = maps.where("id_student = 3").select("*", C.clicks_on("t3").alias("a"), C.clicks_on("t4").alias("b"), C.clicks_on("nothing").alias("c")).first()
    assert row.clicks_by_type == {t: v for (s, t), v in want.items() if s == 3}
    assert row.a == want[3, "t3"] and row.b == want.get((3, "t4"), 0) and row.c == 0
    # the wide form of few types says the same
    few = vle.where("id_site < 3")
    wide = {r.id_student: r for r in C.clicks_by_type(clicks, few, ["t0", "t1", "t2"]).collect()}
    some = C.clicks_by_type_map(C.clicks_by_type_long(clicks, few)).select("id_student", *[C.clicks_on(f"t{k}").alias(f"t{k}") for k in range(3)])
    assert all(tuple(r)[1:] == (wide[r.id_student].total_clicks_t0, wide[r.id_student].total_clicks_t1, wide[r.id_student].total_clicks_t2) for r in some.collect())
