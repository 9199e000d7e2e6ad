from results import executed_plan, rows

from cohortpulse.operators import cohort as H
from cohortpulse.operators import ranking as R

SCHEMA = "id_student string, code_module string, code_presentation string, number_of_prev_attempts int"


def test_first_attempts_choose_before_filtering(spark):
    df = spark.createDataFrame(
        [
            ("s1", "AAA", "2013J", 1),
            ("s1", "AAA", "2014J", 0),
            ("s2", "AAA", "2014J", 0),
            ("s2", "AAA", "2013J", 0),
            ("s2", "BBB", "2014B", 0),
        ],
        SCHEMA,
    )
    assert rows(H.first_attempts(df)) == [("s2", "AAA", "2013J", 0), ("s2", "BBB", "2014B", 0)]


def test_presentations_sort_by_time():
    assert sorted(["2014J", "2013J", "2014B", "2013B"]) == ["2013B", "2013J", "2014B", "2014J"]


def test_groups_are_limited_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("id % 3 as id_student", "id % 2 as code_module", "id as code_presentation")
    plan = executed_plan(H.first_of_each(df))
    assert plan.count("WindowGroupLimit") >= 2, plan
    first_limit = plan.rindex("WindowGroupLimit")
    assert first_limit > plan.rindex("Exchange hashpartitioning"), plan


def test_label_totals_and_group_filter(spark):
    df = spark.createDataFrame([(1, 2), (0, 2), (1, None)], "distinction int, pres_groups int")
    assert rows(H.label_totals(df)) == [(2, 2)]
    assert H.in_group(df, 2).count() == 2


def test_top_keeps_ties_and_skips_nulls(spark):
    df = spark.createDataFrame(
        [(0, s) for s in (9.0, 8.0, 8.0, 8.0, 7.0, None)] + [(1, 5.0), (1, None), (None, 99.0)],
        "pres_groups int, avg_score double",
    )
    want = [(0, 8.0), (0, 8.0), (0, 8.0), (0, 9.0), (1, 5.0)]
    assert rows(R.top_with_ties(df, 2)) == want
    assert rows(R.top_with_ties(df, 2, groups=None)) == want


def test_top_with_a_hot_tied_group(spark):
    """Rows tied at the cut stay where they are: the rows are never exchanged."""
    df = spark.range(30_000).selectExpr("cast(id % 3 as int) as pres_groups", "100.0d as avg_score", "id")
    top = R.top_with_ties(df)
    plan = executed_plan(top)
    assert top.count() == 30_000
    big_side = plan[: plan.index("BroadcastQueryStage")] if "BroadcastQueryStage" in plan else plan
    assert "Exchange hashpartitioning" not in big_side


def test_degree_share(spark):
    data = [(0, 9.0, 1), (0, 8.0, 0), (0, 1.0, 0), (2, 5.0, 1), (3, 4.0, 1), (3, 4.0, None), (None, 7.0, 0)]
    df = spark.createDataFrame(data, "pres_groups int, avg_score double, ed_dummy int")
    by_group = R.degree_share_by_group(df, k=2)
    assert rows(by_group) == [(0, 0.5, 1 / 3), (2, 1.0, 1.0), (3, 1.0, 1.0)]
    # Group 2 is not averaged; the second figure is over all rows.
    assert rows(R.degree_share_totals(df, by_group)) == [(75.0, 50.0)]


def test_degree_share_is_null_when_a_group_has_none(spark):
    df = spark.createDataFrame([(0, 9.0, 1), (1, None, 1)], "pres_groups int, avg_score double, ed_dummy int")
    totals = R.degree_share_totals(df, R.degree_share_by_group(df))
    assert rows(totals) == [(None, 100.0)]


def test_average_scores_take_the_run_from_the_assessment(spark):
    scores = spark.createDataFrame(
        [(1, 7, 50.0), (1, 7, 70.0), (1, 8, None), (2, 8, None), (3, 99, 10.0)],
        "id_student int, id_assessment int, score double",
    )
    runs = spark.createDataFrame(
        [(7, "AAA", "2013J"), (8, "AAA", "2013J")],
        "id_assessment int, code_module string, code_presentation string",
    )
    assert rows(R.average_scores(scores, runs)) == [(1, "AAA", "2013J", 60.0), (2, "AAA", "2013J", None)]
