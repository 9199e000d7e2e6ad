import math
from collections import defaultdict
from fractions import Fraction
from random import Random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from results import executed_plan, rows
from pyspark.sql import functions as F

from cohortpulse.operators import moments as M
from cohortpulse.schemas import ENROLMENT_KEYS, MOMENT_COLUMNS

FACT = "id int, click_date int, sum_click int"


def expected(pairs):
    """Moments by definition in exact fractions; unknown counts are skipped."""
    counted = [(d, c) for d, c in pairs if c is not None]
    total = sum(c for _, c in counted)
    if total == 0:
        return (None,) * 4
    dated = [(d, c) for d, c in counted if d is not None]
    mean = Fraction(sum(d * c for d, c in dated), total)

    def central(j):
        return sum(c * (d - mean) ** j for d, c in dated) / total

    variance = central(2)
    if variance == 0:
        return (0.0, None, None, None)
    v = float(variance)
    return (
        v,
        float(central(3)) / v**1.5,
        float(central(4) / variance**2) - 3,
        math.sqrt(v) / float(mean) if mean else None,
    )


def close(got, want):
    return all(
        (g is None and w is None) or (g is not None and w is not None and math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9))
        for g, w in zip(got, want)
    )


def check(spark, data, **options):
    groups = defaultdict(list)
    for key, day, clicks in data:
        groups[key].append((day, clicks))
    got = {r[0]: tuple(r)[1:] for r in M.click_moments(spark.createDataFrame(data, FACT), ["id"], **options).collect()}
    assert got.keys() == groups.keys()
    for key, pairs in groups.items():
        assert close(got[key], expected(pairs)), (key, pairs[:5], got[key], expected(pairs))


FIXTURE = [(1, 0, 5), (1, 10, 5), (1, 20, 1), (2, 7, 3), (2, 7, 4), (3, -5, 1), (3, 5, 1), (4, 3, 0)]


@pytest.mark.parametrize("wide", [False, True])
def test_truth_table(spark, wide):
    info = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    moments = M.click_moments(spark.createDataFrame(FIXTURE, FACT), ["id"], wide=wide)
    joined = M.attach_moments(info, moments, ["id"])
    rounded = joined.select("id", *[F.round(c, 6).alias(c) for c in MOMENT_COLUMNS])
    assert rows(rounded) == [
        (1, 41.322314, 0.509117, -0.676, 1.010153),
        (2, 0.0, None, None, None),
        (3, 25.0, 0.0, -2.0, None),
        (4, None, None, None, None),
        (5, None, None, None, None),
    ]


@pytest.mark.parametrize("wide", [False, True])
def test_random_groups_with_gaps(spark, wide):
    random = Random(1)
    data = [
        (
            random.randrange(60),
            random.choice([None, *[random.randrange(-40, 270)] * 9]),
            random.choice([None, *[random.randrange(0, 90)] * 9]),
        )
        for _ in range(3000)
    ]
    check(spark, data, wide=wide)


def test_undated_clicks_weigh_in_the_divisor_only(spark):
    check(spark, [(1, 0, 2), (1, None, 2), (2, 4, 1), (2, 8, 1), (2, None, 1), (3, None, 5), (4, None, None)])


def test_far_from_the_origin(spark):
    """Narrow spread on distant days: power sums of doubles would fail here."""
    data = [(1, 20_000 + d, c) for d, c in ((0, 3), (1, 4), (2, 1))] + [(2, -20_000, 10), (2, -19_999, 1)]
    check(spark, data)
    check(spark, data, wide=True)


def test_sums_beyond_a_long(spark):
    """One hot key: each power sum exceeds 64 bits, and variance is exact."""
    n = 200_000
    df = spark.range(n).select(
        F.lit(1).alias("id"),
        (F.lit(3000) - (F.col("id") % 2)).cast("int").alias("click_date"),
        F.lit(10_000).alias("sum_click"),
    )
    assert n * 10_000 * 3000**4 > 2**63
    got = M.click_moments(df, ["id"]).first()
    assert got.click_time_variance == 0.25 and got.click_time_kurtosis == -2.0
    assert got.click_time_skewness == 0.0 and math.isclose(got.click_time_cv, 0.5 / 2999.5)


def test_a_row_beyond_a_long_raises_and_wide_sums_take_it(spark):
    data = [(1, 2_000_000, 1_000_000), (1, 2_000_010, 1_000_000)]
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        M.click_moments(spark.createDataFrame(data, FACT), ["id"]).collect()
    check(spark, data, wide=True)


def fractional(spark, data, kind="double", **options):
    """Check rows (key, day, weight) against exact fractions of the doubles."""
    groups = defaultdict(list)
    for key, day, weight in data:
        exact = [None if x is None or x != x else Fraction(x) for x in (day, weight)]
        groups[key].append(tuple(exact))
    df = spark.createDataFrame(data, "id int, click_date double, sum_click double")
    df = df.select("id", F.col("click_date").cast(kind).alias("click_date"), F.col("sum_click").cast(kind).alias("sum_click"))
    got = {r[0]: tuple(r)[1:] for r in M.click_moments(df.repartition(5), ["id"], **options).collect()}
    assert got.keys() == groups.keys()
    for key, pairs in groups.items():
        want = expected(pairs)
        assert all((g is None) == (w is None) and (g is None or math.isclose(g, w, rel_tol=1e-7, abs_tol=1e-7)) for g, w in zip(got[key], want)), (key, got[key], want)


def test_fractional_days_and_weights(spark, monkeypatch):
    random = Random(7)
    data = [(k % 40, random.choice([None, math.nan, *[random.uniform(-40, 270)] * 9]), random.choice([None, *[random.uniform(0, 9)] * 9])) for k in range(4000)]
    data += [(100, 0.1, 0.3)] * 7  # one day, whose mean no double holds
    data += [(101, 1e9 + d, 1.5) for d in (0.25, 0.5, 1.0, 8.0)] + [(102, 0.5, 0.0)] + [(103, -0.5, 2.5), (103, 0.5, 2.5)]
    data += [(104, 3.5, -1.0), (104, 4.25, 2.0), (104, 9.5, 4.0), (105, None, 2.5), (106, 2.5, 1.0), (106, None, 1.0)]
    fractional(spark, data)
    monkeypatch.setattr("cohortpulse.functions.states.HELD", 8)
    fractional(spark, data)


def test_decimal_days(spark):
    fractional(spark, [(1, 0.25, 1.5), (1, 8.5, 2.25), (2, -3.5, 1.0), (2, -3.5, 4.0)], "decimal(12,4)")


def test_integers_beyond_exact_sums(spark):
    """Microseconds: the fourth power of a day has 60 digits."""
    start = 1_700_000_000_000_000
    data = [(k % 3, start + (k * k * 7919) % 86_400_000_000, 10**6 + k) for k in range(300)]
    groups = defaultdict(list)
    for key, day, weight in data:
        groups[key].append((day, weight))
    df = spark.createDataFrame(data, "id int, click_date long, sum_click long")
    got = {r[0]: tuple(r)[1:] for r in M.click_moments(df, ["id"], floating=True).collect()}
    for key, pairs in groups.items():
        assert all(math.isclose(g, w, rel_tol=1e-6) for g, w in zip(got[key], expected(pairs)))


def test_states_merge_in_any_order(spark):
    from cohortpulse.functions import states as S

    rng = Random(3)
    day, weight = ([rng.uniform(0, 1000) for _ in range(500)], [rng.uniform(0, 5) for _ in range(500)])
    rows_ = S.row_states(S.np.array(day), S.np.array(weight))
    once = S.merged_states(rows_, S.np.zeros(500, int), 1)
    parts = S.merged_states(rows_, S.np.array([rng.randrange(9) for _ in range(500)]), 9)
    twice = S.merged_states(parts, S.np.zeros(9, int), 1)
    for name in S.STATE:
        assert math.isclose(once[name][0], twice[name][0], rel_tol=1e-9, abs_tol=1e-6)


def test_one_exchange_of_states(spark):
    df = spark.range(100_000, numPartitions=4).selectExpr("id % 10 as id", "id / 7 as click_date", "id % 3 as sum_click")
    plan = executed_plan(M.click_moments(df, ["id"]))
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_fractional_engagement(spark):
    schema = "id_site int, id_student int, code_module string, code_presentation string, click_date double, sum_click double"
    data = [(k % 5, k % 3, "AAA", "2013J", k / 8, (k % 4) / 2) for k in range(90)]
    clicks = spark.createDataFrame(data, schema)
    vle = spark.createDataFrame([(i, ["quiz", "url"][i % 2]) for i in range(4)], "id_site int, activity_type string")
    got = {r.id_student: r for r in M.engagement_totals(clicks, vle, ["quiz", "url"]).collect()}
    for student, row in got.items():
        own = [r for r in data if r[1] == student]
        assert row.total_clicks == sum(r[5] for r in own)
        assert row.total_clicks_quiz == sum(r[5] for r in own if r[0] in (0, 2))
        assert close(tuple(row)[-4:], expected([(Fraction(r[4]), Fraction(r[5])) for r in own]))


def test_text_is_refused(spark):
    df = spark.createDataFrame([(1, "0.5", 1)], "id int, click_date string, sum_click int")
    with pytest.raises(TypeError):
        M.click_moments(df, ["id"])


def test_null_keys_are_dropped(spark):
    df = spark.createDataFrame([(None, 1, 1), (1, 1, 1)], FACT)
    assert [r.id for r in M.click_moments(df, ["id"]).collect()] == [1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(-30, 300), st.integers(1, 6)), min_size=1, max_size=12),
    st.integers(-500, 500),
)
def test_weights_are_repetitions_and_shifts_keep_the_shape(spark, pairs, shift):
    data = [(1, d, c) for d, c in pairs]
    data += [(2, d, 1) for d, c in pairs for _ in range(c)]
    data += [(3, d + shift, c) for d, c in pairs]
    got = {r.id: tuple(r)[1:] for r in M.click_moments(spark.createDataFrame(data, FACT), ["id"]).collect()}
    assert got[1] == got[2]
    assert got[1][:3] == got[3][:3]


def test_fused_totals_equal_the_single_operators(spark):
    from cohortpulse.operators import clicks as C

    random = Random(2)
    schema = "id_site int, id_student int, code_module string, code_presentation string, click_date int, sum_click int"
    data = [
        (random.randrange(8), random.randrange(20), random.choice(["AAA", "BBB", None]), "2013J", random.randrange(200), random.choice([None, 1, 7]))
        for _ in range(800)
    ]
    clicks = spark.createDataFrame(data, schema)
    types = ["quiz", "url"]
    vle = spark.createDataFrame([(i, types[i % 2]) for i in range(6)], "id_site int, activity_type string")
    info = clicks.select(*ENROLMENT_KEYS).distinct().union(
        spark.createDataFrame([(99, "AAA", "2013J")], "id_student int, code_module string, code_presentation string")
    )
    fused = M.attach_engagement(info, M.engagement_totals(clicks, vle, types), types)
    single = M.attach_moments(
        C.attach_totals(C.attach_totals(info, C.total_clicks(clicks)), C.clicks_by_type(clicks, vle, types)),
        M.click_moments(clicks),
    )
    assert rows(fused.select(single.columns)) == rows(single)


@pytest.mark.parametrize("days", [(-10, -1), (-10, 9), (1, 10)])
@pytest.mark.parametrize("n", [3_000_000, 10_000_000])
def test_many_rows_of_one_key(spark, days, n):
    """A hot key whose parts of sums far exceed the sums themselves."""
    low, high = days
    day = (F.col("id") % (high - low + 1) + low).cast("int")
    df = spark.range(n).select(F.lit(1).alias("id"), day.alias("click_date"), F.lit(1).alias("sum_click"))
    once, wide = (M.click_moments(df, ["id"], wide=w).first() for w in (False, True))
    assert close(tuple(once)[1:], tuple(wide)[1:])
    spread = high - low + 1
    assert once.click_time_variance == pytest.approx((spread**2 - 1) / 12)


def test_negative_clicks_count_as_they_are(spark):
    check(spark, [(1, -3, 5), (1, 4, -2), (1, 9, 6), (2, 2, -1), (2, 1, 7), (2, 3, 4)])
    # a total near zero puts the mean far outside the days, and the variance below zero
    far = spark.createDataFrame([(3, 100, 10**9), (3, -100, 1 - 10**9)], FACT)
    mean = 100 * (2 * 10**9 - 1)
    got = M.click_moments(far, ["id"]).first()
    assert got.click_time_variance == pytest.approx(10**4 - mean**2) and got.click_time_skewness is None
