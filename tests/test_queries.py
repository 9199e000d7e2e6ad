"""Every registered query against its SQL twin, and the shape of the plans."""

import re

import pytest
from compare import connect, differences
from results import executed_plan

import __spark_entry__ as entry_point
from cohortpulse.plans import oracles
from cohortpulse.plans.queries import REGISTRY
from cohortpulse.sources.stand_ins import StandIns

FOLDER = "/root/testdata/sf0.001"
# The optional training-data operators have tests of their own.
TWINS = oracles.build()
QUERIES = REGISTRY


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_only_the_models_lack_a_twin():
    assert set(QUERIES) - set(TWINS) == {"gbt_group_report", "gbt_gain_top15"}
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, db, name):
    assert differences(QUERIES[name](spark, FOLDER), TWINS[name], db) == []


def test_entry_registers_them():
    assert QUERIES.keys() <= entry_point.queries().keys()
    assert TWINS.items() <= entry_point.oracle_sql().items()


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 1500 and "click_time_variance" in df.columns


def _nodes(plan: str, name: str) -> int:
    final = plan.split("== Initial Plan ==")[0]
    return len(re.findall(rf"\b{name}\b", final))


def test_engagement_reads_the_clickstream_once(spark):
    plan = executed_plan(QUERIES["engagement_features"](spark, FOLDER)).split("== Initial Plan ==")[0]
    assert plan.count("lineitem.parquet") == 1
    assert "Python" not in plan and "ArrowEval" not in plan


def test_moments_use_one_exchange_and_stay_in_hash_aggregation(spark):
    plan = executed_plan(QUERIES["moments_events"](spark, FOLDER))
    assert _nodes(plan, "Exchange hashpartitioning") == 1
    assert _nodes(plan, "HashAggregate") == 2
    for slow in ("SortAggregate", "ObjectHashAggregate", "Python"):
        assert slow not in plan


def test_scans_are_pruned(spark):
    plan = executed_plan(QUERIES["moments_events"](spark, FOLDER))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    assert "PushedFilters: [IsNotNull(user_id)]" in plan


def test_one_type_filter_reaches_the_lookup_before_the_join(spark):
    t = StandIns(spark, FOLDER)
    from cohortpulse.operators.clicks import clicks_of_type

    plan = executed_plan(clicks_of_type(t.student_vle, t.vle, "quiz"))
    scan = plan.index("part.parquet")
    below_join = plan[plan.rindex("BroadcastExchange", 0, scan) : scan]
    assert "Filter" in below_join and "= quiz" in below_join


def test_no_nested_loop_or_cartesian_join(spark):
    for name in ("feature_matrix", "degree_share", "degree_share_totals", "class_report"):
        plan = executed_plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
