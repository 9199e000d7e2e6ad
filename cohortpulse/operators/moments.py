"""Click-time moments per enrolment and the fused engagement features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortpulse.functions.moments import moments_of_sums, power_sum_aggregates
from cohortpulse.functions.states import moment_states, moments_of_states
from cohortpulse.operators.clicks import (
    attach_totals,
    finish_type_totals,
    left_join_totals,
    type_total_aggregates,
    with_activity_type,
)
from cohortpulse.schemas import ENROLMENT_KEYS, MOMENT_COLUMNS, click_column

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _integral(df: DataFrame, *columns: str) -> bool:
    """Whether the columns are integers; other numbers take mergeable states."""
    kinds = {name: df.schema[name].dataType for name in columns}
    for name, kind in kinds.items():
        if not isinstance(kind, T.NumericType):
            raise TypeError(f"{name} must be a numeric column, got {kind.simpleString()}")
    return all(isinstance(kind, INTEGRAL) for kind in kinds.values())


def _with_all_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose grouping keys are all present; moments skip the others."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def click_moments(
    clicks: DataFrame,
    keys: Sequence[str] = ENROLMENT_KEYS,
    day: str = "click_date",
    weight: str = "sum_click",
    wide: bool = False,
    floating: bool | None = None,
) -> DataFrame:
    """Weighted variance, skewness, excess kurtosis and CV of the click day.

    One aggregate with map-side combining: a key holding any share of the rows
    leaves each map task as a single row. Integers are summed exactly. Fractional days
    or weights, and with ``floating`` integers too large for any exact sum, go through
    mergeable states in doubles.
    """
    given = _with_all_keys(clicks.select(*keys, day, weight), keys)
    integral = _integral(clicks, day, weight)
    if floating or (floating is None and not integral):
        return moments_of_states(moment_states(given, keys, day, weight))
    if not integral:
        raise TypeError(f"{day} and {weight} must be integers for exact sums")
    sums = (
        given.groupBy(*keys)
        .agg(*power_sum_aggregates(day, weight, wide))
    )
    return moments_of_sums(sums, wide)


def attach_moments(
    info: DataFrame,
    moments: DataFrame,
    keys: Sequence[str] = ENROLMENT_KEYS,
    unique_info: bool = True,
) -> DataFrame:
    """Left join moments onto enrolments; null without clicks."""
    return left_join_totals(info, moments.select(*keys, *MOMENT_COLUMNS), keys, unique_info)


def engagement_sums(
    typed: DataFrame,
    vocabulary: Sequence[str],
    keys: Sequence[str] = ENROLMENT_KEYS,
    day: str = "click_date",
    weight: str = "sum_click",
    activity: str = "activity_type",
    wide: bool = False,
) -> DataFrame:
    """Additive sums per enrolment of clicks with their activity type: totals, totals per
    type and power sums. :func:`finish_engagement` makes features of them."""
    if not _integral(typed, day, weight):
        raise TypeError(f"{day} and {weight} must be integers for sums that add up exactly")
    return (
        _with_all_keys(typed, keys)
        .groupBy(*keys)
        .agg(
            F.sum(weight).alias("total_clicks"),
            *type_total_aggregates(vocabulary, weight, activity),
            *power_sum_aggregates(day, weight, wide),
        )
    )


def finish_engagement(sums: DataFrame, vocabulary: Sequence[str], wide: bool = False) -> DataFrame:
    """Totals, totals per type and moments from their sums."""
    return moments_of_sums(finish_type_totals(sums, vocabulary), wide)


def engagement_totals(
    clicks: DataFrame,
    vle: DataFrame,
    vocabulary: Sequence[str],
    keys: Sequence[str] = ENROLMENT_KEYS,
    site: str = "id_site",
    day: str = "click_date",
    weight: str = "sum_click",
    activity: str = "activity_type",
    wide: bool = False,
) -> DataFrame:
    """Total, per-type totals and moments from one scan and one shuffle.

    Fractional days or weights take a second scan for their moments.
    """
    typed = with_activity_type(clicks.select(*keys, site, day, weight), vle, site, activity)
    if _integral(clicks, day, weight):
        return finish_engagement(engagement_sums(typed, vocabulary, keys, day, weight, activity, wide), vocabulary, wide)
    sums = [F.sum(weight).alias("total_clicks"), *type_total_aggregates(vocabulary, weight, activity)]
    totals = finish_type_totals(_with_all_keys(typed, keys).groupBy(*keys).agg(*sums), vocabulary)
    return totals.join(click_moments(clicks, keys, day, weight), list(keys))


def attach_engagement(
    info: DataFrame,
    totals: DataFrame,
    vocabulary: Sequence[str],
    keys: Sequence[str] = ENROLMENT_KEYS,
    unique_info: bool = True,
) -> DataFrame:
    """Enrolments with fused totals: clicks default to 0, moments to null."""
    defaults = ["total_clicks", *[click_column(t) for t in vocabulary]]
    return attach_totals(info, totals, keys, defaults, unique_info)
