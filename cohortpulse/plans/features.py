"""The feature table from the base tables, as one declarative plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cohortpulse.operators.cohort import (
    first_attempts,
    with_degree_flag,
    with_deprivation_decile,
    with_enrolment_keys,
    with_label,
    with_presentation_group,
)
from cohortpulse.operators.encode import modelling_frame, one_hot
from cohortpulse.operators.moments import attach_engagement, engagement_totals
from cohortpulse.schemas import ACTIVITY_TYPES, ENROLMENT_KEYS


def described_first_attempts(
    info: DataFrame, order_by: Sequence[str] = ("code_presentation",)
) -> DataFrame:
    """First attempts with keys, group, decile, degree flag and label."""
    first = first_attempts(info, order_by=order_by)
    described = with_presentation_group(with_enrolment_keys(first))
    return with_label(with_degree_flag(with_deprivation_decile(described)))


def feature_table(
    info: DataFrame,
    clicks: DataFrame,
    vle: DataFrame,
    vocabulary: Sequence[str] = ACTIVITY_TYPES,
    order_by: Sequence[str] = ("code_presentation",),
) -> DataFrame:
    """First attempts with click totals, moments and dummies.

    First attempts are chosen before the engagement join, which then carries
    fewer rows; the join adds columns only, so the order does not matter.
    """
    first = described_first_attempts(info, order_by)
    totals = engagement_totals(clicks, vle, vocabulary)
    return one_hot(attach_engagement(first, totals, vocabulary))


def modelling_table(
    info: DataFrame,
    clicks: DataFrame,
    vle: DataFrame,
    order_by: Sequence[str] = ("code_presentation",),
    keep: Sequence[str] = ENROLMENT_KEYS,
) -> DataFrame:
    """Identifiers followed by the 53 modelling columns."""
    return modelling_frame(feature_table(info, clicks, vle, order_by=order_by), keep=keep)
