"""Top scorers per group, and the share of degree holders among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortpulse.functions.columns import percentage
from cohortpulse.schemas import ENROLMENT_KEYS, GROUPS

NOT_AVERAGED = (2, 4)


def cut_scores(df: DataFrame, k: int, group: str, score: str) -> DataFrame:
    """The ``k``-th best score of each group (the worst, if fewer).

    Spark limits every group to ``k`` rows per map task before the shuffle.
    """
    order = Window.partitionBy(group).orderBy(F.col(score).desc())
    best = (
        df.select(group, score)
        .where(F.col(score).isNotNull() & F.col(group).isNotNull())
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= k)
    )
    return best.groupBy(group).agg(F.min(score).alias("_cut"))


def top_with_ties(
    df: DataFrame,
    k: int = 10,
    group: str = "pres_groups",
    score: str = "avg_score",
    groups: Sequence[int] | None = GROUPS,
) -> DataFrame:
    """Rows whose score is among the ``k`` best of their group, ties included.

    Ranking the rows themselves would bring all rows tied at the cut to one
    task. Only the cut is ranked; the rows are then filtered where they are.
    With a fixed list of groups the cut table has at most one row per listed
    group and is broadcast; without one, Spark picks the join by size.
    """
    rows = df if groups is None else df.where(F.col(group).isin(list(groups)))
    cuts = cut_scores(rows, k, group, score)
    if groups is not None:
        cuts = F.broadcast(cuts)
    return rows.join(cuts, group).where(F.col(score) >= F.col("_cut")).drop("_cut")


def group_means(df: DataFrame, value: str, name: str, group: str = "pres_groups") -> DataFrame:
    """Mean per group, ignoring nulls. Integer values are averaged exactly."""
    return df.groupBy(group).agg(F.avg(value).alias(name))


def degree_share_by_group(
    df: DataFrame,
    k: int = 10,
    group: str = "pres_groups",
    score: str = "avg_score",
    flag: str = "ed_dummy",
    groups: Sequence[int] = GROUPS,
) -> DataFrame:
    """Degree share of the top ``k`` next to that of the whole group."""
    top = group_means(top_with_ties(df, k, group, score, groups), flag, "top_share", group)
    overall = group_means(df.where(F.col(group).isin(list(groups))), flag, "overall_share", group)
    return overall.join(top, group, "left").select(group, "top_share", "overall_share")


def degree_share_totals(
    df: DataFrame,
    by_group: DataFrame,
    group: str = "pres_groups",
    flag: str = "ed_dummy",
    excluded: Sequence[int] = NOT_AVERAGED,
) -> DataFrame:
    """Mean of the group shares and share over all rows, in per cent.

    The first is a mean of means over all groups but the excluded ones, null as
    soon as one of them has no share; the second averages the rows.
    """
    counted = by_group.where(~F.col(group).isin(list(excluded)))
    complete = F.count("top_share") == F.count(F.lit(1))
    top = counted.agg(F.when(complete, percentage(F.avg("top_share"))).alias("top_percent"))
    overall = df.agg(percentage(F.avg(flag)).alias("overall_percent"))
    # Two one-row results side by side, without a join.
    both = top.unionByName(overall, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("top_percent", "overall_percent")])


def average_scores(
    student_assessment: DataFrame,
    assessments: DataFrame,
    keys: Sequence[str] = ENROLMENT_KEYS,
) -> DataFrame:
    """Mean score per enrolment.

    Scores carry only the student and the assessment; module and presentation
    come from the assessment.
    """
    run = assessments.select("id_assessment", "code_module", "code_presentation")
    scores = student_assessment.select("id_student", "id_assessment", "score")
    return scores.join(run, "id_assessment").groupBy(*keys).agg(F.avg("score").alias("avg_score"))
