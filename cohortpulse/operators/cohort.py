"""Enrolment-level derivations: keys, groups, first attempts, the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortpulse.functions.columns import (
    degree_flag,
    deprivation_decile,
    distinction_label,
    module_pres,
    presentation_group,
    student_and_module,
    student_module_pres,
)


def with_enrolment_keys(info: DataFrame) -> DataFrame:
    """Concatenated identifiers of an enrolment."""
    return info.withColumns(
        {
            "student_module_pres": student_module_pres(),
            "module_pres": module_pres(),
            "student_and_module": student_and_module(),
        }
    )


def with_presentation_group(df: DataFrame) -> DataFrame:
    """Presentation group; works on enrolments and on the clickstream."""
    return df.withColumn("pres_groups", presentation_group())


def with_deprivation_decile(info: DataFrame) -> DataFrame:
    return info.withColumn("dep_dec", deprivation_decile())


def with_degree_flag(info: DataFrame) -> DataFrame:
    return info.withColumn("ed_dummy", degree_flag())


def with_label(info: DataFrame) -> DataFrame:
    return info.withColumn("distinction", distinction_label())


def first_of_each(
    df: DataFrame,
    subset: Sequence[str] = ("id_student", "code_module"),
    order_by: Sequence[str] = ("code_presentation",),
) -> DataFrame:
    """The first row of every ``subset`` group in the given order.

    Presentation codes sort chronologically. ``order_by`` must settle every
    tie for a repeatable result. Spark limits each group to one row before the
    shuffle, so a hot group costs one row per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*subset).orderBy(*order_by))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_attempts(
    info: DataFrame,
    subset: Sequence[str] = ("id_student", "code_module"),
    order_by: Sequence[str] = ("code_presentation",),
    attempts: str = "number_of_prev_attempts",
) -> DataFrame:
    """Earliest row per student and module, if it is a first attempt.

    The earliest row is chosen before the filter: a student whose earliest row
    is already a repeat drops out and is not replaced by a later row.
    """
    return first_of_each(info, subset, order_by).where(F.col(attempts) == 0)


def in_group(df: DataFrame, group: int, column: str = "pres_groups") -> DataFrame:
    """One presentation group; prunes partitions of a table written by group."""
    return df.where(F.col(column) == group)


def label_totals(df: DataFrame, group: int = 2) -> DataFrame:
    """Number of distinctions and of rows in one presentation group."""
    return df.agg(
        F.sum("distinction").alias("n_distinctions"),
        F.sum(F.when(F.col("pres_groups") == group, 1).otherwise(0)).alias("n_in_group"),
    )
