"""Declared constraints as data-quality jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpulse.schemas import FOREIGN_KEYS, PRIMARY_KEYS, ForeignKey


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that are null in part or occur more than once."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("problem", F.when(any_null, "null key").when(F.col("n_rows") > 1, "duplicate key"))
        .where(F.col("problem").isNotNull())
    )


def orphans(
    child: DataFrame,
    parent: DataFrame,
    columns: Sequence[str],
    parent_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Child key values without a parent, with the number of rows they affect.

    Rows with a null key part are not checked. The child is reduced to one row
    per key value before the join, so neither a hot key nor the row count of
    the fact table reaches it; the parent is reduced likewise, within the same
    shuffle.
    """
    names = list(parent_columns or columns)
    values = child.select(*columns)
    for c in columns:
        values = values.where(F.col(c).isNotNull())
    counted = values.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(names, columns)]).distinct()
    return counted.join(known, list(columns), "left_anti")


def key_text(columns: Sequence[str]) -> Column:
    """Key parts joined by '-', with NULL for a part that is null."""
    return F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def check_keys(
    tables: Mapping[str, DataFrame], declared: Mapping[str, Sequence[str]] = PRIMARY_KEYS
) -> DataFrame:
    """Violations of every declared primary key whose table is given:
    ``table_name, key, n_rows, problem``."""
    found = [
        key_violations(tables[t], keys).select(F.lit(t).alias("table_name"), key_text(keys).alias("key"), "n_rows", "problem")
        for t, keys in declared.items()
        if t in tables
    ]
    return reduce(DataFrame.unionByName, found)


def check_references(
    tables: Mapping[str, DataFrame], declared: Sequence[ForeignKey] = tuple(FOREIGN_KEYS)
) -> DataFrame:
    """Orphans of every declared reference between tables that are given:
    ``reference, key, n_rows``.

    A child that lacks a column of its reference takes it from the assessment it names.
    """
    found = []
    for f in declared:
        if f.child not in tables or f.parent not in tables:
            continue
        child = tables[f.child]
        if absent := [c for c in f.columns if c not in child.columns]:
            child = child.join(tables["assessments"].select("id_assessment", *absent), "id_assessment")
        missing = orphans(child, tables[f.parent], f.columns)
        found.append(missing.select(F.lit(f.name).alias("reference"), key_text(f.columns).alias("key"), "n_rows"))
    return reduce(DataFrame.unionByName, found)


def overlong(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Per bounded string column: values over the limit and the longest one.

    All columns are measured in one aggregate.
    """
    names = list(limits)
    measured = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(limits[c]).alias("max_allowed"),
                F.coalesce(F.sum((F.length(c) > limits[c]).cast("long")), F.lit(0).cast("long")).alias(
                    "n_overlong"
                ),
                F.max(F.length(c)).alias("longest"),
            ).alias(c)
            for c in names
        ]
    )
    return measured.select(F.inline(F.array(*names)))


def overlong_rows(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Rows in which at least one string exceeds its limit."""
    return df.where(reduce(lambda a, b: a | b, [F.length(c) > n for c, n in limits.items()]))
