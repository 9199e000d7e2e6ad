"""One-hot encoding, the modelling frame, and column pruning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpulse.functions.columns import clean_name, identifier, literal
from cohortpulse.schemas import CATEGORIES, dummy_column, modelling_columns

MISSING_SUFFIX = "_missing"


def observed_categories(
    df: DataFrame, columns: Sequence[str], limit: int = 1000
) -> dict[str, list[str]]:
    """Sorted distinct values per column, from one job.

    Refuses to collect more than ``limit`` pairs: a column of that kind is no
    category.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])
    ).alias("pair")
    rows = (
        df.select(pairs)
        .select("pair.name", "pair.value")
        .where(F.col("value").isNotNull())
        .distinct()
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories; pass them explicitly")
    found: dict[str, list[str]] = {c: [] for c in columns}
    for name, value in rows:
        found[name].append(value)
    return {c: sorted(values) for c, values in found.items()}


def one_hot(
    df: DataFrame,
    categories: Mapping[str, Sequence[str]] = CATEGORIES,
    keep_source: bool = False,
) -> DataFrame:
    """0/1 column per category; null or an unlisted value sets none of them."""
    dummies = [
        f"coalesce(int({identifier(source)} = {literal(value)}), 0) as {identifier(dummy_column(source, value))}"
        for source, values in categories.items()
        for value in sorted(values)
    ]
    kept = [identifier(c) for c in df.columns if keep_source or c not in categories]
    return df.selectExpr(*kept, *dummies)


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def modelling_frame(
    df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The modelling columns in their fixed order, with cleaned names.

    ``keep`` carries identifier columns along, in front.
    """
    chosen = list(columns or modelling_columns())
    return clean_columns(df.select(*keep, *[identifier(c) for c in chosen]))


def _has_non_zero(name: str) -> Column:
    """Whether a column holds anything but 0; a null counts as something."""
    value = f"double({identifier(name)})"
    return F.expr(f"coalesce(max(if({value} is null or {value} <> 0, 1, 0)), 0) as {identifier(name)}")


def non_zero_flags(
    df: DataFrame, columns: Sequence[str], group: str | None = None
) -> DataFrame:
    """1 per column that is not entirely 0, for all groups in one pass."""
    flags = [_has_non_zero(c) for c in columns]
    return df.groupBy(group).agg(*flags) if group else df.agg(*flags)


def non_zero_columns(
    df: DataFrame, columns: Sequence[str], group: str, limit: int = 10_000
) -> dict[int, list[str]]:
    """Columns to keep per group. Label and group columns are not considered."""
    rows = non_zero_flags(df, columns, group).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} groups")
    return {r[group]: [c for c in columns if r[c]] for r in rows}


def fill_missing(df: DataFrame, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Replace null (and NaN) by ``fill`` and add a 0/1 indicator per column.

    Spark's trees accept no missing values; the indicator keeps the fact that
    one was missing available to the splits.
    """
    chosen = []
    for c in df.columns:
        name = identifier(c)
        if c not in columns:
            chosen.append(name)
            continue
        value = f"nullif(double({name}), double('NaN'))"
        chosen.append(f"coalesce({value}, {float(fill)!r}D) as {name}")
        chosen.append(f"int({value} is null) as {identifier(c + MISSING_SUFFIX)}")
    return df.selectExpr(*chosen)
