"""Looking at tables: first rows, shape, numeric profile with exact quantiles."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortpulse.functions.columns import literal

QUARTILES = (0.25, 0.5, 0.75)
# Cells that one pass cuts a range of values into.
CELLS = 2048
# Ranks are sketched to a ten-thousandth of the rows, and bracketed by more than that.
ACCURACY = 10_000
ASIDE = 1.5e-4


def peek(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First rows in key order; a top-n, not a full sort."""
    return df.orderBy(*order_by).limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def shape_table(df: DataFrame, name: str) -> DataFrame:
    """Shape and column list as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"),
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) rows without nulls."""
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in columns
    ]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def _cleaned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as they are profiled: NaN is missing, as null is."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            (F.nanvl(F.col(f"`{c}`"), F.lit(None)) if kinds[c] in ("double", "float") else F.col(f"`{c}`")).alias(c)
            for c in columns
        ]
    )


def _with_order_key(values: DataFrame) -> DataFrame:
    """Adds ``key``, a long that orders like the double ``value``.

    It is the value's binary form: exponent above 52 bits of mantissa, negated for
    negative values. Dividing by a power of two is exact, so no rounding enters.
    """
    size = values.selectExpr("*", "abs(value) as _x", "least(floor(log2(abs(value))), 1023L) as _e0")
    size = size.selectExpr(
        "*", "case when _x >= pow(2D, _e0 + 1) then _e0 + 1 when _x < pow(2D, _e0) then _e0 - 1 else _e0 end as _e"
    )
    key = (
        "case when _x = 0 then 0L when _x = double('Infinity') then 9218868437227405312L"
        " when _x < 2.2250738585072014E-308D then bigint(_x / 4.9E-324D)"
        " else (_e + 1022L) * 4503599627370496L + bigint(_x / pow(2D, _e) * 4503599627370496D) end"
    )
    return size.selectExpr("column_name", "value", f"if(value < 0, -1L, 1L) * {key} as key")


def order_key(value: float) -> int:
    """The same key of one value."""
    bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
    return -bits if value < 0 else bits


def sketched(name: str, probabilities: Sequence[float] = QUARTILES) -> Column:
    """Values about each quantile's rank, from a mergeable sketch in the scan at hand."""
    sides = [min(1.0, max(0.0, p + e)) for p in probabilities for e in (-ASIDE, ASIDE)]
    given = F.array(*[F.lit(float(p)) for p in sides])
    return F.percentile_approx(F.col(name).cast("double"), given, F.lit(ACCURACY))


@dataclass
class _Target:
    """A value sought by its rank, the keys it is known to lie between, and itself."""

    column: str
    rank: int
    low: int
    high: int
    value: float | None = None


def _intervals(targets: list[_Target]) -> dict[str, list[tuple[int, int]]]:
    """Disjoint ranges of keys per column that hold its targets, in order."""
    found: dict[str, list[tuple[int, int]]] = {}
    for t in sorted(targets, key=lambda t: (t.column, t.low)):
        own = found.setdefault(t.column, [])
        if own and t.low <= own[-1][1]:
            own[-1] = own[-1][0], max(own[-1][1], t.high)
        else:
            own.append((t.low, t.high))
    return found


def _cell(intervals: list[tuple[int, int]]) -> str:
    """SQL for the cell of a key: one between neighbouring ranges, up to CELLS within."""
    parts = []
    for k, (low, high) in enumerate(intervals):
        shift = 0
        while (high >> shift) - (low >> shift) >= CELLS:
            shift += 1
        parts.append(f"when key < {low}L then {4 * k * CELLS}L")
        parts.append(f"when key <= {high}L then {(4 * k + 1) * CELLS}L + shiftright(key, {shift}) - ({low >> shift}L)")
    return f"case {' '.join(parts)} else {4 * len(intervals) * CELLS}L end"


def _narrow(keyed: DataFrame, targets: list[_Target]) -> None:
    """One pass: count all values by cell, and give each target the cell of its rank.

    Cells cover all values, so ranks are exact whatever the ranges were, and a target that
    its range missed is found beside it. At most CELLS cells per range are collected.
    """
    ranges = _intervals(targets)
    kinds = " ".join(f"when {literal(c)} then {_cell(own)}" for c, own in ranges.items())
    cells = (
        keyed.where(F.col("column_name").isin(list(ranges)))
        .withColumn("cell", F.expr(f"case column_name {kinds} end"))
        .groupBy("column_name", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    found: dict[str, list] = {}
    for r in sorted(cells.collect(), key=lambda r: (r["column_name"], r["cell"])):
        found.setdefault(r["column_name"], []).append(r)
    for t in targets:
        below = 0
        for r in found[t.column]:
            if t.rank < below + r["n"]:
                break
            below += r["n"]
        t.low, t.high = order_key(r["low"]), order_key(r["high"])
        if t.low == t.high:
            t.value = r["low"]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    counts: dict[str, int],
    probabilities: Sequence[float] = QUARTILES,
    about: dict[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles, exact at any size.

    The built-in exact percentile keeps every distinct value of a column in one
    task. Here a mergeable sketch brackets every rank (``about``, two values a quantile; a
    scan of its own unless given), values become order-preserving longs, and a pass counts
    all of them by cell, finely inside the brackets. A rank whose cell holds a single value
    is done, as nearly all are after one pass; any other cell, or the gap that a rank was
    found in, is cut further in the next. All columns and ranks go together. ``counts``
    holds the number of values per column, NaN and null not among them.
    """
    spark = df.sparkSession
    given = _cleaned(df, columns)
    if about is None:
        found_about = given.agg(*[sketched(f"`{c}`", probabilities).alias(c) for c in columns]).first()
        about = {c: found_about[k] for k, c in enumerate(columns)}
    wanted, targets = [], {}
    for c in columns:
        for k, p in enumerate(probabilities) if counts[c] else ():
            place = p * (counts[c] - 1)
            first = int(place)
            second = min(first + 1, counts[c] - 1)
            wanted.append((c, float(p), first, second, place - first))
            low, high = sorted(map(order_key, about[c][2 * k : 2 * k + 2]))
            for rank in (first, second):
                targets.setdefault((c, rank), _Target(c, rank, low, high))
    keyed = _with_order_key(_long_form(given, columns))
    while open_ := [t for t in targets.values() if t.value is None]:
        _narrow(keyed, open_)
    found = []
    for c, p, first, second, part in wanted:
        low, high = targets[c, first].value, targets[c, second].value
        found.append((c, p, low if low == high else low + (high - low) * part))
    return spark.createDataFrame(found, "column_name string, p double, quantile double")


def profile_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles, max; a row per column.

    Null and NaN are missing and left out of all of them. The table is read two or three
    times, before this returns; write it first when computing it is expensive.
    """
    names = list(columns or numeric_columns(df))
    spark = df.sparkSession
    stats = _cleaned(df, names).agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).cast("double").alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                sketched(c).alias("about"),
            ).alias(c)
            for c in (f"`{n}`" for n in names)
        ]
    ).first()
    basic = [(n, *stats[i][:-1]) for i, n in enumerate(names)]
    about = {n: stats[i]["about"] for i, n in enumerate(names)}
    table = spark.createDataFrame(
        basic,
        "column_name string, count long, mean double, std double, min double, max double",
    )
    counts = {row[0]: row[1] for row in basic}
    quartiles = exact_quantiles(df, names, counts, QUARTILES, about)
    wide = quartiles.groupBy("column_name").agg(
        *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(f"p{int(p * 100)}") for p in QUARTILES]
    )
    # one row per column of the table on either side
    return table.join(F.broadcast(wide), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )
