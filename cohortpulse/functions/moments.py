"""Click-weighted moments from exact power sums.

With day ``d``, clicks ``c`` and ``W`` the sum of clicks, the moments need
``S_j``, the sum of ``c * d**j`` for j = 0..4. Days and clicks are integers, so
the sums can be exact, which makes the result independent of row order and the
test for zero variance sound.

``S_2..S_4`` are kept as three sums of 21-bit parts. Plain long sums would
overflow for large groups, and sums of wide decimals leave the fast aggregation
path; the parts stay longs, and none can overflow below 2**41 rows per group.
The highest part of a negative term is negative and the lower two are not, so a
group's parts can be far larger than its sum. They are put together from the
highest down, where each step gives the sum shifted right, give or take the
number of rows, and never an intermediate that a long cannot hold.
A single row whose ``c * d**4`` exceeds a long raises under ANSI mode; for such
data ``wide`` sums decimals instead.

After the aggregation a group whose sums are small enough for longs, which its
largest day bounds, is finished in longs, any other in wide decimals. Negative
clicks count as they are: their groups are finished in wide decimals, as their
total bounds nothing.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpulse.functions.columns import identifier

PART_BITS = 21
PARTS = 3
HIGHEST = 4
EXACT = "decimal(38,0)"

WEIGHT = "_w"
LARGEST = "_far"
LEAST = "_least"


def _sum_name(power: int, part: int | None = None) -> str:
    return f"_s{power}" if part is None else f"_s{power}_{part}"


def power_sum_aggregates(day: str, weight: str, wide: bool = False) -> list[Column]:
    """Aggregates for ``groupBy``; :func:`moments_of_sums` reads them back."""
    as_type = EXACT if wide else "bigint"
    d = f"cast({identifier(day)} as {as_type})"
    c = f"cast({identifier(weight)} as {as_type})"
    sums = {
        WEIGHT: c,
        _sum_name(0): f"if({d} is null, null, {c})",
        _sum_name(1): f"{c} * {d}",
    }
    for power in range(2, HIGHEST + 1):
        term = " * ".join([c, *[d] * power])
        if wide:
            sums[_sum_name(power)] = term
            continue
        for part in range(PARTS):
            shifted = f"shiftright({term}, {PART_BITS * part})" if part else f"({term})"
            low = f" & {(1 << PART_BITS) - 1}L" if part < PARTS - 1 else ""
            sums[_sum_name(power, part)] = shifted + low
    aggregates = [F.expr(f"sum({text}) as {name}") for name, text in sums.items()]
    return [*aggregates, F.expr(f"max(abs({d})) as {LARGEST}"), F.expr(f"min({c}) as {LEAST}")]


def power_sum_columns(wide: bool = False) -> list[str]:
    """Names of the columns the aggregates make."""
    names = [WEIGHT, LARGEST, LEAST, _sum_name(0), _sum_name(1)]
    for power in range(2, HIGHEST + 1):
        names += [_sum_name(power)] if wide else [_sum_name(power, i) for i in range(PARTS)]
    return names


def _sums_as(kind: str, wide: bool) -> list[str]:
    """``S_0..S_4`` in one numeric type; absent sums count as 0."""

    def read(name: str) -> str:
        return f"cast({name} as {kind})"

    sums = [read(_sum_name(0)), read(_sum_name(1))]
    scale = "bigint" if kind == "bigint" else "decimal(8,0)"
    for power in range(2, HIGHEST + 1):
        if wide:
            sums.append(read(_sum_name(power)))
            continue
        total = read(_sum_name(power, PARTS - 1))
        for part in reversed(range(PARTS - 1)):
            total = f"(({total}) * cast({1 << PART_BITS} as {scale}) + {read(_sum_name(power, part))})"
        sums.append(total)
    return [f"coalesce({s}, cast(0 as {kind}))" for s in sums]


def _binomial_terms(sums: list[str], power: int, origin: str) -> list[tuple[str, str]]:
    """(sum, coefficient) pairs that add up to the power sum of ``d - origin``."""
    pairs = []
    for k in range(power + 1):
        sign = "-" if k % 2 else ""
        pairs.append((sums[power - k], " * ".join([f"{sign}{comb(power, k)}", *[origin] * k])))
    return pairs


def _translated(power: int, wide: bool) -> str:
    """Power sum of ``d - _m`` in longs."""
    pairs = _binomial_terms(_sums_as("bigint", wide), power, "bigint(_m)")
    return " + ".join(f"{s} * ({b})" for s, b in pairs)


def _translated_exactly(power: int, wide: bool) -> str:
    """The same in wide decimals, as a dot product of arrays.

    Arrays keep the generated code small: it sits beside the usual branch in
    long arithmetic, and a method too long for the JIT would slow down both.
    """
    pairs = _binomial_terms(_sums_as(EXACT, wide), power, "cast(_m as decimal(19,0))")
    sums = ", ".join(f"cast({s} as {EXACT})" for s, _ in pairs)
    coefficients = ", ".join(f"cast({b} as {EXACT})" for _, b in pairs)
    products = f"zip_with(array({sums}), array({coefficients}), (s, b) -> s * b)"
    return f"aggregate({products}, cast(0 as {EXACT}), (total, x) -> total + x)"


def moments_of_sums(totals: DataFrame, wide: bool = False) -> DataFrame:
    """Replace power-sum columns by the four moment columns.

    The sums are first shifted, exactly, to the integer nearest the mean. After
    that no cancellation is left that doubles could not carry. Undefined values
    are null, never NaN:

    * no clicks at all: everything null
    * a single day: variance 0, the rest null
    * mean day 0: coefficient of variation null

    Clicks without a day weigh in the divisor only, as a skip-null sum does.
    """
    scratch = power_sum_columns(wide)
    keep = [identifier(c) for c in totals.columns if c not in scratch]

    # No sum of terms of a translation exceeds 16 W far**4, and no part of the
    # spread 8 W**2 far**2. Half a long's range is left for the parts of a sum.
    fits = (
        f"16D * double({WEIGHT}) * pow(double({LARGEST}), 4) < 4e18D and "
        f"8D * pow(double({WEIGHT}), 2) * greatest(pow(double({LARGEST}), 2), 1D) < 4e18D and {LEAST} >= 0"
    )
    centred = totals.selectExpr(
        "*",
        # with negative clicks the mean may lie far outside the days, where sums would not fit
        f"greatest(least(coalesce(rint({_sum_name(1)} / nullif(double({_sum_name(0)}), 0D)), 0D), double({LARGEST})), -double({LARGEST})) as _m",
        "false as _fits" if wide else f"coalesce({fits}, false) as _fits",
    )

    def chosen(power: int) -> str:
        exact = f"double({_translated_exactly(power, wide)})"
        return exact if wide else f"if(_fits, double({_translated(power, wide)}), {exact})"

    # Where everything fits, the spread W T_2 - T_1**2 is exact too, and the
    # variance is rounded only once.
    t1, t2 = _translated(1, wide), _translated(2, wide)
    spread = f"if(_fits, double({WEIGHT} * ({t2}) - ({t1}) * ({t1})), null)"
    shifted = centred.selectExpr(
        *keep,
        "_m",
        f"nullif(double({WEIGHT}), 0D) as _wd",
        f"double(coalesce({_sum_name(1)}, 0)) as _mean_sum",
        f"double(coalesce({_sum_name(0)}, 0)) as _t0",
        f"double({WEIGHT} - coalesce({_sum_name(0)}, 0)) as _undated",
        *[f"{chosen(p)} as _t{p}" for p in range(1, HIGHEST + 1)],
        "cast(null as double) as _spread" if wide else f"{spread} as _spread",
    )
    return (
        shifted.selectExpr("*", "(_t1 - _m * _undated) / _wd as _off", "_mean_sum / _wd as _mean")
        .selectExpr(
            "*",
            "if(_undated = 0, coalesce(_spread, _wd * _t2 - _t1 * _t1) / (_wd * _wd),"
            " (_t2 - 2 * _off * _t1 + _off * _off * _t0) / _wd) as _var",
            "(_t3 - 3 * _off * _t2 + 3 * _off * _off * _t1 - _off * _off * _off * _t0) / _wd as _third",
            "(_t4 - 4 * _off * _t3 + 6 * _off * _off * _t2 - 4 * _off * _off * _off * _t1"
            " + _off * _off * _off * _off * _t0) / _wd as _fourth",
        )
        .selectExpr("*", "nullif(_var, 0D) as _v", "if(_var > 0, sqrt(_var), null) as _root")
        .selectExpr(
            *keep,
            "_var as click_time_variance",
            "_third / (_v * _root) as click_time_skewness",
            "_fourth / (_v * _v) - 3 as click_time_kurtosis",
            "_root / nullif(_mean, 0D) as click_time_cv",
        )
    )
