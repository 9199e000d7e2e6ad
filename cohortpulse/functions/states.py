"""Weighted moments of fractional or very large days as mergeable states.

The exact power sums of :mod:`cohortpulse.functions.moments` need integers. For doubles,
sums about a fixed origin would cancel, so a group is described by a state: its weight,
a pivot amid its days, the sums of ``c * (d - pivot)**j`` for j = 0..4, and the range of its
days. Any number of states merge into one about their common pivot by the binomial
theorem, and a row is a state about its own day, so one function does everything.

Map tasks merge their rows batch by batch and send a state per key, not rows; a reducing
task merges the sorted states of its keys as they come. One scan, one exchange, and a
key that holds most rows arrives as a few states per map task. The pivot is weighted by the
weights' sizes, so it stays amid the days where negative weights leave no mean.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortpulse.functions.columns import identifier

HIGHEST = 4
SUMS = [f"_s{j}" for j in range(HIGHEST + 1)]
#: Weight of all rows and of the dated ones by size, pivot, sums about it, range of days.
STATE = ["_total", "_size", "_pivot", *SUMS, "_low", "_high"]
#: States that a map task holds before it passes on what does not merge.
HELD = 1 << 18


def row_states(day: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """A state for each row; NaN stands for a missing day or weight."""
    weight = np.where(np.isnan(weight), 0.0, weight)
    dated = ~np.isnan(day) & (weight != 0)
    zero = np.zeros(len(day))
    return {
        "_total": weight,
        "_size": np.where(dated, np.abs(weight), 0.0),
        "_pivot": np.where(dated, day, 0.0),
        "_s0": np.where(dated, weight, 0.0),
        **{name: zero for name in SUMS[1:]},
        "_low": np.where(dated, day, np.inf),
        "_high": np.where(dated, day, -np.inf),
    }


def merged_states(state: dict[str, np.ndarray], group: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """One state for each of ``n`` groups of states."""

    def added(values: np.ndarray) -> np.ndarray:
        return np.bincount(group, values, n)

    size = added(state["_size"])
    # shares of the size rather than a quotient of sums, which could overflow
    share = np.divide(state["_size"], size[group], out=np.zeros(len(group)), where=size[group] > 0)
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, group, state["_low"])
    np.maximum.at(high, group, state["_high"])
    pivot = np.where(low == high, low, added(share * state["_pivot"]))
    pivot = np.where(size > 0, pivot, 0.0)
    far = np.where(state["_size"] > 0, state["_pivot"] - pivot[group], 0.0)
    out = {"_total": added(state["_total"]), "_size": size, "_pivot": pivot}
    with np.errstate(over="ignore", invalid="ignore"):
        for k, name in enumerate(SUMS):
            out[name] = added(sum(comb(k, j) * state[SUMS[j]] * far ** (k - j) for j in range(k + 1)))
    return out | {"_low": low, "_high": high}


def _groups(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct key and the group of every row."""
    codes = np.zeros(table.num_rows, np.int64)
    first = codes[:1]
    for name in keys:
        values = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes * max(1, len(values.dictionary)) + values.indices.to_numpy(zero_copy_only=False)
        _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return first, codes


def _merged(table: pa.Table, keys: Sequence[str]) -> tuple[pa.Table, int]:
    """One row per key, and the place among them of the table's last row."""
    first, group = _groups(table, keys)
    state = merged_states({c: table.column(c).to_numpy() for c in STATE}, group, len(first))
    found = table.select(list(keys)).take(pa.array(first))
    for name in STATE:
        found = found.append_column(name, pa.array(state[name], pa.float64()))
    return found, int(group[-1])


def _doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)


def moment_states(df: DataFrame, keys: Sequence[str], day: str, weight: str) -> DataFrame:
    """State of each key; ``keys`` may be of any type that Spark can sort."""
    keys = list(keys)
    schema = T.StructType([*df.select(*keys).schema.fields, *[T.StructField(c, T.DoubleType()) for c in STATE]])

    def of_rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for batch in stream:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(keys)
            for name, values in row_states(_doubles(batch, "_day"), _doubles(batch, "_weight")).items():
                table = table.append_column(name, pa.array(values, pa.float64()))
            held.append(_merged(table, keys)[0])
            n += held[-1].num_rows
            if n > HELD:
                held = [_merged(pa.concat_tables(held), keys)[0]]
                n = held[0].num_rows
                if n > HELD // 2:
                    yield from held.pop().to_batches(10_000)
                    n = 0
        if held:
            yield from _merged(pa.concat_tables(held), keys)[0].to_batches(10_000)

    def of_states(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.Table] = []
        for batch in stream:
            if batch.num_rows:
                table, last = _merged(pa.concat_tables([*open_, pa.Table.from_batches([batch])]), keys)
                # sorted by key, so only the last row's key may go on
                open_ = [table.slice(last, 1)]
                done = pa.concat_tables([table.slice(0, last), table.slice(last + 1)])
                yield from done.to_batches()
        for table in open_:
            yield from table.to_batches()

    double = lambda c, name: F.col(identifier(c)).cast("double").alias(name)
    rows = df.select(*keys, double(day, "_day"), double(weight, "_weight"))
    states = rows.mapInArrow(of_rows, schema)
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(of_states, schema)


def moments_of_states(states: DataFrame) -> DataFrame:
    """Replace state columns by the four moment columns, by the rules of
    :func:`cohortpulse.functions.moments.moments_of_sums`: undefined values are null."""
    keep = [identifier(c) for c in states.columns if c not in STATE]

    def about_mean(k: int) -> str:
        return " + ".join(" * ".join([f"{comb(k, j)}D", f"_s{j}", *["_off"] * (k - j)]) for j in range(k + 1))

    finite = lambda e: f"if(abs({e}) < double('Infinity'), {e}, null)"
    return (
        states.selectExpr(*keep, *SUMS, "_low", "_high", "_pivot", "nullif(_total, 0D) as _w")
        # weights without a day count in the divisor of the mean, too
        .selectExpr("*", "if(_s0 = _w, _pivot + _s1 / _w, (_s1 + _pivot * _s0) / _w) as _mean")
        .selectExpr("*", "_pivot - _mean as _off")
        .selectExpr(
            *keep,
            "_mean",
            f"if(_low = _high and _s0 = _w, 0D, ({about_mean(2)}) / _w) as _var",
            f"({about_mean(3)}) / _w as _third",
            f"({about_mean(4)}) / _w as _fourth",
        )
        .selectExpr("*", "nullif(_var, 0D) as _v", "if(_var > 0, sqrt(_var), null) as _root")
        .selectExpr(
            *keep,
            f"{finite('_var')} as click_time_variance",
            f"{finite('(_third / (_v * _root))')} as click_time_skewness",
            f"{finite('(_fourth / (_v * _v) - 3)')} as click_time_kurtosis",
            f"{finite('(_root / nullif(_mean, 0D))')} as click_time_cv",
        )
    )
