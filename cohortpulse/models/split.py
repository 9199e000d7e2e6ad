"""Repeatable train/test split by key."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpulse.functions.columns import joined_key
from cohortpulse.schemas import ENROLMENT_KEYS


def in_test(
    keys: Sequence[str] = ENROLMENT_KEYS, test_percent: int = 20, seed: int = 1
) -> Column:
    """Whether a row belongs to the test part, from a hash of its key.

    Independent of partitioning and row order, and needs no shuffle. The share
    holds in expectation; an exact share would need a global ranking. A row with
    a null key part has no key to hash and belongs to the training part.
    """
    text = joined_key(F.lit(seed), *keys)
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100
    return F.coalesce(bucket < test_percent, F.lit(False))


def train_test_split(
    df: DataFrame,
    keys: Sequence[str] = ENROLMENT_KEYS,
    test_percent: int = 20,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    flag = in_test(keys, test_percent, seed)
    return df.where(~flag), df.where(flag)


#: Bits of a row's hash that order rows, and bits that a pass settles.
ORDER_BITS = 60
DIGIT = 10


def order_hash(keys: Sequence[str], seed: int = 1) -> Column:
    """60 bits of a hash of the keys, missing parts included, that order rows at random."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def smallest(hashes: DataFrame, share: float) -> tuple[int, int]:
    """The value up to which exactly ``ceil(share * n)`` rows of a column of 60-bit hashes
    lie in order, and how many rows that have it are among them.

    Each pass counts the next ``DIGIT`` bits of the rows that agree with the sought one so
    far, so at most 2**DIGIT counts reach the driver, at every size, and nothing is sorted
    or shuffled but counts. Hashes are spread evenly: a cell holds one value after some
    log2(n) bits, which ends the search.
    """
    column = F.col(hashes.columns[0])
    above, wanted = None, None
    for shift in range(ORDER_BITS - DIGIT, -1, -DIGIT):
        given = hashes if above is None else hashes.where(F.shiftright(column, shift + DIGIT) == above)
        cells = given.groupBy(F.shiftright(column, shift).alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        found = sorted(cells.collect(), key=lambda r: r["cell"])
        if wanted is None:
            # the share as it is written: 0.2 of 10 rows are 2
            wanted = ceil(Fraction(str(share)) * sum(r["n"] for r in found))
        if not wanted:
            break
        for r in found:
            if wanted <= r["n"]:
                break
            wanted -= r["n"]
        above = r["cell"]
        if r["low"] == r["high"]:
            return r["low"], wanted
    return -1, 0


def exact_test_split(
    df: DataFrame, keys: Sequence[str] = ENROLMENT_KEYS, share: float = 0.2, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Training and test part, the latter of exactly ``ceil(share * n)`` rows.

    The test rows are those with the smallest hashes of ``keys``, whatever the partitioning.
    Name keys that tell rows apart: only rows alike in all of them can stand on both sides
    of the cut, and these few are ordered by all their columns. ``df`` is read several
    times, mostly for its keys; write it first when computing it is expensive.
    """
    rank = "__order"
    ranked = df.withColumn(rank, order_hash(keys, seed))
    cut, taken = smallest(ranked.select(rank), share)
    tied = ranked.where(F.col(rank) == cut).orderBy(*[f"`{c}`" for c in df.columns])
    test = ranked.where(F.col(rank) < cut).union(tied.limit(taken)).drop(rank)
    train = ranked.where(F.col(rank) > cut).union(tied.offset(taken)).drop(rank)
    return train, test
