"""Engagement totals kept up to date increment by increment.

The sums behind the features, totals per enrolment and type and power sums of the days,
are additive. They are stored, one row per enrolment, in folders by a hash of the key, and
an increment's sums are added to them: old clicks are not read again, and only the folders
of enrolments that an increment touches are written anew, by dynamic partition overwrite.

Every row carries the last increment added to it, and finished increments are listed, so
an increment that is repeated, or was cut short by a lost driver, adds nothing twice.
Increments are numbered upwards; one that was never added cannot come before one that was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.functions.moments import LARGEST, LEAST
from cohortpulse.operators.clicks import NULL_TYPES
from cohortpulse.operators.moments import engagement_sums, finish_engagement
from cohortpulse.schemas import ENROLMENT_KEYS
from cohortpulse.sources.sinks import temporary_table

FOLDER = "folder"
BATCH = "last_batch"
FOLDERS = 256


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing stored yet
        return None


def applied_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the increments that are in the state, one per increment ever added."""
    listed = _read(spark, f"{path}/applied")
    return [] if listed is None else sorted(r["batch"] for r in listed.distinct().collect())


def _merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of both, column by column."""
    how = {LARGEST: F.max, LEAST: F.min, BATCH: F.max}
    values = [c for c in new.columns if c not in (FOLDER, *keys)]
    aggregates = [(F.bit_or if c.startswith(NULL_TYPES) else how.get(c, F.sum))(c).alias(c) for c in values]
    return old.select(new.columns).unionByName(new).groupBy(FOLDER, *keys).agg(*aggregates)


def add_increment(
    path: str,
    typed: DataFrame,
    batch: int,
    vocabulary: Sequence[str],
    keys: Sequence[str] = ENROLMENT_KEYS,
    day: str = "click_date",
    weight: str = "sum_click",
    activity: str = "activity_type",
    wide: bool = False,
    folders: int = FOLDERS,
) -> bool:
    """Add clicks with their activity type to the state under ``path``, which the first
    increment makes. False if increment ``batch`` was added before.

    The sums of the increment are computed once; at most ``folders`` folder numbers
    come to the driver, so that only those are read and written.
    """
    spark = typed.sparkSession
    done = applied_batches(spark, path)
    if batch in done:
        return False
    if done and batch < done[-1]:
        raise ValueError(f"increment {batch} comes after increment {done[-1]}")
    sums = engagement_sums(typed, vocabulary, keys, day, weight, activity, wide)
    placed = sums.withColumns({FOLDER: F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int"), BATCH: F.lit(batch).cast("long")})
    with temporary_table(placed, "increment") as new:
        old = _read(spark, f"{path}/state")
        if old is not None:
            touched = [r[0] for r in new.select(FOLDER).distinct().collect()]
            old = old.where(F.col(FOLDER).isin(touched))
            # rows that a cut-short run of this very increment wrote
            written = old.where(F.col(BATCH) >= batch).select(*keys)
            new = _merged(old, new.join(written, list(keys), "left_anti").select(new.columns), keys)
        rebalanced = new.hint("rebalance", FOLDER)
        rebalanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(f"{path}/state")
    spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{path}/applied")
    return True


def engagement_from_state(spark: SparkSession, path: str, vocabulary: Sequence[str], wide: bool = False) -> DataFrame:
    """The features of :func:`cohortpulse.operators.moments.engagement_totals`, from the
    stored sums alone: no exchange."""
    state = spark.read.parquet(f"{path}/state").drop(FOLDER, BATCH)
    return finish_engagement(state, vocabulary, wide)
