"""Writing derived features."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cohortpulse.session import shared_folder


def write_features(df: DataFrame, path: str, partition_by: str = "pres_groups") -> str:
    """Parquet table partitioned by presentation group.

    Rows are rebalanced on the partition column: each group lands in few files,
    and adaptive execution splits a group that is too big for one task.
    """
    rebalanced = df.hint("rebalance", partition_by)
    rebalanced.write.mode("overwrite").partitionBy(partition_by).parquet(path)
    return path


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Catalog table ``name`` bucketed and sorted by ``keys``, read back.

    One exchange when it is written; aggregates and joins on the keys, or on more columns
    than these, then read it without any. Rows are dealt to the buckets' own tasks first,
    so a bucket is one file. Choose some 128 MB to 1 GB a bucket: a key is never split.
    The table stays until it is dropped, and with a ``path`` its folder beyond that.
    """
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_and_read(
    df: DataFrame, name: str, partition_by: str | None = None, path: str | None = None
) -> DataFrame:
    """Materialise an intermediate, in the shared folder unless ``path`` is given.

    For a table that several jobs read: it is computed once, and it outlives
    the executors that made it.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if partition_by:
        write_features(df, path, partition_by)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the store that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A path in the shared folder that goes when its consumer is done."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove_folder(spark, path)


@contextmanager
def temporary_table(df: DataFrame, name: str, partition_by: str | None = None) -> Iterator[DataFrame]:
    """An intermediate that several jobs read, removed after the block."""
    with temporary_folder(df.sparkSession, name) as path:
        yield write_and_read(df, name, partition_by, path)
