"""Helpers shared by the training-data operators: inputs, written tables, Arrow batches."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.session import shared_folder

#: Number that marks a row; see :func:`with_rows`.
ROW = "__cohortpulse_row"
SET_ASIDE = ROW + "_given"
WHITESPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, which
    cuts its lineage and lets several jobs read it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number that holds for every scan of the result.

    Another scan may cut files into other partitions, so a counter would not hold. Rows of
    plain Parquet tables are numbered by their file and their place in it and need no
    copy; any others are written once with all columns. A column that already has the
    number's name is set aside until :func:`without_rows`.
    """
    docs = docs.withColumnRenamed(ROW, SET_ASIDE)
    placed = _row_places(docs)
    if placed is not None:
        return docs.withColumn(ROW, placed)
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _row_places(docs: DataFrame) -> Column | None:
    """Number from a row's file and its place there; None unless ``docs`` is columns of a
    Parquet table whose files the numbers tell apart."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        expressions = plan.expressions()
        if any(expressions.apply(k).children().nonEmpty() for k in range(expressions.size())):
            return None
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return None
    # a path may be written with one slash or three after its scheme
    names = [re.sub("^[^/]*/+", "", f) for f in docs.inputFiles()]
    for seed in "0123":
        if len({hashlib.md5((seed + n).encode()).hexdigest()[:8] for n in names}) == len(names):
            break
    else:
        return None
    try:
        place = docs.metadataColumn("_metadata")
        name = F.regexp_replace(place.getField("file_path"), "^[^/]*/+", "")
        file = F.conv(F.substring(F.md5(F.concat(F.lit(seed), name).cast("binary")), 1, 8), 16, 10).cast("long")
        number = F.shiftleft(file, 31) + place.getField("row_index")
        docs.select(number)
    except AnalysisException:  # not a Parquet table
        return None
    return number


def without_rows(df: DataFrame) -> DataFrame:
    """``df`` as it was before :func:`with_rows`."""
    return df.drop(ROW).withColumnRenamed(SET_ASIDE, ROW)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row number, ``doc_id`` and UTF-8 bytes of each row (null text: empty).

    Other columns are left out, whatever their names. The numbers tell repeated
    rows apart. They are those of :func:`with_rows` if ``docs`` has them; others hold
    for a single scan.
    """
    return docs.select(
        F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id().alias(ROW),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of a table from :func:`with_rows`, all columns but the number, whose
    numbers are in ``kept`` (one column ROW)."""
    return without_rows(rows.join(kept, ROW, "left_semi"))


def drop_rows(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The other way round. ``dropped`` is stored first: where it is small, as Spark then
    sees, it is broadcast and the rows need not move."""
    return without_rows(rows.join(stored(dropped, "dropped"), ROW, "left_anti"))


def batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches from tuples."""
    columns: list[list] = [[] for _ in schema]
    for row in rows:
        for column, value in zip(columns, row, strict=True):
            column.append(value)
        if len(columns[0]) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            columns = [[] for _ in schema]
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def rows_of(stream: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[tuple]:
    """Tuples of the batches' rows, turned into Python objects a few at a time."""
    for batch in stream:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def map_rows(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``mapInArrow`` for a function from row tuples to row tuples."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(schema, function(rows_of(stream)))

    return df.mapInArrow(run, ddl)
