"""Reading base tables from Parquet, the catalog, or CSV files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortpulse.schemas import HEADER_RENAMES, TABLES


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """One table of the catalog."""
    return spark.table(name)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    renames: Mapping[str, str] | None = None,
    null_value: str = "",
    strict: bool = True,
    one_header: bool = False,
) -> DataFrame:
    """Typed table from CSV files whose headers differ from the schema.

    Columns are matched by header name after ``renames``, not by position;
    extra columns are dropped and a missing one is an error. Every file has a header of
    its own: files are grouped by their header line and read group by group. Finding the
    headers is one more pass that only splits lines; ``one_header`` says that the files
    below each path agree and saves it, and the job stops at one that does not. With
    ``strict`` a malformed value or a row with too few or too many fields stops the job
    too; without it they become null or are cut.
    """
    groups: list[str | list[str]] = []
    for p in [path] if isinstance(path, str) else path:
        found = [] if one_header else list(files_by_header(spark, p).values())
        groups += found if len(found) > 1 else [p]
    return reduce(DataFrame.unionByName, [_read_one_csv(spark, p, schema, renames, null_value, strict) for p in groups])


def files_by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files below a path by their first line that is not blank; the driver holds one line
    per file, as it holds the files' names anyway."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    # a block of a file is one task's, whose numbers follow the lines
    first = lines.where((F.col("block") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.min_by("value", "line").alias("header"))
    found: dict[str, list[str]] = {}
    for r in sorted(first.collect()):
        found.setdefault(r["header"].rstrip("\r"), []).append(unquote(r["file"]))
    return found


def _read_one_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, renames: Mapping[str, str] | None, null_value: str, strict: bool
) -> DataFrame:
    reader = spark.read.option("header", True).option("nullValue", null_value)
    header = reader.option("inferSchema", False).csv(path).schema
    # every file's header is held against that of the first, and every row's fields
    # are counted, for which the parser has to see all columns
    raw = (
        reader.schema(header)
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .csv(path)
    )
    found = raw.withColumnsRenamed(
        {old: new for old, new in (renames or {}).items() if new not in raw.columns}
    )
    missing = [f.name for f in schema.fields if f.name not in found.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    typed = []
    for field in schema.fields:
        text = F.col(f"`{field.name}`")
        value = text.cast(field.dataType) if strict else text.try_cast(field.dataType)
        typed.append(value.alias(field.name, metadata=field.metadata))
    return found.select(*typed)


def read_base_csv(
    spark: SparkSession, path: str | Sequence[str], table: str, null_value: str = "?", strict: bool = True, one_header: bool = False
) -> DataFrame:
    """One of the seven base tables from CSV, with its known header changes."""
    return read_csv(spark, path, TABLES[table], HEADER_RENAMES.get(table), null_value, strict, one_header)
