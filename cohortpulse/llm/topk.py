"""Exact top-k inner products by a vector-approximation file.

Vectors become integers, floor(SCALE * x). The approximation file is a stored table of
blocks of ``BLOCK`` rows: per dimension the cell, one byte out of ``CELLS``, that each
number falls in, with the cells' origin and width. It bounds every score from both sides.

1. Queries are taken in rounds of at most ``ROUND`` bytes, which are broadcast. Each round
   scans the file once, without moving it. A task keeps, per query, the k best lower
   bounds it has met and drops each row whose upper bound is below the last of them.
2. The k-th best lower bound over all tasks drops most of what is left.
3. Exact vectors are fetched by a join, in the order of the bounds: first the ``READ`` rows
   with the highest upper bounds, whose k-th exact score then tells which of the others may
   still enter. These are fetched next, and the result is certain.

So the shuffles carry bounds of the rows left and, per step, the exact vectors of these
rows; they grow with vectors plus queries. Of rows with equal vectors only the k + 1
first by id can be among anyone's best (a row is not its own candidate), so the others are
left out beforehand, however many there are; they still are queries.

Rows with a null id, a null vector, or null or non-finite components take no part;
vectors of different lengths are not compared. A row is never its own candidate, but
another row that repeats its id or vector is. Ties go to the smaller id. With fewer
than k candidates all are returned. An empty table gives an empty result. Components beyond
62 bits and scores beyond 64 raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortpulse.llm.common import ROW, batches, new_folder, rows_of, stored, table, with_rows

SCALE = 1024
K = 10
EVERY = 100
CELLS = 256
BLOCK = 4096
QUERIES = 512
#: Bytes of queries that are broadcast at a time.
ROUND = 32 << 20
#: Exact vectors read first for each query.
READ = 32
#: Rows that a task holds before it passes them on to the next step.
HELD = 1 << 20

_FILE = pa.schema(
    [("dim", pa.int32()), ("rows", pa.binary()), ("low", pa.binary()), ("step", pa.binary()), ("cells", pa.binary())]
)
_FILE_DDL = "dim int, rows binary, low binary, step binary, cells binary"
_ASKED = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("q_rows", pa.binary()), ("q_data", pa.binary())])
_ASKED_DDL = "dim int, block long, q_rows binary, q_data binary"
_LEFT = pa.schema([("query_row", pa.int64()), ("row", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
_LEFT_DDL = "query_row long, row long, low double, high double"


class Approximation:
    """Cells of a block's integer vectors, and score bounds from them."""

    def __init__(self, low: np.ndarray, step: np.ndarray, cell: np.ndarray):
        self.low, self.step, self.cell = low, step, cell
        self.view = cell.astype(np.float64)
        self.most = np.abs(low) + step * CELLS

    @classmethod
    def of(cls, data: np.ndarray) -> Approximation:
        low = data.min(axis=0).astype(np.float64)
        # sums in floating point may be off by a few of their last digits
        spread = (data.max(axis=0) - low) * (1 + 1e-12) + 1
        step = np.maximum(np.ceil(spread / CELLS), 1.0)
        return cls(low, step, np.minimum((data - low) // step, CELLS - 1).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of scores, a line for each query."""
        at_low = (queries * self.step) @ self.view.T + (queries @ self.low)[:, None]
        inside = queries * (self.step - 1)
        slack = 1e-12 * (np.abs(queries) @ self.most) + 1e-6
        return at_low + (np.minimum(inside, 0).sum(axis=1) - slack)[:, None], at_low + (np.maximum(inside, 0).sum(axis=1) + slack)[:, None]


class Nearest:
    """Rows that may be among the k best of each query of a block, from bounds alone."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.sure = np.full((len(own), k), -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        mine = self.own[:, None] == rows[None, :]
        low, high = np.where(mine, -np.inf, low), np.where(mine, -np.inf, high)
        best = low if len(rows) <= self.k else -np.partition(-low, self.k - 1, axis=1)[:, : self.k]
        self.sure = -np.sort(-np.concatenate([self.sure, best], axis=1), axis=1)[:, : self.k]
        query, at = np.nonzero(~mine & (high >= self.sure[:, -1:]))
        self.parts.append((query, rows[at], low[query, at], high[query, at]))
        self.size += len(query)

    def prune(self) -> None:
        query, rows, low, high = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        left = high >= self.sure[query, -1]
        self.parts = [(query[left], rows[left], low[left], high[left])]
        self.size = int(left.sum())

    def take(self) -> Iterator[pa.RecordBatch]:
        """What is left; none of it is held any more."""
        self.prune()
        (query, *rest), self.parts, self.size = self.parts[0], [], 0
        for at in range(0, len(query), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(c[part]) for c in (self.own[query], *rest)], schema=_LEFT)


def _checked(vectors: list) -> np.ndarray:
    data = np.floor(SCALE * np.array(vectors, np.float64).reshape(len(vectors), -1))
    if np.abs(data).max(initial=0) >= 2**62:
        raise OverflowError("a component exceeds a 64-bit integer")
    return data


def _grouped(stream: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list]]:
    """Length, row numbers and vectors of up to ``size`` rows with vectors of one length."""
    held: dict[int, list[tuple]] = {}
    for row, vector in rows_of(stream):
        mine = held.setdefault(len(vector), [])
        mine.append((row, vector))
        if len(mine) == size:
            yield len(vector), *zip(*held.pop(len(vector)), strict=True)
    for dim, rest in held.items():
        yield dim, *zip(*rest, strict=True)


def approximation_file(given: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of cells of rows ``row, vector``, stored."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            for dim, rows, vectors in _grouped(stream, block):
                near = Approximation.of(_checked(vectors))
                yield dim, np.array(rows, "<i8").tobytes(), near.low.astype("<f8").tobytes(), near.step.astype("<f8").tobytes(), near.cell.tobytes()

        yield from batches(_FILE, blocks(), 1)

    return stored(given.select("row", "vector").mapInArrow(run, _FILE_DDL), "cells")


def _asked(given: DataFrame, size: int) -> DataFrame:
    """Query rows ``row, vector`` in blocks, stored."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            for k, (dim, rows, vectors) in enumerate(_grouped(stream, size)):
                yield dim, k, np.array(rows, "<i8").tobytes(), _checked(vectors).astype("<f8").tobytes()

        yield from batches(_ASKED, blocks(), 1)

    return stored(given.select("row", "vector").mapInArrow(run, _ASKED_DDL), "queries")


def _rounds(asked: DataFrame) -> list[DataFrame]:
    """The query blocks in groups of at most ``ROUND`` bytes, or of one block."""
    sizes = asked.select("dim", F.hash("q_rows").alias("name"), (F.length("q_rows") + F.length("q_data")).alias("bytes"))
    most = sizes.agg(F.max("bytes")).first()[0] or 1
    count = -(-sizes.count() // max(1, ROUND // most))
    if count <= 1:
        return [asked]
    order = Window.orderBy("dim", "name", "q_rows")
    dealt = stored(asked.withColumn("name", F.hash("q_rows")).withColumn("round", F.row_number().over(order) % count).drop("name"), "rounds")
    return [dealt.filter(F.col("round") == k).drop("round") for k in range(count)]


def _left(cells: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Rows that may be among the k best of a round's queries, after a scan of the file."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, Nearest] = {}
        for dim, rows_, low, step, cell, q_rows, q_data in rows_of(stream, 1):
            rows = np.frombuffer(rows_, "<i8")
            near = Approximation(np.frombuffer(low, "<f8"), np.frombuffer(step, "<f8"), np.frombuffer(cell, np.uint8).reshape(len(rows), dim))
            own = np.frombuffer(q_rows, "<i8")
            mine = found.setdefault(q_rows, Nearest(own, k))
            mine.add(rows, *near.bounds(np.frombuffer(q_data, "<f8").reshape(len(own), dim)))
            if sum(n.size for n in found.values()) > HELD:
                for each in found.values():
                    if each.parts:
                        each.prune()
                if sum(n.size for n in found.values()) > HELD // 2:
                    for each in found.values():
                        if each.parts:
                            yield from each.take()
        for each in found.values():
            if each.parts:
                yield from each.take()

    return cells.join(F.broadcast(asked.drop("block")), "dim").select("dim", "rows", "low", "step", "cells", "q_rows", "q_data").mapInArrow(run, _LEFT_DDL)


def _integers() -> Column:
    return F.transform("vector", lambda x: F.floor(x * SCALE).cast("long"))


def _without_late_copies(given: DataFrame, k: int) -> DataFrame:
    """Rows but those of equal vectors that come after the first k + 1 by id. Where there
    are as many, the last of these is found with a limit per group before the exchange."""
    marked = given.withColumn("digest", F.sha2(F.concat_ws(",", _integers().cast("array<string>")), 256))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("id", "row"))
    first = marked.select("row", "id", "digest").withColumn("place", place).filter(F.col("place") <= k + 1)
    cuts = first.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("cut"), F.count("*").alias("n"))
    cuts = stored(cuts.filter(F.col("n") > k).select("digest", "cut"), "cuts")
    marked = marked.join(cuts, "digest", "left")
    return marked.filter(F.col("cut").isNull() | (F.struct("id", "row") <= F.col("cut"))).select("row", "vector")


def _product(a: str, b: str) -> Column:
    """Integer inner product; beyond 64 bits it raises."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def _scored(wanted: DataFrame, whole: DataFrame, asking: DataFrame) -> DataFrame:
    """Exact scores of pairs ``query_row, row``."""
    found = wanted.join(whole.select("row", F.col("id").alias("vec_id"), F.col("whole").alias("a")), "row")
    found = found.join(asking.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("whole").alias("b")), "query_row")
    return found.select("query_row", "query_id", "row", "vec_id", _product("a", "b").alias("score"))


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES, read: int = READ) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for every query row.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    given = with_rows(vectors).select(
        F.col(ROW).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    )
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = given.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine)
    whole = given.select("row", "id", _integers().alias("whole"))
    cells = approximation_file(_without_late_copies(given, k), block)
    wanted = given.filter(is_query)
    asked = _asked(wanted.repartition(max(1, -(-wanted.count() // queries))), queries)

    path = new_folder(spark, "left")
    slots = spark.sparkContext.defaultParallelism
    scan = cells if len(cells.inputFiles()) >= slots else cells.repartition(slots)
    for each in _rounds(asked):
        _left(scan, each, k).write.mode("append").parquet(path)
    left = spark.read.schema(_LEFT_DDL).parquet(path)

    def ranked(rows: DataFrame, *order: Column, within: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order))).filter(F.col("rank") <= within)

    sure = ranked(left, F.desc("low"), within=k).groupBy("query_row").agg(F.min("low").alias("sure"), F.count("*").alias("n"))
    sure = sure.select("query_row", F.when(F.col("n") == k, F.col("sure")).otherwise(float("-inf")).alias("sure"))
    near = stored(left.join(sure, "query_row").filter("high >= sure").select("query_row", "row", "high"), "near")
    asking = whole.filter(is_query)
    first = ranked(near, F.desc("high"), F.col("row"), within=read).select("query_row", "row")
    first = stored(_scored(first, whole, asking), "first")
    order = (F.desc("score"), F.col("vec_id"), F.col("row"))
    least = ranked(first, *order, within=k).groupBy("query_row").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    least = least.select("query_row", F.when(F.col("n") == k, F.col("least").cast("double")).otherwise(float("-inf")).alias("least"))
    rest = near.join(least, "query_row").filter("high >= least").join(first.select("query_row", "row"), ["query_row", "row"], "left_anti")
    found = first.unionByName(_scored(rest.select("query_row", "row"), whole, asking))
    return ranked(found, *order, within=k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("id") % EVERY == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS a
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.a, c.a), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.a) = len(c.a) WHERE q.vec_id % 100 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
