"""Exact deduplication by Grace hashing: partition until each bucket fits a table.

Two texts are equal when their bytes agree after white space (space, tab, line
feed, vertical tab, form feed, carriage return) is deleted. Spark makes the first
partitions, as a shuffle on a digest of the text. Each is read into an
open-addressing table that compares complete contents; what does not fit is
partitioned again, by further bits of the digest, into the task's own spill files,
which go when the task ends, and a rerun writes its own.

Equal texts meet once per map task before the shuffle, so a text that makes up a
third of the table arrives as one row per map task. Members carry no text; they
find their group's survivor by the digest, in a join that adaptive execution splits.

Null and empty texts are equal to each other and to texts of white space only. Of
equal texts the one with the most code points stays, then the smallest ``doc_id``
(null last), then the first row: of repeated rows exactly one is kept. An empty
table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import ROW, WHITESPACE, drop_rows, map_rows, numbered, stored, table, with_rows

#: Bytes of content that one table holds before it spills or, on the map side, is emptied.
TABLE_BYTES = 32 << 20
#: Bytes of content aimed at per reducing task, and spill files per level.
PARTITION_BYTES = 64 << 20
FAN_OUT = 16
_LAST = 1 << 63

_ROWS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("points", pa.int64()), ("digest", pa.binary()),
     ("content", pa.binary()), ("n", pa.int64()), ("size", pa.int64())]
)
_ROWS_DDL = "row long, doc_id long, points long, digest binary, content binary, n long, size long"
_CLASSES = pa.schema([("digest", pa.binary()), ("keep_row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_CLASSES_DDL = "digest binary, keep_row long, keep_id long, group_size long"


def normalised(text: bytes) -> bytes:
    return text.translate(None, WHITESPACE)


def rank(points: int, doc_id: int | None, row: int) -> tuple:
    """Order of survival within a group; the smallest stays."""
    return -points, _LAST if doc_id is None else doc_id, row


class Table:
    """Open addressing with linear probing over complete contents.

    A slot holds a digest, its content, the number of texts and the best of them. Texts
    that a better one beats are added to ``lost``, if given.
    """

    def __init__(self, lost: list | None = None, slots: int = 1 << 10):
        self.lost = lost
        self.size = 0
        self.slots = np.full(slots, -1, np.int64)
        self.entries: list[list] = []

    def _probe(self, digest: bytes, content: bytes) -> tuple[int, list | None]:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:]) & mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == digest:
                if entry[1] != content:
                    raise ValueError("two different texts have one SHA-256 digest")
                return at, entry
            at = (at + 1) & mask
        return at, None

    def add(self, digest: bytes, content: bytes, n: int, best: tuple, room: bool = True) -> bool:
        """Count a text. False if it is new and there is no room for it."""
        at, entry = self._probe(digest, content)
        if entry is not None:
            entry[2] += n
            if self.lost is not None:
                self.lost.append(max(entry[3], best))
            entry[3] = min(entry[3], best)
            return True
        if not room:
            return False
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, n, best])
        self.size += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            old = self.entries
            self.slots = np.full(4 * len(self.slots), -1, np.int64)
            for k, e in enumerate(old):
                self.slots[self._probe(e[0], e[1])[0]] = k
        return True


def _spill_file():
    """A nameless file in the folder that Spark gives its tasks for spilling."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


def _reread(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            file.close()
            return


def grace(records: Iterable[tuple], memory: int = TABLE_BYTES, level: int = 0, lost: list | None = None) -> Iterator[list]:
    """One entry per distinct content of (digest, content, n, best) records; the ``best``
    of the records that others beat go to ``lost``."""
    if level > 30:
        raise ValueError("a single text exceeds the table's memory at every level")
    held = Table(lost)
    spilled: list = []
    for digest, content, n, best in records:
        if held.add(digest, content, n, best, room=held.size < memory):
            continue
        if not spilled:
            spilled = [_spill_file() for _ in range(FAN_OUT)]
        # one half-byte of the digest for each level, after those that Spark's shuffle saw
        byte = digest[4 + level // 2]
        pickle.dump((digest, content, n, best), spilled[byte >> 4 if level % 2 else byte & 15])
    yield from held.entries
    del held
    for k, file in enumerate(spilled):
        spilled[k] = None
        yield from grace(_reread(file), memory, level + 1, lost)


def _members_and_contents(memory: int):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        def emptied(held: Table) -> Iterator[tuple]:
            for digest, content, n, (points, doc_id, row) in held.entries:
                yield row, None if doc_id == _LAST else doc_id, -points, digest, content, n, len(content)

        held = Table()
        for row, doc_id, text in rows:
            content = normalised(text)
            digest = hashlib.sha256(content).digest()
            points = len(text.decode())
            yield row, doc_id, points, digest, None, None, None
            held.add(digest, content, 1, rank(points, doc_id, row))
            if held.size >= memory:
                yield from emptied(held)
                held = Table()
        yield from emptied(held)

    return run


def _classes(memory: int):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        records = ((digest, content, n, rank(points, doc_id, row)) for row, doc_id, points, digest, content, n in rows)
        for digest, _, n, (_, doc_id, row) in grace(records, memory):
            yield digest, row, None if doc_id == _LAST else doc_id, n

    return run


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = TABLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Members (row, doc_id, digest) and classes (digest, keep_row, keep_id, group_size)."""
    given = numbered(docs, id_col, text_col)
    rows = stored(map_rows(given, _members_and_contents(memory), _ROWS, _ROWS_DDL), "exact-rows")
    contents = rows.filter("n is not null")
    total = contents.agg(F.sum("size")).first()[0] or 0
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = map_rows(
        contents.select("row", "doc_id", "points", "digest", "content", "n").repartition(max(shuffled, -(-total // PARTITION_BYTES)), "digest"),
        _classes(memory), _CLASSES, _CLASSES_DDL,
    )
    return rows.filter("n is null").select("row", "doc_id", "digest"), classes


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = TABLE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    members, classes = exact_classes(docs, id_col, text_col, memory)
    return members.join(classes, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _losers_and_contents(memory: int):
    """A task's distinct contents, dealt by digest, and the rows that lost within it."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        def emptied(held: Table) -> Iterator[tuple]:
            for digest, content, _, (points, doc_id, row) in held.entries:
                yield digest, row, None if doc_id == _LAST else doc_id, -points, content

        lost: list = []
        held = Table(lost)
        for row, doc_id, text in rows:
            content = normalised(text)
            held.add(hashlib.sha256(content).digest(), content, 1, rank(len(text.decode()), doc_id, row))
            if lost:
                loser = lost.pop()[2]  # dealt by its number, so that no group's losers are one task's
                yield loser.to_bytes(8, signed=True), loser, None, None, None
            if held.size >= memory:
                yield from emptied(held)
                held = Table(lost)
        yield from emptied(held)

    return run


def _losers(memory: int):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        beaten: list[int] = []

        def records() -> Iterator[tuple]:
            for digest, row, doc_id, points, content in rows:
                if content is None:
                    beaten.append(row)
                else:
                    yield digest, content, 1, rank(points, doc_id, row)

        lost: list = []
        for _ in grace(records(), memory, lost=lost):
            pass
        yield from ((row,) for row in beaten)
        yield from ((row,) for _, _, row in lost)

    return run


def losers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = TABLE_BYTES) -> DataFrame:
    """Numbers of the rows that do not stay; ``docs`` comes from :func:`with_rows`."""
    given = numbered(docs, id_col, text_col)
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("at", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("points", pa.int64()), ("content", pa.binary())])
    rows = map_rows(given, _losers_and_contents(memory), schema, "at binary, row long, doc_id long, points long, content binary")
    dealt = rows.repartition(max(shuffled, -(-total // PARTITION_BYTES)), "at")
    return map_rows(dealt, _losers(memory), pa.schema([(ROW, pa.int64())]), f"{ROW} long")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The surviving rows with all their columns. Contents are shuffled once and not
    written; rows move only where those that go are too many to broadcast."""
    given = with_rows(docs)
    return drop_rows(given, losers(given, id_col, text_col))


def op10_grace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
