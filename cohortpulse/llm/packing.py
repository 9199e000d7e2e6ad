"""Best-fit decreasing packing of documents' tokens into windows of fixed size.

A document's ids are first cut into full windows and a rest. Pieces are dealt at
random into groups of about :data:`GROUP` and each group is packed by itself, so no
task sees more than a group at once; a group leaves less than one window half empty.
Within a group pieces come longest first and each goes to the open window with the
least room that still takes it, found in a segment tree indexed by room left.

Only lengths and checksums move; ids stay where they are made. Null and empty texts
have the document end alone. Repeated rows are packed once each. An empty table
gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import map_rows, numbered, stored, table
from cohortpulse.llm.tokens import END, document_ids, pieces_of, vocabulary_path

WINDOW = 2048
#: Pieces that are packed together.
GROUP = 2048

_PIECES = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
)
_PIECES_DDL = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = pa.schema([*list(_PIECES)[1:], ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PLACED_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Rooms:
    """Open windows by the room they have left: a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = self.leaves + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``length``, removed."""
        at = self.leaves + length
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        sequence = self.open[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, sequence


def best_fit(lengths: Iterable[int], window: int) -> Iterator[tuple[int, int]]:
    """Window number and offset of each length, which come longest first."""
    rooms, opened = Rooms(window), 0
    for length in lengths:
        found = rooms.take(length)
        if found is None:
            room, sequence, opened = window, opened, opened + 1
        else:
            room, sequence = found
        if room > length:
            rooms.put(room - length, sequence)
        yield sequence, window - room


def cut(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", end: int | None = END) -> DataFrame:
    """Pieces of every text, each at most a window long, with their checksums."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, doc_id, text in rows:
            ids = document_ids(vocabulary, text, end)
            for start, piece in pieces_of(ids, window):
                yield row, doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids)

    return map_rows(numbered(docs, id_col, text_col), run, _PIECES, _PIECES_DDL)


def packed(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Each piece with its ``sequence_id`` and ``offset``; ``pieces`` must be stored."""
    groups = -(-pieces.count() // group) or 1

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, members in itertools.groupby(rows, key=lambda r: r[0]):
            ours, theirs = itertools.tee(members)
            for piece, (sequence, offset) in zip(ours, best_fit((p[3] for p in theirs), window), strict=True):
                yield *piece[1:], (key << 32) + sequence, offset

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(groups))).repartition("bucket")
    ordered = dealt.sortWithinPartitions("bucket", F.desc("length"), "doc_id", "start", "row")
    return map_rows(ordered.select("bucket", *_PLACED.names[:-2]), run, _PLACED, _PLACED_DDL)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    return packed(stored(cut(docs, vocabulary, window), "pieces"), window)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary_path())
