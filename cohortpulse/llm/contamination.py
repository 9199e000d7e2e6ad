"""Benchmark decontamination: token windows of documents against a broadcast hash set.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A
window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words is
one window. A task hashes all windows of a document at once, as sums of word hashes
times powers of a constant, asks a bit map, then the sorted hashes, and compares the
words themselves before it believes a hit. A word inside any occurrence is hit; hits are
given as spans, by which text is cut or documents are dropped.

*Size.* The hash set goes to every task, so what is sent is bounded: the benchmark is
dealt by hash into blocks of about ``BLOCK_BYTES`` of words (long items are cut into
pieces that overlap by a window less a word), and the documents are scanned once per
block. Benchmarks are small, so there is nearly always one block, and then no shuffle.
Several blocks' hits, a few rows, meet by row number. A window that many items
share is in a block's set once, with the list of its items.

Null and empty texts have no words: such items have no window, such documents no hit.
Null item ids hit words but are not listed; rows with one id are one item. Repeated
documents are documents of their own. An empty benchmark hits nothing; an empty table
gives an empty result. Other columns, whatever their names, are ignored, or kept as they
are by ``without_spans`` and ``without_documents``.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import ROW, drop_rows, map_rows, numbered, stored, table, with_rows, without_rows

WINDOW = 10
#: Bytes of benchmark words aimed at in one broadcast, and words of a piece of an item.
BLOCK_BYTES = 16 << 20
PIECE = 1000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TIMES = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def window_hashes(words: list[bytes], widths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each width with a hash of every window that wide, in this process only."""
    n = len(words)
    each = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(min(n, max(widths, default=0))):
        total[: n - j] += each[j:] * np.uint64(pow(_TIMES, j + 1, 1 << 64))
        if j + 1 in widths:
            mixed = total[: n - j] ^ (total[: n - j] >> np.uint64(29))
            yield j + 1, mixed * np.uint64(_TIMES) + np.uint64(j)


class WindowSet:
    """Windows of a benchmark block: their hashes, words and items."""

    def __init__(self, pieces: list[tuple], window: int):
        held: dict[tuple, list] = {}
        for item, joined in pieces:
            words = joined.split()
            width = min(window, len(words))
            for k in range(len(words) - width + 1):
                held.setdefault(tuple(words[k : k + width]), []).append(item)
        self.words = list(held)
        self.items = [sorted({i for i in items if i is not None}) for items in held.values()]
        self.widths = set(map(len, self.words))
        hashes = np.array([int(next(window_hashes(list(w), {len(w)}))[1][0]) for w in self.words], np.uint64)
        self.turn = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.turn]
        bits = max(10, min(26, (16 * len(hashes)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[hashes >> self.shift] = True

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs of hit words (first, end) and the items that occur."""
        n = len(words)
        edge, found = None, set()
        for width, hashes in window_hashes(words, self.widths):
            for at in np.flatnonzero(self.map[hashes >> self.shift]).tolist():
                k = int(np.searchsorted(self.hashes, hashes[at]))
                while k < len(self.hashes) and self.hashes[k] == hashes[at]:
                    entry = int(self.turn[k])
                    if self.words[entry] == tuple(words[at : at + width]):
                        edge = np.zeros(n + 1, np.int64) if edge is None else edge
                        edge[at] += 1
                        edge[at + width] -= 1
                        found.add(entry)
                        break
                    k += 1
        if edge is None:
            return [], set()
        covered = np.cumsum(edge) > 0
        turns = np.flatnonzero(np.diff(np.concatenate([[False], covered]).astype(np.int8)))
        return list(zip(turns[::2].tolist(), turns[1::2].tolist())), {i for e in found for i in self.items[e]}


@functools.lru_cache(1)
def _window_set(pickled: bytes, window: int) -> WindowSet:
    return WindowSet(pickle.loads(pickled), window)


def pieces_of(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, words, block`` of every piece of an item; the blocks are about alike."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item, text in rows:
            words = words_of(text)
            for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE):
                yield item, b" ".join(words[at : at + PIECE + window - 1])

    given = benchmark.select(
        F.col(f"`{id_col}`").cast("string").alias("item"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    cut = map_rows(given, run, pa.schema([("item", pa.string()), ("words", pa.binary())]), "item string, words binary")
    return cut.distinct()


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_HITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])
_HITS_DDL = "row long, doc_id long, n_words long, spans array<struct<first:long,end:long>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row, doc_id, n_words, spans, items`` of every row: spans of hit words, counted
    from 0 (``end`` is the word after), and the ids of items with occurring windows.

    ``row`` is that of :func:`with_rows` if ``docs`` has it.
    """
    pieces = stored(pieces_of(benchmark, window), "pieces")
    total = pieces.agg(F.sum(F.octet_length("words") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    given = docs if blocks == 1 or ROW in docs.columns else with_rows(docs)
    parts = [_scan_block(given, pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k), window, k == 0) for k in range(blocks)]
    if blocks == 1:
        return parts[0]
    every = stored(functools.reduce(DataFrame.union, parts), "hits")
    return every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def _scan_block(docs: DataFrame, pieces: DataFrame, window: int, all_rows: bool) -> DataFrame:
    """Hits of one block; rows without any come only with ``all_rows``."""
    held = [(r["item"], bytes(r["words"])) for r in pieces.collect()]
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(held))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        windows = _window_set(sent.value, window)
        for row, doc_id, text in rows:
            words = words_of(text)
            spans, items = windows.hits(words)
            if spans or all_rows:
                yield row, doc_id, len(words), [{"first": a, "end": b} for a, b in spans], sorted(items)

    return map_rows(numbered(docs), run, _HITS, _HITS_DDL)


def n_hit(spans: str = "spans"):
    """Words in any of the spans, which may overlap."""
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        none,
        lambda seen, s: F.struct(
            F.greatest(seen["end"], s["end"]).alias("end"),
            (seen["n"] + F.greatest(s["end"] - F.greatest(seen["end"], s["first"]), F.lit(0).cast("long"))).alias("n"),
        ),
        lambda seen: seen["n"],
    )


def without_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns."""
    given = with_rows(docs)
    return drop_rows(given, scan(given, benchmark, window).filter(F.size("spans") > 0).select(F.col("row").alias(ROW)))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans of words: each goes from its first word's first byte to
    its last word's last one."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for first, end in sorted(spans):
        kept.append(text[at : max(at, places[first][0])])
        at = max(at, places[end - 1][1])
    return b"".join([*kept, text[at:]])


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, in their columns, their hit words cut out of ``text``."""

    @F.pandas_udf("string")
    def cut_texts(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut(t.encode(), [(s["first"], s["end"]) for s in found]).decode() for t, found in zip(texts, spans)], dtype=object)

    given = with_rows(docs)
    hit = stored(scan(given, benchmark, window).filter(F.size("spans") > 0).select(F.col("row").alias(ROW), F.col("spans").alias("__spans")), "hit")
    found = F.col("__spans").isNotNull()  # the text of other rows does not go to Python
    clean = F.when(found, cut_texts(F.when(found, F.col("text")).otherwise(""), F.coalesce("__spans", F.array()))).otherwise(F.col("text"))
    return without_rows(given.join(hit, ROW, "left").withColumn("text", clean).drop("__spans")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    counted = found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.array_sort("items").alias("items"))
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
places AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM places),
spots AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
found AS (
  SELECT s.doc_id, s.k, s.i, windows.item_id
  FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM spots) s JOIN windows USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
