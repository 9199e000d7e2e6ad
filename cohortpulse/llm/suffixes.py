"""Removal of repeated passages: a suffix sort whose comparisons are hash look-ups.

A byte goes when a string of ``SPAN`` bytes that covers it also starts anywhere else in
the corpus. Any two equal strings have equal *anchors*: the ``GRAM``-byte gram with the
smallest hash among their grams, at the same offset. So suffixes are sorted only at
anchors, about two in every 337 bytes, and only where an anchor's gram occurs twice. An
anchor's surroundings reach as far as the strings whose smallest hash it has.

*Sort.* The suffixes to the right of equal anchors, and those to the left read
backwards, are each merge-sorted. Prefix sums of a polynomial hash give the hash of any
extension in constant time and bisection over its length gives the longest common
one, hence a comparison takes a logarithm of the length. What the order rests on is
then compared byte by byte; should a hash have lied, the bytes are sorted instead.
*Decision.* Common extensions of neighbours bound those of any two anchors, so the
offsets at which some other anchor shares all ``SPAN`` bytes follow from the two orders.
All strings that anchor an occurrence contain it, so they cover one run, given by the
smallest and the largest such offset.

*Scale.* Anchors that agree on all bytes around them, as in copied documents, are one
suffix with a count, known by a 128-bit BLAKE2 digest. An anchor with more than
``MANY`` different surroundings, such as a passage that a third of the documents share,
is not sorted in one task: its offsets are cut into 7 ranges and each occurrence is keyed
by the text that all strings of a range share, counted by digest (128 bits) like any large
aggregate. A range is settled for those that agree, by 64 more bits, with another one on
everything its strings cover. Only the smallest and the largest shared offset matter, so
ranges between settled ones are dropped, and only what occurs twice beyond them goes on,
with one of each kind of its partners: those that share a key are sorted as above, and
only keys with more than ``MANY`` kinds are cut again, down to the strings themselves.

Null text counts as empty; texts shorter than ``SPAN`` lose nothing. Repeated rows are
documents of their own and so remove each other's long texts. An empty table gives an
empty result; other columns are ignored. Row numbers hold for every scan.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import ROW, batches, map_rows, numbered, rows_of, stored, table, with_rows
from cohortpulse.sources.sinks import temporary_table

SPAN = 400
GRAM = 64
#: Offsets an anchor can have within a string of SPAN bytes run from 0 to this.
REACH = SPAN - GRAM
#: Most different surroundings of an anchor that one task sorts.
MANY = 4096
#: Ranges that a round cuts offsets into; three rounds reach single offsets.
CUTS = 7
#: Anchors whose surroundings are held in memory at a time.
TOGETHER = 2048

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@functools.cache
def _values() -> np.ndarray:
    """An odd 64-bit value for each byte, by a fixed rule."""
    x = np.arange(1, 257, dtype=np.uint64) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x | _U(1)


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(4096, 1 << n.bit_length()))


def _sliding(x: np.ndarray, width: int, reduce: np.ufunc, pad: int) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours."""
    n = len(x)
    y = np.full(-(-n // width) * width, pad, x.dtype)
    y[:n] = x
    y = y.reshape(-1, width)
    forth = reduce.accumulate(y, axis=1).ravel()
    back = reduce.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(back[: n - width + 1], forth[width - 1 : n])


def anchors(text: bytes, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and gram hashes of a text's anchors, grams whose hash is the smallest in
    some string of ``span`` bytes, and the smallest and largest offset they have in such
    strings. Equal smallest hashes are all anchors."""
    n = len(text)
    if n < span:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none, none
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_values()[np.frombuffer(text, np.uint8)] * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    width = span - gram + 1
    least = _sliding(h, width, np.minimum, 2**64 - 1)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    places = np.flatnonzero(_sliding(padded, width, np.maximum, 0) == h)
    # strings with one smallest hash are runs; a place anchors those of its run that hold it
    ends = np.append(np.flatnonzero(least[1:] != least[:-1]), len(least) - 1).tolist()
    values = least[ends].tolist()
    low, high, k = [], [], 0
    for at, value in zip(places.tolist(), h[places].tolist()):
        while ends[k] < at - width + 1:
            k += 1
        j = k
        while values[j] != value:
            j += 1
        first = ends[j - 1] + 1 if j else 0
        low.append(at - min(ends[j], at))
        high.append(at - max(first, at - width + 1))
    return places, h[places], np.array(low, np.int64), np.array(high, np.int64)


class Surroundings:
    """Texts around anchors: row k holds ``left[k]`` bytes before column ``reach`` and
    ``right[k]`` from there on. Prefix sums give hashes of extensions both ways."""

    def __init__(self, texts: list[bytes], left: np.ndarray, span: int = SPAN, reach: int = REACH):
        self.span, self.reach = span, reach
        self.left = left.astype(np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.right = sizes - self.left
        self.bytes = np.zeros((len(texts), reach + span), np.uint8)
        columns = np.arange(reach + span)
        first = (reach - self.left)[:, None]
        inside = (columns >= first) & (columns < first + sizes[:, None])
        self.bytes[inside] = np.frombuffer(b"".join(texts), np.uint8)
        values = _values()[self.bytes] * powers(reach + span)[0][: reach + span]
        self.sums = np.zeros((len(texts), reach + span + 1), np.uint64)
        np.cumsum(values, axis=1, out=self.sums[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray, forward: bool, exact: bool) -> np.ndarray:
        """Length of the common extension of rows a and b to one side."""
        size = self.right if forward else self.left
        most = np.minimum(size[a], size[b])
        if exact:
            x, y = self._side(a, forward), self._side(b, forward)
            differ = (x != y) | (np.arange(x.shape[1]) >= most[:, None])
            return np.where(differ.any(axis=1), differ.argmax(axis=1), most)
        low, high = np.zeros(len(a), np.int64), most.copy()
        at_a, at_b = self.sums[a, self.reach], self.sums[b, self.reach]
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            end = self.reach + middle if forward else self.reach - middle
            same = self.sums[a, end] - at_a == self.sums[b, end] - at_b
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def _side(self, rows: np.ndarray, forward: bool) -> np.ndarray:
        return self.bytes[rows, self.reach :] if forward else self.bytes[rows, self.reach - 1 :: -1][:, : self.reach]

    def less(self, a: np.ndarray, b: np.ndarray, forward: bool, exact: bool) -> np.ndarray:
        """Whether row a comes before row b; equal extensions go by row."""
        n = self.common(a, b, forward, exact)
        size = self.right if forward else self.left
        end_a, end_b = n >= size[a], n >= size[b]
        column = np.clip(self.reach + n if forward else self.reach - 1 - n, 0, self.bytes.shape[1] - 1)
        byte_a, byte_b = self.bytes[a, column], self.bytes[b, column]
        return np.where(end_a | end_b, np.where(end_a & end_b, a < b, end_a), byte_a < byte_b)

    def order(self, starts: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each group in suffix order, and the common extension of each with
        the row before it (0 at a group's start)."""
        for exact in (False, True):
            rows = self._merge_sort(starts, forward, exact)
            shared = np.zeros(len(rows), np.int64)
            inner = np.ones(len(rows), bool)
            inner[starts] = False
            at = np.flatnonzero(inner)
            shared[at] = self.common(rows[at - 1], rows[at], forward, exact)
            if exact or self._holds(rows, at, shared[at], forward):
                break
        return rows, shared

    def _holds(self, rows: np.ndarray, at: np.ndarray, shared: np.ndarray, forward: bool) -> bool:
        """Whether neighbours share the bytes that their hashes say, and are in order."""
        for part in range(0, len(at), 512):
            p = at[part : part + 512]
            x, y = self._side(rows[p - 1], forward), self._side(rows[p], forward)
            if ((x != y) & (np.arange(x.shape[1]) < shared[part : part + 512, None])).any():
                return False
            if not self.less(rows[p - 1], rows[p], forward, True).all():
                return False
        return True

    def _merge_sort(self, starts: np.ndarray, forward: bool, exact: bool) -> np.ndarray:
        n = len(self.left)
        sizes = np.diff(np.append(starts, n))
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        rows, place = np.arange(n), np.arange(n) - start
        width, widest = 1, int(sizes.max(initial=0))
        while width < widest:
            run = place // width
            sibling = (run ^ 1) * width
            low = np.minimum(sibling, size)
            first = low.copy()
            high = np.minimum(sibling + width, size)
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                before = self.less(rows[start[open_] + middle], rows[open_], forward, exact)
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            moved = np.empty_like(rows)
            moved[start + (run & ~1) * width + place % width + low - first] = rows
            rows, width = moved, 2 * width
        return rows


def covers(group: Surroundings, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the bytes before it and from it on that strings shared with
    another anchor of its group cover; both 0 if there are none."""
    n, span, reach = len(group.left), group.span, group.reach
    least, most = np.full(n, reach + 1), np.full(n, -1)
    right_rows, right_shared = group.order(starts, True)
    left_rows, left_shared = group.order(starts, False)
    ends = np.append(starts[1:], n)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        m = b - a
        right, left = right_shared[a + 1 : b], left_shared[a + 1 : b]
        # an offset range begins or ends at a neighbour's extension
        offsets = np.unique(np.concatenate([span - right, left]))
        offsets = offsets[(offsets >= 0) & (offsets <= reach)]
        if m == 2:
            if left[0] + right[0] >= span:
                most[a:b], least[a:b] = min(left[0], reach), max(span - right[0], 0)
            continue
        for part in range(0, len(offsets), 64):
            d = offsets[part : part + 64, None]
            both = np.zeros((len(d), m), np.int64)
            both[:, right_rows[a:b] - a] = np.cumsum(np.concatenate([np.zeros((len(d), 1), bool), right[None] < span - d], axis=1), axis=1) * m
            both[:, left_rows[a:b] - a] += np.cumsum(np.concatenate([np.zeros((len(d), 1), bool), left[None] < d], axis=1), axis=1)
            turn = np.argsort(both, axis=1, kind="stable")
            ranked = np.take_along_axis(both, turn, axis=1)
            same = ranked[:, 1:] == ranked[:, :-1]
            twice = np.zeros((len(d), m), bool)
            twice[:, 1:] = same
            twice[:, :-1] |= same
            good = np.zeros((len(d), m), bool)
            np.put_along_axis(good, turn, twice, axis=1)
            good &= (group.left[None, a:b] >= d) & (group.right[None, a:b] >= span - d)
            most[a:b] = np.maximum(most[a:b], np.where(good, d, -1).max(axis=0))
            least[a:b] = np.minimum(least[a:b], np.where(good, d, reach + 1).min(axis=0))
    found = most >= 0
    return np.where(found, most, 0), np.where(found, span - least, 0)


_ANCHORS = pa.schema(
    [("row", pa.int64()), ("at", pa.int64()), ("gram", pa.int64()), ("around1", pa.int64()), ("around2", pa.int64()), ("left", pa.int32()), ("right", pa.int32())]
)
_ANCHORS_DDL = "row long, at long, gram long, around1 long, around2 long, left int, right int"
_CLASS = ["gram", "around1", "around2"]
_COVER = pa.schema([(c, pa.int64()) for c in _CLASS] + [("before", pa.int32()), ("after", pa.int32())])
_COVER_DDL = "gram long, around1 long, around2 long, before int, after int"


def _digest(left: int, text: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16, salt=left.to_bytes(4, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def find_anchors(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Anchors of numbered texts with a digest of the bytes that their strings cover."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, _, text in rows:
            places, hashes, low, high = anchors(text, span, gram)
            for at, h, a, b in zip(places.tolist(), hashes.view(np.int64).tolist(), low.tolist(), high.tolist()):
                # the strings it anchors cover these bytes before and after it
                left, right = b, span - a
                yield row, at, h, *_digest(left, text[at - left : at + right]), left, right

    return map_rows(docs, run, _ANCHORS, _ANCHORS_DDL)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The surroundings of wanted anchors (row, at, gram, around1, around2, left, right, hot)."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("at", *_CLASS, "left", "right", "hot")).alias("anchors"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, found in rows:
            for a in found:
                at, left = a["at"], a["left"]
                yield a["gram"], a["around1"], a["around2"], left, text[at - left : at + a["right"]], a["hot"]

    schema = pa.schema([*[(c, pa.int64()) for c in _CLASS], ("left", pa.int32()), ("around", pa.binary()), ("hot", pa.bool_())])
    joined = docs.join(lists.hint("shuffle_hash"), "row").select("text", "anchors")
    return map_rows(joined, run, schema, "gram long, around1 long, around2 long, left int, around binary, hot boolean")


def _sorted_covers(span: int, reach: int):
    """Task over surroundings sorted by gram and what follows the first five columns:
    covers of each, a few groups at a time."""

    def group_of(row: tuple) -> tuple:
        return row[0], *row[5:]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(held: list[tuple]) -> Iterator[tuple]:
            starts = [0, *(k for k in range(1, len(held)) if group_of(held[k]) != group_of(held[k - 1]))]
            before, after = covers(Surroundings([h[4] for h in held], np.array([h[3] for h in held]), span, reach), np.array(starts))
            yield from ((*h[:3], b, a) for h, b, a in zip(held, before.tolist(), after.tolist()) if a)

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []
            for _, group in itertools.groupby(rows_of(stream), key=group_of):
                held += group
                if len(held) >= TOGETHER:
                    yield from solved(held)
                    held = []
            if held:
                yield from solved(held)

        yield from batches(_COVER, rows())

    return run


def _strings(first: int, last: int, cuts: int) -> list[tuple[int, int]]:
    """Ranges of offsets, as even as can be."""
    edges = np.linspace(first, last + 1, min(cuts, last + 1 - first) + 1).round().astype(int).tolist()
    return [(a, b - 1) for a, b in itertools.pairwise(edges)]


def _round(
    texts: DataFrame, settled: DataFrame | None, open_: DataFrame | None, hold: Callable, span: int, reach: int, cuts: int, many: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of what occurrences share, range by range of their open offsets.

    ``settled`` has the smallest and largest offset known to be shared, per class
    (``bottom, top``), and ``open_`` the ranges that the round before left; at first every
    occurrence has the whole range. Of a range, the offsets ``low`` to ``high`` have
    strings within the document. The range is settled for the occurrences that have a
    partner with the same bytes in all of these. Where only the text common to its strings
    has another occurrence, it stays open if it reaches beyond the class's settled offsets;
    of each kind of other occurrences of that text one goes on with it. Up to ``many`` kinds
    of one text are sorted here. Gives what is settled, the covers found by sorting, and the
    ranges left open, all held.
    """
    ranges = F.array(F.struct(F.lit(0).alias("first"), F.lit(reach).alias("last")))
    if open_ is None:
        given = texts.withColumn("ranges", ranges)
    else:
        given = texts.join(open_, _CLASS)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *key, left, around, wanted in rows:
            for w in wanted:
                for first, last in _strings(w["first"], w["last"], cuts):
                    # offsets whose strings lie within the document
                    low, high = max(first, left + span - len(around)), min(last, left)
                    if low <= high:
                        core = _digest(0, around[left - first : left - last + span])
                        hull = _digest(high, around[left - high : left - low + span])
                        yield *key, first, last, low, high, *core, hull[0]

    names = [*_CLASS, "first", "last", "low", "high", "core1", "core2", "hull"]
    kinds = ["long"] * 3 + ["int"] * 4 + ["long"] * 3
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.int32()) for n, k in zip(names, kinds)])
    ddl = ", ".join(map(" ".join, zip(names, kinds)))
    core = ["gram", "first", "last", "core1", "core2"]
    # tables, so that the joins sort both sides anew and can split a hot key
    with temporary_table(map_rows(given.select(*_CLASS, "left", "around", "ranges"), run, schema, ddl), "ranges") as keyed:
        one = F.min(F.struct(*_CLASS, "low", "high")).alias("one")
        kinds = keyed.groupBy(*core, "hull").agg(one, F.count("*").alias("n")).select(*core, "hull", "n", "one.around1", "one.around2", "one.low", "one.high")
        with temporary_table(kinds, "kinds") as kinds:
            sure = keyed.join(kinds.filter("n > 1").select(*core, "hull"), [*core, "hull"], "left_semi")
            sure = _extremes(sure.select(*_CLASS, F.col("high").alias("top"), F.col("low").alias("bottom")))
            settled = hold(sure if settled is None else _extremes(settled.unionByName(sure)), "settled")
            wide = kinds.filter("first < last")
            alone = wide.filter("n = 1").join(settled, _CLASS, "left").filter("top is null or high > top or low < bottom")
            several = wide.groupBy(*core).agg(F.count("*").alias("hulls")).filter("hulls > 1")
            # one of each kind goes on as a partner of those that are not settled
            with temporary_table(several.join(alone.select(*core), core, "left_semi"), "cores") as cores:
                few = wide.join(cores.filter(F.col("hulls") <= many).select(*core), core, "left_semi").select(*_CLASS, *core[1:])
                together = texts.join(few, _CLASS).select(*_CLASS, "left", "around", *core[1:])
                together = together.repartition(*core).sortWithinPartitions(*core, "around1", "around2")
                by_sort = hold(together.mapInArrow(_sorted_covers(span, reach), _COVER_DDL), "sorted")
                left = wide.join(cores.filter(F.col("hulls") > many).select(*core), core, "left_semi")
                left = left.groupBy(*_CLASS).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
                return settled, by_sort, hold(left, "open")


def _extremes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_CLASS).agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"))


def _counted_covers(texts: DataFrame, hold: Callable, span: int, reach: int, many: int, cuts: int = CUTS) -> list[DataFrame]:
    """Covers of anchors with many surroundings, by counting shared texts and by sorting
    those that share one."""
    settled = open_ = None
    parts = []
    width = reach + 1
    while True:
        settled, by_sort, open_ = _round(texts, settled, open_, hold, span, reach, cuts, many)
        parts.append(by_sort)
        if width <= 1 or not open_.limit(1).count():
            break
        width = -(-width // cuts)
    return [settled.select(*_CLASS, F.col("top").alias("before"), (F.lit(span) - F.col("bottom")).alias("after")), *parts]


def repeated(docs: DataFrame, span: int = SPAN, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """Byte ranges ``row, begin, end`` of numbered texts that strings of ``span`` bytes
    with another occurrence cover; ranges of a row may overlap. The tables of the steps
    between are removed once the covers are written."""
    reach = span - gram
    given = docs.withColumnRenamed(ROW, "row")
    found = stored(find_anchors(given, span, gram), "anchors")
    with ExitStack() as steps:
        steps.enter_context(_files_let_go(docs.sparkSession))

        def hold(df: DataFrame, name: str) -> DataFrame:
            return steps.enter_context(temporary_table(df, name))

        alike = hold(
            found.groupBy(*_CLASS).agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("one"), F.first("left").alias("left"), F.first("right").alias("right")),
            "alike",
        )
        grams = hold(alike.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "grams")
        several = grams.select("gram", (F.col("kinds") > many).alias("hot"))
        wanted = alike.join(several, "gram").select("one.row", "one.at", *_CLASS, "left", "right", "hot")
        texts = hold(_texts(given, wanted), "surroundings")
        by_gram = texts.filter("not hot").drop("hot").repartition("gram").sortWithinPartitions("gram", "around1", "around2")
        parts = [hold(by_gram.mapInArrow(_sorted_covers(span, reach), _COVER_DDL), "sorted")]
        hot = texts.filter("hot").drop("hot")
        if hot.limit(1).count():
            parts += _counted_covers(hot, hold, span, reach, many)
        parts.append(alike.filter("n > 1").select(*_CLASS, F.col("left").alias("before"), F.col("right").alias("after")))
        cover = functools.reduce(DataFrame.union, parts).groupBy(*_CLASS).agg(F.max("before").alias("before"), F.max("after").alias("after"))
        cover = stored(cover, "cover")
    return found.join(cover, _CLASS).select("row", (F.col("at") - F.col("before")).alias("begin"), (F.col("at") + F.col("after")).alias("end"))


@contextmanager
def _files_let_go(spark: SparkSession) -> Iterator[None]:
    """Lets Spark delete a step's shuffle files when its table is written; the files of
    all steps together would be several times the input."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def remaining(text: bytes, ranges: list) -> tuple[bytes, int, int]:
    """What is left of a text without the ranges, bytes removed, and maximal runs."""
    kept, removed, runs, at = [], 0, 0, 0
    for begin, end in sorted((r["begin"], r["end"]) for r in ranges or []):
        if begin > at or not runs:
            runs += 1
            kept.append(text[at:begin])
            removed += end - begin
            at = end
        elif end > at:
            removed += end - at
            at = end
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """``row, doc_id, remaining, n_removed, n_spans`` of every row; ``remaining`` is
    the bytes that stay, which need not be UTF-8 where a cut splits a character."""
    given = numbered(with_rows(docs), id_col, text_col)
    ranges = repeated(given, span, gram, many).groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, doc_id, text, found in rows:
            yield row, doc_id, *remaining(text, found)

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("remaining", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
    joined = given.withColumnRenamed(ROW, "row").join(ranges.hint("shuffle_hash"), "row", "left")
    return map_rows(joined.select("row", "doc_id", "text", "ranges"), run, schema, "row long, doc_id long, remaining binary, n_removed long, n_spans long")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = without_repeats(table(spark, folder, "documents"))
    n_bytes = F.octet_length("remaining") + F.col("n_removed")
    return left.select("doc_id", n_bytes.alias("n_bytes"), "n_removed", "n_spans", F.sha2("remaining", 256).alias("kept_sha256"))
