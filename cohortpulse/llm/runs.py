"""Periodic runs of words: suffix trees, common extensions and Lyndon roots.

A run is a stretch of words with smallest period ``q``, at least ``TIMES`` periods and
``SHORTEST`` words long, that neither neighbour extends. All runs of a document are found.

*Regions.* Inside a run, from its second period on, every triple of words occurred at most
``q`` words before. Stretches of such triples, thinned until none is farther from its
copy than a run of the stretch's length allows, hold every run; most documents have
none, and the rest of the work is on the stretches alone.
*Roots.* A run of two periods or more holds a Lyndon word as long as its period, the longest
that starts at its place in the words' order or in the reverse order. Suffix ranks, read
off a suffix tree, give both for every place, as far as the next smaller suffix.
*Extensions.* Ukkonen's trees of the region and of its reversal are walked by Euler tours;
the least string depth on a tour between two leaves, in constant time by blocks and a
sparse table, is the longest common extension of two places to the right or the left.
The root with both extensions is the run.

A run is left where it first stands: words after its first period are dropped. Null and
empty texts have no words. Repeated rows are documents of their own. Memory follows the
words of one document. An empty table gives an empty result. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import map_rows, numbered, table

#: Least length of a run in periods and in words.
TIMES = 4
SHORTEST = 6
#: Entries of a tour that one entry of the sparse table stands for.
BLOCK = 16


class SuffixTree:
    """Ukkonen's tree of numbers with an end mark 0, which no other place has.

    ``first[k]`` is the place of suffix k's leaf in the Euler tour, ``ranks(order)`` its
    rank among the suffixes.
    """

    def __init__(self, numbers: list[int]):
        self.size = len(numbers)
        self._grow([*numbers, 0])
        self._tour()

    def _grow(self, s: list[int]) -> None:
        n = len(s)
        wide = max(s) + 1
        start, end, link = [0], [0], [0]
        edges: dict[int, int] = {}
        node = length = waiting = edge = 0
        for i, symbol in enumerate(s):
            unlinked = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * wide + s[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = 0
                else:
                    span = (end[child] if end[child] <= i else i + 1) - start[child]
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    at = start[child] + length
                    if s[at] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    fork = len(start)
                    start += (start[child], i)
                    end += (at, n)
                    link += (0, 0)
                    edges[key] = fork
                    edges[fork * wide + symbol] = fork + 1
                    edges[fork * wide + s[at]] = child
                    start[child] = at
                    if unlinked:
                        link[unlinked] = fork
                    unlinked = fork
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        below = np.fromiter(edges.values(), np.int64, len(edges))
        turn = np.argsort(keys)  # children of a node in the order of their first symbol
        self.children = below[turn].tolist()
        parents = keys[turn] // wide
        self.closing = (keys[turn] % wide == 0).tolist()  # edges that the end mark begins
        self.begin = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        self.span = (np.array(end) - np.array(start)).tolist()
        self.whole = n

    def _tour(self) -> None:
        begin, children, span, whole = self.begin, self.children, self.span, self.whole
        tour, first, rank = [0], [0] * whole, [0] * whole
        node, depth, at, leaves = 0, 0, begin[0], 0
        path: list[tuple[int, int, int]] = []
        while True:
            if at < begin[node + 1]:
                child = children[at]
                below = depth + span[child]
                if begin[child] == begin[child + 1]:
                    first[whole - below] = len(tour)
                    rank[whole - below] = leaves
                    leaves += 1
                    tour += (below, depth)
                    at += 1
                else:
                    path.append((node, depth, at + 1))
                    node, depth, at = child, below, begin[child]
                    tour.append(depth)
            elif path:
                node, depth, at = path.pop()
                tour.append(depth)
            else:
                break
        self.first, self.rank = np.array(first), rank
        blocks = -(-len(tour) // BLOCK)
        flat = np.full(blocks * BLOCK, whole, np.int32)
        flat[: len(tour)] = tour
        rows = flat.reshape(blocks, BLOCK)
        self.tour = flat
        self.forth = np.minimum.accumulate(rows, axis=1).ravel()
        self.back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while 2 ** len(self.table) <= blocks:
            half, row = 2 ** (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(row[:-half], row[half:]))

    def turned_ranks(self) -> list[int]:
        """Ranks of the suffixes when symbols count in reverse, the end mark still first."""
        begin, children, span, whole = self.begin, self.children, self.span, self.whole
        rank, leaves = [0] * whole, 0
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if begin[node] == begin[node + 1] and depth:
                rank[whole - depth] = leaves
                leaves += 1
                continue
            below = children[begin[node] : begin[node + 1]]
            if below and self.closing[begin[node]]:
                below = [*below[1:], below[0]]
            stack += [(child, depth + span[child]) for child in below]
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes a and b: least depth between their leaves."""
        x, y = self.first[a], self.first[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        bx, by = x // BLOCK, y // BLOCK
        out = np.minimum(self.back[x], self.forth[y])
        gap = by - bx - 1
        for level, row in enumerate(self.table):
            at = np.flatnonzero((gap >= 1 << level) & (gap < 2 << level))
            if len(at):
                out[at] = np.minimum(out[at], np.minimum(row[bx[at] + 1], row[by[at] - (1 << level)]))
        inside = np.flatnonzero(bx == by)
        if len(inside):
            columns = x[inside, None] + np.arange(BLOCK)
            columns = np.minimum(columns, y[inside, None])
            out[inside] = self.tour[columns].min(axis=1)
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one with a smaller rank; the last has the smallest."""
    out = [0] * len(rank)
    stack: list[int] = []
    for k, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = k
        stack.append(k)
    return np.array(out, np.int64)


def region_runs(numbers: list[int], times: int = TIMES, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers above 0."""
    n = len(numbers)
    forward = SuffixTree(numbers)
    places = np.arange(n)
    roots = []
    for rank in (forward.rank, forward.turned_ranks()):
        until = next_smaller(rank)[:n]
        fits = (until - places) * times <= n
        roots.append(np.stack([places[fits], until[fits]]))
    i, j = np.unique(np.concatenate(roots, axis=1), axis=1)
    if not len(i):
        return np.empty((0, 3), np.int64)
    right = forward.common(i, j).astype(np.int64)
    backward = SuffixTree(numbers[::-1])
    left = np.where(i > 0, backward.common(n - i, n - j), 0).astype(np.int64)
    period = j - i
    length = left + period + right
    good = (length >= shortest) & (length >= times * period)
    return np.unique(np.stack([i - left, length, period], axis=1)[good], axis=0)


def regions(words: list[bytes], times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches (first, end) of words that hold all runs."""
    n = len(words)
    if n < SHORTEST:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    triple = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + h[2:]
    turn = np.argsort(triple, kind="stable")
    again = np.flatnonzero(triple[turn[1:]] == triple[turn[:-1]])
    if not len(again):
        return []
    far = np.full(n, n, np.int64)
    far[turn[again + 1]] = turn[again + 1] - turn[again]
    inside = far < n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        first, end = edges[::2], edges[1::2]
        # a run of period q has at least (times - 1) q - 2 such triples in a row, and 3
        size = end - first
        most = (size + 2) // (times - 1)
        allowed = np.zeros(n, np.int64)
        for a, b, q, m in zip(first.tolist(), end.tolist(), most.tolist(), size.tolist()):
            if m >= 3:
                allowed[a:b] = q
        thinner = inside & (far <= allowed)
        if (thinner == inside).all():
            break
        inside = thinner
    out: list[tuple[int, int]] = []
    for a, b, q in zip(first.tolist(), end.tolist(), most.tolist()):
        a, b = max(0, a - q - 1), min(n, b + 3)
        while out and a <= out[-1][1]:
            before = out.pop()
            a, b = min(a, before[0]), max(b, before[1])
        out.append((a, b))
    return out


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's words, by start and period."""
    out = []
    for a, b in regions(words):
        names: dict[bytes, int] = {}
        numbers = [names.setdefault(w, len(names) + 1) for w in words[a:b]]
        found = region_runs(numbers)
        found[:, 0] += a
        out += found.tolist()
    return sorted(map(tuple, out), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone) if not g]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])
_FOUND_DDL = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def find_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: the runs of its words by start and
    period, and the words left, joined by one space. ``prepare`` may change the words of
    a document first."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, doc_id, text in rows:
            words = text.split()
            if prepare:
                words = prepare(doc_id, words)
            found = runs_of(words)
            listed = [{"start": s, "length": n, "period": p} for s, n, p in found]
            yield doc_id, listed, b" ".join(collapsed(words, found))

    return map_rows(numbered(docs), run, _FOUND, _FOUND_DDL)


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's test: a tenth of the documents repeat a stretch up to their end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = find_runs(table(spark, folder, "documents"), with_planted_run)
    # quotients of numbers below 2**26 are equal as doubles only if they are equal
    best = F.expr("array_max(transform(runs, r -> struct(r.length / r.period as e, -r.start as s, -r.period as p, r.length as n)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.n) div -best.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
