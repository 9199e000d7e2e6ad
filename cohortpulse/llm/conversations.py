"""Conversation structure repair: rank-convergence parallel Viterbi.

A repaired conversation is empty, or an optional system turn followed by pairs of a user
and an assistant turn. Its rows, in order, are kept, given another role or deleted, and
empty turns are inserted; :func:`before` gives the costs. What can still come depends on
the state alone: nothing yet, a system turn last, a user turn last, an assistant turn last.

*Viterbi backwards.* A vector holds, for each state, the cost of the cheapest edits of all
rows from here on. Vectors that differ only by a constant drive the same edits, so they
are kept less their minimum, and as few exist, steps are looked up.
*Chunks.* Rows are range-partitioned and sorted by conversation and turn, so a long
conversation spreads over partitions. What lies inside a partition and has at most
``CHUNK`` rows is repaired on the spot. The rest is cut into chunks. Each starts from a
speculative vector, that of a conversation's end; a fix-up pass reruns the chunks whose
follower begins with another vector, from right to left until the vectors differ only by
constants. Passes go on until none changes, nearly always after one or two.
*Tracing.* With the stitched vectors the least edits, in ASCII order, are read off forwards;
a chunk maps each state it may start in to the one it ends in, and a scan over a
conversation's chunks says which it is.

Repeats are found by the first place of each role and text (BLAKE2, 128 bits) in a
conversation, an aggregate joined back by place, so no frequent text is a hot key. A
conversation's SHA-256 is sequential by nature: the last step streams its chunks' finished
bytes, one row per chunk, through one task.

Null conversation ids are one conversation; null turns come first; null roles and texts
are one space, hence blank texts and roles that cannot be kept. Rows of one turn keep the
order they are stored in. Repeated rows are rows; a text seen before is a duplicate.
Conversations without rows have an empty result. An empty table gives an empty result.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortpulse.llm.common import ROW, map_rows, stored, table, with_rows

#: Most rows and characters of text in a chunk.
CHUNK = 4096
CHUNK_TEXT = 8 << 20

NONE, SYSTEM, USER, ASSISTANT = range(4)
#: State after the turn that must come next, and after a kept turn by its role.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({NONE: SYSTEM}, {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
ROLES = ("", "", "user", "assistant")
#: Codes of rows: role (s, u, a, other), plus TRUNCATED, or one of those to be deleted.
TRUNCATED, BLANK, DUPLICATE = 4, 8, 9
DELETE, INSERT, REROLE, CUT_SHORT = 3, 2, 2, 1
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
#: Costs of what must still be added where a conversation ends, by state.
END = (0, 2 * INSERT, INSERT, 0)


def _edits(code: int, state: int, after: tuple) -> Iterator[tuple[str, int, int]]:
    """Edits of a row: initial, state they lead to, cost with all that follows."""
    yield "D", state, DELETE + after[state]
    if code < BLANK:
        extra = CUT_SHORT if code & TRUNCATED else 0
        if state in KEPT[code & 3]:
            kept = KEPT[code & 3][state]
            yield "K", kept, extra + after[kept]
        yield "R", NEXT[state], REROLE + extra + after[NEXT[state]]


@functools.cache
def before(code: int, after: tuple) -> tuple[tuple, int]:
    """Vector before a row of this code from the one after it, less its minimum, and
    the minimum."""
    costs = [min(c for _, _, c in _edits(code, state, after)) for state in range(4)]
    for _ in range(2):  # at most two turns are worth inserting
        costs = [min(c, INSERT + costs[NEXT[state]]) for state, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs), least


@functools.cache
def move(code: int, after: tuple, state: int) -> tuple[str, int]:
    """Least cheapest edits, up to that of the row itself, and the state they lead to."""
    vector, least = before(code, after)
    done = ""
    while True:
        best = [("I", NEXT[state])] if INSERT + vector[NEXT[state]] == vector[state] else []
        best += [(e, to) for e, to, cost in _edits(code, state, after) if cost - least == vector[state]]
        edit, state = min(best)
        done += edit
        if edit != "I":
            return done, state


def vectors(codes: bytes, end: tuple) -> tuple[list[tuple], int]:
    """Vectors after each row, preceded by the one before the first, and the sum of their
    minima."""
    out, total = [end], 0
    for code in reversed(codes):
        vector, least = before(code, out[-1])
        out.append(vector)
        total += least
    return out[::-1], total


def fix_up(codes: bytes, old_end: tuple, new_end: tuple, head: tuple, total: int) -> tuple[tuple, int]:
    """Head and total for another end, rerun until both vectors differ by a constant."""
    old, new = old_end, new_end
    for code in reversed(codes):
        if old == new:
            return head, total
        old, less = before(code, old)
        new, more = before(code, new)
        total += more - less
    return new, total


def traced(codes: bytes, after: list[tuple], state: int, last: bool) -> tuple[list[str], int]:
    """Edits of each row, with those at a conversation's end, and the state at the end."""
    edits = []
    for code, vector in zip(codes, after[1:]):
        done, state = move(code, vector, state)
        edits.append(done)
    if last:
        edits.append("I" * (END[state] // INSERT))
    return edits, state


def repaired(edits: list[str], state: int, codes: bytes, roles: list[str], texts: list[str]) -> list[str]:
    """Turns ``role:text`` that the edits leave."""
    out = []
    for k, done in enumerate(edits):
        for edit in done:
            if edit == "I":
                state = NEXT[state]
                out.append(f"{ROLES[state]}:")
            elif edit == "K":
                state = KEPT[codes[k] & 3][state]
                out.append(f"{roles[k]}:{texts[k]}")
            elif edit == "R":
                state = NEXT[state]
                out.append(f"{ROLES[state]}:{texts[k]}")
    return out


def code_of(role: str, text: str) -> int:
    """Code of a row by itself."""
    seen = text.rstrip(WHITE)
    if not seen:
        return BLANK
    # an empty initial is found at 0 by str.find
    place = "sua".find(role[:1]) if role else -1
    return (place if place >= 0 else 3) + (0 if seen[-1] in ".!?" else TRUNCATED)


def digest(role: str, text: str) -> bytes:
    whole = f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")
    return hashlib.blake2b(whole, digest_size=16).digest()


class Summary:
    """Turns and neighbouring roles of consecutive rows, added up from left to right."""

    def __init__(self):
        self.least = self.most = None
        self.distinct = self.illegal = 0
        self.last = None

    def add(self, least, most, distinct, illegal, first, last) -> None:
        if distinct:
            self.distinct += distinct - (self.most is not None and self.most == least)
            self.least, self.most = least if self.least is None else self.least, most
        if self.last is not None and self.last + first not in LEGAL:
            self.illegal += 1
        self.illegal += illegal
        self.last = last

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.distinct


def summary_of(turns: list, roles: list[str]) -> tuple:
    """Least and greatest turn, distinct turns, illegal neighbours, first and last initial."""
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))
    return known[0] if known else None, known[-1] if known else None, len(set(known)), illegal, initials[0], initials[-1]


_FINISHED = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
_OPEN = [("least", "long"), ("most", "long"), ("distinct", "long"), ("inner", "long"), ("first", "string"), ("last", "string"), ("codes", "binary"), ("digests", "array<binary>"), ("roles", "array<string>"), ("texts", "array<string>")]
_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()),
}


def _mapped(df: DataFrame, function, fields: list[tuple[str, str]]) -> DataFrame:
    return map_rows(df, function, pa.schema([(n, _KINDS[k]) for n, k in fields]), ", ".join(f"`{n}` {k}" for n, k in fields))


def counted(codes: bytes) -> tuple[int, int, int]:
    """Blank, duplicate and truncated rows."""
    return codes.count(BLANK), codes.count(DUPLICATE), sum(TRUNCATED <= c < BLANK for c in codes)


def solved(codes: bytes, turns: list, roles: list[str], texts: list[str]) -> tuple:
    """All results of a conversation that is in one piece."""
    whole = Summary()
    whole.add(*summary_of(turns, roles))
    after, total = vectors(codes, END)
    edits, _ = traced(codes, after, NONE, True)
    text = "\n".join(repaired(edits, NONE, codes, roles, texts)).encode()
    return whole.gaps, *counted(codes), whole.illegal, total + after[0][NONE], "".join(edits), hashlib.sha256(text).hexdigest()


def _segments(most: int):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        def closed(conv, part, k, held, whole) -> tuple:
            turns, roles, texts = zip(*held)
            codes, seen, digests = bytearray(map(code_of, roles, texts)), set(), []
            for at, code in enumerate(codes):
                d = None if code == BLANK else digest(roles[at], texts[at])
                if d in seen:
                    codes[at], d = DUPLICATE, None
                elif d is not None:
                    seen.add(d)
                digests.append(d)
            codes = bytes(codes)
            if whole:
                return conv, part, k, *solved(codes, turns, roles, texts), *[None] * len(_OPEN)
            return conv, part, k, *[None] * len(_FINISHED), *summary_of(turns, roles), codes, digests, list(roles), list(texts)

        k, part, first = 0, None, True
        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            if part is not None and held:
                yield closed(before_, part, k, held, not (first or long))
                k, first = k + 1, False
            before_, held, size, long = conv, [], 0, False
            for _, part, turn, role, text in group:
                if len(held) >= most or size > CHUNK_TEXT:
                    yield closed(conv, part, k, held, False)
                    k, held, size, long = k + 1, [], 0, True
                held.append((turn, role, text))
                size += len(text)
        if part is not None and held:  # it may go on in the next partition
            yield closed(before_, part, k, held, False)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of the contract's test: by a hash of conversation and turn some are
    dropped, emptied, cut short, repeated or given the user's role."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", either("conv_id"), either("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(either("text"), "[.!?]", "")).otherwise(either("text"))
    times = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.filter(fate != 0)
    number = [ROW] if ROW in conversations.columns else []
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(either("role")).alias("role"), text.alias("text"), *number, F.explode(times).alias("again"))


def _duplicates(chunks: DataFrame) -> DataFrame:
    """``conv, part, k, codes`` of chunks, rows seen in an earlier chunk marked too."""
    places = chunks.select("conv", "part", "k", F.posexplode("digests").alias("at", "digest")).filter("digest is not null")
    firsts = places.groupBy("conv", "digest").agg(F.min(F.struct("part", "k", "at")).alias("p"))
    known = firsts.groupBy("p.part", "p.k").agg(F.collect_list(F.col("p.at").cast("long")).alias("firsts"))
    given = chunks.select("conv", "part", "k", "codes").join(known, ["part", "k"], "left").select("conv", "part", "k", "codes", "firsts")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, k, codes, firsts in rows:
            firsts = set(firsts or ())
            yield conv, part, k, bytes(c if c >= BLANK or at in firsts else DUPLICATE for at, c in enumerate(codes))

    return _mapped(given, run, [("conv", "string"), ("part", "int"), ("k", "int"), ("codes", "binary")])


_VECTORS = [("conv", "string"), ("part", "int"), ("k", "int"), ("codes", "binary"), ("end", "array<long>"), ("head", "array<long>"), ("total", "long"), ("moved", "boolean")]


def stitched(coded: DataFrame) -> DataFrame:
    """Chunks (conv, part, k, codes) with the true vectors at their ends and heads, each
    less its minimum, and what their rows add to it."""

    def speculate(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, k, codes in rows:
            after, total = vectors(codes, END)
            yield conv, part, k, codes, list(END), list(after[0]), total, True

    def rerun(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, k, codes, end, head, total, follower in rows:
            follower = list(END) if follower is None else follower
            if follower == end:
                yield conv, part, k, codes, end, head, total, False
            else:
                new, total = fix_up(codes, tuple(end), tuple(follower), tuple(head), total)
                yield conv, part, k, codes, follower, list(new), total, True

    found = stored(_mapped(coded.select("conv", "part", "k", "codes"), speculate, _VECTORS), "vectors")
    order = Window.partitionBy("conv").orderBy("part", "k")
    while True:
        # only places and vectors go through the window; rows meet by their place
        heads = found.select("part", "k", F.lead("head").over(order).alias("follower"))
        given = found.drop("moved").join(heads, ["part", "k"]).select(*[n for n, _ in _VECTORS[:-1]], "follower")
        found = stored(_mapped(given, rerun, _VECTORS), "vectors")
        if not found.filter("moved").limit(1).count():
            return found


def _started(vectors_: DataFrame) -> DataFrame:
    """``part, k, start, final`` of each chunk: the state in which it starts, by the states
    that the chunks before it lead to, and whether it is its conversation's last."""

    def leads(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, k, codes, end in rows:
            after, _ = vectors(codes, tuple(end))
            yield conv, part, k, [traced(codes, after, state, False)[1] for state in range(4)]

    maps = _mapped(vectors_.select("conv", "part", "k", "codes", "end"), leads, [("conv", "string"), ("part", "int"), ("k", "int"), ("to", "array<long>")])
    lists = maps.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "k", "to"))).alias("chunks")).select("chunks")

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (chunks,) in rows:
            state = NONE
            for n, chunk in enumerate(chunks, 1):
                yield chunk["part"], chunk["k"], state, n == len(chunks)
                state = chunk["to"][state]

    return _mapped(lists, scan, [("part", "int"), ("k", "int"), ("start", "long"), ("final", "boolean")])


_PARTS = [("conv", "string"), ("part", "int"), ("k", "int"), *_OPEN[:6], ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("cost", "long"), ("audit", "string"), ("turns", "long"), ("bytes", "binary")]


def _finished(chunks: DataFrame) -> DataFrame:
    """Results of the conversations of open chunks."""
    found = stitched(stored(_duplicates(chunks), "codes"))
    placed = found.select("part", "k", "codes", "end", "head", "total").join(_started(found), ["part", "k"])
    given = chunks.drop("codes", "digests").join(placed, ["part", "k"])

    def emit(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, k, *summary, roles, texts, codes, end, head, total, start, final in rows:
            after, _ = vectors(codes, tuple(end))
            edits, _ = traced(codes, after, start, final)
            out = repaired(edits, start, codes, roles, texts)
            yield conv, part, k, *summary, *counted(codes), total, head[NONE], "".join(edits), len(out), "\n".join(out).encode()

    fields = [*_PARTS[:13], ("head", "long"), *_PARTS[13:]]
    names = ["conv", "part", "k", *[n for n, _ in _OPEN[:6]], "roles", "texts", "codes", "end", "head", "total", "start", "final"]
    parts = _mapped(given.select(*names), emit, fields).repartition("conv").sortWithinPartitions("conv", "part", "k")

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            whole, sha, sums, cost, audit, turns = Summary(), hashlib.sha256(), [0, 0, 0], None, [], 0
            for _, _, _, *rest in group:
                whole.add(*rest[:6])
                *counts, total, head, edits, n, text = rest[6:]
                cost = (head if cost is None else cost) + total
                sums = [a + b for a, b in zip(sums, counts)]
                audit.append(edits)
                if n:
                    sha.update(b"\n" + text if turns else text)
                    turns += n
            yield conv, whole.gaps, *sums, whole.illegal, cost, "".join(audit), sha.hexdigest()

    return _mapped(parts, fold, [("conv", "string"), *_FINISHED])


def repair(rows: DataFrame, ids: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per id of ``ids`` (conv_id): faults found in ``rows`` (conv_id, turn, role,
    text, and ROW and ``again`` to order rows of one turn) and their cheapest repair."""
    order = [c for c in (ROW, "again") if c in rows.columns]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), *order)
    sorted_ = given.repartitionByRange("conv", "turn", *order).sortWithinPartitions("conv", "turn", *order)
    placed = sorted_.select("conv", F.spark_partition_id().alias("part"), "turn", "role", "text")
    found = stored(_mapped(placed, _segments(chunk), [("conv", "string"), ("part", "int"), ("k", "int"), *_FINISHED, *_OPEN]), "segments")
    names = [n for n, _ in _FINISHED]
    done = found.filter("codes is null").select("conv", *names)
    open_ = found.filter("codes is not null").select("conv", "part", "k", *[n for n, _ in _OPEN])
    results = done.union(_finished(open_))
    wanted = ids.select("conv_id").distinct()
    joined = wanted.join(results, wanted.conv_id.cast("string").eqNullSafe(results.conv), "left")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select("conv_id", *[F.coalesce(n, F.lit(nothing.get(n, 0)).cast(k)).alias(n) for n, k in _FINISHED])


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    given = with_rows(table(spark, folder, "conversations"))
    return repair(damaged(given), given)
