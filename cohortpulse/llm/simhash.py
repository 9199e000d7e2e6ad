"""SimHash near-duplicates: a Gray-order hierarchical index over fingerprints.

A fingerprint has 64 bits, each set where more than half of the hashed word shingles
set it. Two documents are linked when their fingerprints differ in at most
``RADIUS`` bits, and a document's class is what links reach.

*Routing.* Distinct fingerprints are copied once for each pair of six bit blocks;
as four differences leave two blocks untouched, linked fingerprints meet under one
such key, and no key is common by design. *Index.* The fingerprints under a key are
sorted by Gray rank, so that neighbours share bits. Upper nodes hold the bits on
which all below agree, less those their parent holds; a search adds up differences
downwards and drops a node with all below it once they exceed the radius. Found
fingerprints leave the index, hence a dense group costs one visit per member and
yields one link per member, never all pairs. *Classes.* Links of all keys are joined
by minimum labels with pointer jumping, each round written to the shared folder.

Null and empty texts have fingerprint zero and link like any other. Repeated rows
have one fingerprint and one class. The class id is the smallest ``doc_id`` (null if
it has none). An empty table gives an empty result; other columns are ignored.

*Near copies by similarity* (:func:`drop_similar`). Documents are linked when their sets of
word shingles have a Jaccard similarity of ``SIMILARITY`` or more. ``BANDS`` keys of
``PER_BAND`` minimum hashes each route a set; at 0.8 a pair misses all of them once in
half a million cases. A second 64-bit fingerprint holds one bit of each of 64 minimum hashes, so a
pair at 0.8 differs in 6.4 bits on average and the Gray-order index finds candidates
within ``WIDE`` bits. Every candidate is decided by the exact sets. First each member of
a bucket is held against the smallest one; then all candidates that this has not
connected. So a dense group costs about one comparison per member and bucket.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import ROW, drop_rows, keep_rows, map_rows, numbered, stored, table, with_rows

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Widths of the bit blocks, from the lowest bit; RADIUS of them may differ.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Children of a node, and queries that go down the index together.
FAN = 8
TOGETHER = 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Similarity from which on sets are near copies, and the search for them.
SIMILARITY = 0.8
BANDS = 25
PER_BAND = 4
WIDE = 18

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each word shingle; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxh64_intdigest(joined, SEED)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[:n].tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist())], "<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit number."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if n <= 1:
        return int(hashes.view("<i8")[0]) if n else 0
    tally = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    bits = 2 * (tally @ _BITS).ravel() > n
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Row number, ``doc_id`` and fingerprint of every row."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, doc_id, text in rows:
            yield row, doc_id, fingerprint(text, shingle)

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("code", pa.int64())])
    return map_rows(numbered(docs, id_col, text_col), run, schema, "row long, doc_id long, code long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order of the reflected Gray code."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Hierarchy over distinct codes in Gray order; levels run from leaves to root."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.fan = fan
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        every, some, alive = self.codes, self.codes, np.ones(len(codes), np.int64)
        levels = [(every, some, alive)]
        while len(every) > fan:
            cuts = np.arange(0, len(every), fan)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            alive = np.add.reduceat(alive, cuts)
            levels.append((every, some, alive))
        self.alive = [a for _, _, a in levels]
        agreed = [~(e ^ s) for e, s, _ in levels]
        self.pattern = [e for e, _, _ in levels]
        # bits that a node adds to those its parent already compares
        self.own = [
            m & ~np.repeat(agreed[k + 1], fan)[: len(m)] if k + 1 < len(agreed) else m for k, m in enumerate(agreed)
        ]

    def search(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Leaves still in the index within the radius of any of the queries."""
        top = len(self.own) - 1
        q, node = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(len(self.own[top])), indexing="ij"))
        far = np.zeros(len(q), np.int64)
        for level in range(top, -1, -1):
            far = far + np.bitwise_count((queries[q] ^ self.pattern[level][node]) & self.own[level][node])
            near = (far <= radius) & (self.alive[level][node] > 0)
            q, node, far = q[near], node[near], far[near]
            if level:
                child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                inside = child < len(self.own[level - 1])
                q, far, node = np.repeat(q, self.fan)[inside], np.repeat(far, self.fan)[inside], child[inside]
        return np.unique(node)

    def remove(self, leaves: np.ndarray) -> None:
        for level in range(len(self.alive)):
            np.subtract.at(self.alive[level], leaves // self.fan**level, 1)

    def classes(self, radius: int) -> Iterator[np.ndarray]:
        """Codes of each set connected by steps within the radius."""
        for seed in range(len(self.codes)):
            if not self.alive[0][seed]:
                continue
            found, waiting = [], [np.array([seed])]
            self.remove(waiting[0])
            while waiting:
                leaves = waiting.pop()
                found.append(leaves)
                for at in range(0, len(leaves), TOGETHER):
                    more = self.search(self.codes[leaves[at : at + TOGETHER]], radius)
                    if len(more):
                        self.remove(more)
                        waiting.append(more)
            yield self.codes[np.concatenate(found)]


def links_of(codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smallest member, other member) of each class among distinct codes."""
    if len(codes) == 2:
        if np.bitwise_count(codes[0] ^ codes[1]) <= radius:
            signed = np.sort(codes.view(np.int64))
            yield signed[:1], signed[1:]
        return
    for members in GrayIndex(codes).classes(radius):
        if len(members) > 1:
            signed = np.sort(members.view(np.int64))
            yield np.full(len(signed) - 1, signed[0]), signed[1:]


def masks(blocks: tuple[int, ...], radius: int) -> list[int]:
    """Signed bit masks of every choice of blocks that must agree for one key."""
    starts = [0, *itertools.accumulate(blocks)]
    block = [((1 << w) - 1) << s for w, s in zip(blocks, starts)]
    unsigned = [sum(c) for c in itertools.combinations(block, len(blocks) - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def _bucket_links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in itertools.chain(stream, [None]):
            if batch is not None:
                keep = [np.concatenate([k, c.to_numpy()]) for k, c in zip(keep, batch.columns)]
            mask, key, code = keep
            if not len(code):
                continue
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(np.append(starts, len(code)))
            whole = len(starts) - (batch is not None)  # the last bucket may go on
            out = [np.empty((2, 0), np.int64)]
            two = starts[:whole][sizes[:whole] == 2]
            near = two[np.bitwise_count((code[two] ^ code[two + 1]).view(np.uint64)) <= radius]
            out.append(np.sort(np.stack([code[near], code[near + 1]]), axis=0))
            for k in np.flatnonzero(sizes[:whole] > 2):
                members = np.ascontiguousarray(code[starts[k] : starts[k] + sizes[k]]).view(np.uint64)
                out += [np.stack(pair) for pair in links_of(members, radius)]
            pairs = np.concatenate(out, axis=1)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)
            left = int(starts[whole]) if whole < len(starts) else len(code)
            keep = [mask[left:], key[left:], code[left:]]

    return run


def links(codes: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Links ``a < b`` whose connected sets are the classes of distinct ``code``."""
    given = masks(blocks, radius)
    copies = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(given)])
    keyed = codes.select("code", F.explode(copies).alias("at")).select("at.mask", "at.key", "code")
    buckets = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "code")
    return buckets.mapInArrow(_bucket_links(radius), "a long, b long").distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """Smallest member reachable from each node of stored ``pairs`` (a, b):
    minimum labels of neighbours and pointer jumping until nothing changes."""
    both = stored(pairs.union(pairs.select("b", "a")).toDF("u", "v"), "links")
    labels = stored(both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    while True:
        least = both.join(labels, "v").groupBy("u").agg(F.min("l").alias("m"))
        lower = labels.join(least, labels.v == least.u).select("v", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        lower = stored(lower, "labels")
        jumped = lower.join(lower.select(F.col("v").alias("x"), F.col("l").alias("y")), F.col("l") == F.col("x"))
        labels = stored(jumped.select("v", F.col("y").alias("l"), (F.col("y") != F.col("old")).alias("moved")), "labels")
        if not labels.filter("moved").limit(1).count():
            return labels.select("v", "l")
        labels = labels.select("v", "l")


def classes(rows: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Class of each distinct ``code`` of stored rows: ``code, component_id, keep_row``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    codes = stored(rows.groupBy("code").agg(first), "codes")
    labels = connected(stored(links(codes.select("code"), radius, blocks), "links"))
    placed = codes.join(labels.select(F.col("v").alias("code"), "l"), "code", "left").select(
        "code", F.coalesce("l", "code").alias("root"), "first"
    )
    placed = stored(placed, "placed")
    roots = placed.groupBy("root").agg(F.min("first").alias("first"))
    return placed.select("code", "root").join(roots, "root").select(
        "code", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep_row")
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` of every row."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = stored(classes(rows, radius), "classes")
    return rows.join(found, "code").select(
        "doc_id",
        F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("row") == F.col("keep_row")).alias("kept"),
    )


_RNG = np.random.default_rng(SEED)
_TIMES, _PLUS = (_RNG.integers(0, 2**63, (BANDS * PER_BAND, 1), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def minima(hashes: np.ndarray, step: int = 2048) -> np.ndarray:
    """Smallest value of a set under each of ``BANDS * PER_BAND`` hash functions."""
    parts = [((hashes[at : at + step] ^ _PLUS) * _TIMES).min(axis=1) for at in range(0, len(hashes), step)]
    return np.minimum.reduce(parts)


def band_keys(least: np.ndarray) -> tuple[int, list[int]]:
    """Fingerprint of a set and the keys of its buckets, as signed numbers."""
    from xxhash import xxh64_intdigest

    code = np.packbits((least[:64] >> np.uint64(32)).astype(np.uint8) & 1, bitorder="little").view("<i8")[0]
    whole = least.tobytes()
    width = 8 * PER_BAND
    keys = [xxh64_intdigest(whole[k * width : (k + 1) * width], k) for k in range(BANDS)]
    return int(code), np.array(keys, np.uint64).view(np.int64).tolist()


def set_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """Row number, ``doc_id``, digest of the shingle set, fingerprint and bucket keys."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, doc_id, text in rows:
            held = np.unique(shingle_hashes(text, shingle))
            code, keys = band_keys(minima(held)) if len(held) else (0, [])
            yield row, doc_id, hashlib.blake2b(held.tobytes(), digest_size=16).digest(), code, keys

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("code", pa.int64()), ("keys", pa.list_(pa.int64()))])
    return map_rows(numbered(docs), run, schema, "row long, doc_id long, digest binary, code long, keys array<long>")


def _by_bucket(function, schema: pa.Schema):
    """``mapInArrow`` over rows sorted by their first column: ``function`` takes the
    columns of whole buckets and the buckets' starts, and yields columns."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[np.ndarray] = []
        for batch in itertools.chain(stream, [None]):
            if batch is not None:
                new = [c.to_numpy() for c in batch.columns]
                keep = [np.concatenate(pair) for pair in zip(keep, new)] if keep else new
            if not keep or not len(keep[0]):
                continue
            key = keep[0]
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            left = len(key) if batch is None else int(starts[-1])  # the last bucket may go on
            starts = starts[starts < left]
            if len(starts):
                for columns in function([c[:left] for c in keep], starts):
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)
            keep = [c[left:] for c in keep]

    return run


def _crowded(columns: list[np.ndarray], starts: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Buckets of several members, each beside the bucket's first member."""
    key, node, code = columns
    sizes = np.diff(np.append(starts, len(key)))
    first = np.repeat(starts, sizes)
    several = np.repeat(sizes > 1, sizes)
    yield [c[several] for c in (key, node, code, node[first], code[first])]


def _unconnected(columns: list[np.ndarray], starts: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Pairs of a bucket within ``WIDE`` bits that have different labels."""
    _, node, code, label = columns
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
        if (label[a:b] == label[a]).all():
            continue
        codes, which = np.unique(code[a:b].view(np.uint64), return_inverse=True)
        index = GrayIndex(codes)
        place = np.searchsorted(codes, index.codes)
        members = np.argsort(which, kind="stable")
        begins = np.searchsorted(which[members], np.arange(len(codes) + 1))
        for k in range(len(codes)):
            near = place[index.search(codes[k : k + 1], WIDE)]
            found = np.concatenate([members[begins[j] : begins[j + 1]] for j in near.tolist()])
            for own in members[begins[k] : begins[k + 1]].tolist():
                other = found[(node[a:b][found] > node[a + own]) & (label[a:b][found] != label[a + own])]
                yield [np.full(len(other), node[a + own]), node[a:b][other]]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_CROWDED = pa.schema([(c, pa.int64()) for c in ("key", "node", "code", "first", "first_code")])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) whose exact sets are at least so similar; ``sets`` is (node, held)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, one, other in rows:
            one, other = np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")
            if min(len(one), len(other)) < similarity * max(len(one), len(other)) - 1e-9:
                continue
            common = len(np.intersect1d(one, other, assume_unique=True))
            if common >= similarity * (len(one) + len(other) - common) - 1e-9:
                yield a, b

    of = lambda name, held: sets.select(F.col("node").alias(name), F.col("held").alias(held))
    given = pairs.join(of("b", "other"), "b").join(of("a", "one"), "a").select("a", "b", "one", "other")
    return map_rows(given, run, _PAIR, "a long, b long")


def similar_classes(docs: DataFrame, shingle: int, similarity: float = SIMILARITY) -> DataFrame:
    """``row, root, first`` of each distinct shingle set: its class, which verified
    links connect, and its first document. ``docs`` comes from :func:`with_rows`."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = set_rows(docs, shingle).groupBy("digest").agg(first, F.min_by("code", "row").alias("code"), F.min_by("keys", "row").alias("keys"))
    nodes = stored(nodes.select(F.col("first.row").alias("node"), "first", "code", "keys"), "sets")
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "code").repartition("key").sortWithinPartitions("key", "node")
    ddl = "key long, node long, code long, first long, first_code long"
    crowded = stored(keyed.mapInArrow(_by_bucket(_crowded, _CROWDED), ddl), "crowded")

    def held(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, _, text in rows:
            yield row, np.unique(shingle_hashes(text, shingle)).tobytes()

    wanted = crowded.select(F.col("node").alias(ROW)).distinct()
    texts = numbered(docs).join(wanted.hint("shuffle_hash"), ROW, "left_semi")
    sets = stored(map_rows(texts, held, pa.schema([("node", pa.int64()), ("held", pa.binary())]), "node long, held binary"), "held")

    near = F.bit_count(F.col("code").bitwiseXOR(F.col("first_code"))) <= WIDE
    tried = stored(crowded.filter(near & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    sure = stored(verified(tried, sets, similarity), "links")
    labels = connected(sure)
    members = crowded.select("key", "node", "code").join(labels.withColumnRenamed("v", "node"), "node", "left")
    members = members.select("key", "node", "code", F.coalesce("l", "node").alias("label")).repartition("key").sortWithinPartitions("key", "node")
    rest = members.mapInArrow(_by_bucket(_unconnected, _PAIR), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    more = stored(verified(stored(rest, "pairs"), sets, similarity), "links")
    if more.limit(1).count():
        labels = connected(stored(sure.union(more), "links"))
    placed = nodes.join(labels.withColumnRenamed("v", "node"), "node", "left")
    return placed.select("node", F.coalesce("l", "node").alias("root"), "first")


def drop_near(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each class of near copies by fingerprints, the one with the smallest
    ``doc_id``, with all its columns."""
    given = with_rows(docs)
    rows = stored(fingerprints(given, shingle=shingle), "fingerprints")
    others = rows.join(classes(rows, radius), "code").filter("row != keep_row")
    return drop_rows(given, others.select(F.col("row").alias(ROW)))


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near copies by similarity, the one with the smallest
    ``doc_id``, with all its columns."""
    given = with_rows(docs)
    kept = similar_classes(given, shingle, similarity).groupBy("root").agg(F.min("first").alias("first"))
    return keep_rows(given, kept.select(F.col("first.row").alias(ROW)))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"))
