"""Exact, near and passage deduplication against plain counterparts."""

import random

import brute
import numpy as np
import pytest
from edge_cases import edge_rows, key, sorted_rows
from pyspark.sql import functions as F

from cohortpulse.llm import grace, simhash, suffixes


def test_exact_groups(edge):
    got = sorted_rows(grace.exact_groups(edge))
    assert got == sorted(brute.exact(edge_rows()), key=key)
    assert sum(r[3] for r in got) == len({r[4] for r in got})


def test_exact_with_little_memory_spills_and_agrees(edge):
    assert sorted_rows(grace.exact_groups(edge, memory=1)) == sorted_rows(grace.exact_groups(edge))


def test_drop_exact_keeps_one_row_and_all_columns(edge):
    left = grace.drop_exact(edge)
    assert left.columns == edge.columns
    contents = [brute.BLANK.sub("", r.text or "") for r in left.collect()]
    assert len(contents) == len(set(contents)) == len({brute.BLANK.sub("", r[1] or "") for r in edge_rows()})


def test_grace_recursion_and_probing():
    import hashlib

    def record(k):
        content = f"text {k}".encode()
        return hashlib.sha256(content).digest(), content, 1, (0, k, k)

    records = [record(k % 700) for k in range(3000)]
    found = list(grace.grace(records, memory=2000))
    assert len(found) == 700
    assert sum(e[2] for e in found) == 3000
    held = grace.Table()
    held.add(b"d" * 32, b"one", 1, (0,))
    with pytest.raises(ValueError):
        held.add(b"d" * 32, b"other", 1, (0,))


def test_near_groups(edge):
    got = simhash.near_groups(edge)
    want = sorted(brute.near(edge_rows()), key=key)
    assert sorted_rows(got.select("doc_id", "fingerprint", "component_id")) == want
    kept = got.filter("kept").count()
    assert kept == got.select("component_id").distinct().count() == simhash.drop_near(edge, 4).count()


def test_fingerprint_of_many_words():
    random.seed(3)
    for n in (0, 1, 3, 4, 5, 300):
        text = " \n".join(random.choice(["Ab", "ÄB", "c,", "dd"]) + str(random.randrange(9)) for _ in range(n))
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute.simhash(text)


def planted_codes(n=400):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
    near = codes[: n // 2].copy()
    for k in range(len(near)):
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    return np.unique(np.concatenate([codes, near, near[:40] ^ np.uint64(3)]))


def classes_of(codes, pairs):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in pairs:
        root[find(a)] = find(b)
    return sorted(sorted(c for c in codes if find(c) == r) for r in {find(c) for c in codes})


def test_gray_index_finds_all_within_the_radius():
    codes = planted_codes()
    want = classes_of(codes.tolist(), [(a, b) for a in codes.tolist() for b in codes.tolist() if a < b and (a ^ b).bit_count() <= 4])
    got = sorted(sorted(x.tolist()) for x in simhash.GrayIndex(codes).classes(4))
    assert got == want
    index = simhash.GrayIndex(codes)
    for q in codes[:50]:
        want = {c for c in codes.tolist() if (c ^ int(q)).bit_count() <= 4}
        assert {int(index.codes[k]) for k in index.search(np.array([q]), 4)} == want


def test_links_over_buckets(spark):
    codes = planted_codes()
    signed = codes.view(np.int64)
    df = spark.createDataFrame([(int(c),) for c in signed], "code long")
    got = [tuple(r) for r in simhash.links(df).collect()]
    mask = (1 << 64) - 1
    want = [(a, b) for a in codes.tolist() for b in codes.tolist() if a < b and (a ^ b).bit_count() <= 4]
    assert classes_of(codes.tolist(), [(a & mask, b & mask) for a, b in got]) == classes_of(codes.tolist(), want)


def test_connected_follows_long_chains(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (103, 102)]
    got = {r.v: r.l for r in simhash.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 102, 103: 102}


@pytest.mark.parametrize("many", [4096, 1])
def test_repeated_passages(edge, many):
    got = suffixes.without_repeats(edge, many=many).select("doc_id", "n_removed", "n_spans", F.sha2("remaining", 256))
    assert sorted_rows(got) == sorted(brute.repeats(edge_rows(), suffixes.SPAN), key=key)


@pytest.mark.parametrize("many", [100, 2])
def test_repeated_passages_at_random(spark, tmp_path, many):
    random.seed(11)
    pool = ["".join(random.choices("abc ", k=random.randrange(20, 160))) for _ in range(9)]
    docs = [(k, "".join(random.choices(pool, k=random.randrange(1, 5)))) for k in range(150)]
    docs += [(200, "ab" * 200), (201, "ba" * 150), (202, "é" * 90)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    given = spark.read.parquet(str(tmp_path / "d"))
    got = suffixes.without_repeats(given, span=60, gram=16, many=many)
    assert sorted_rows(got.select("doc_id", "n_removed", "n_spans", F.sha2("remaining", 256))) == sorted(brute.repeats(docs, 60), key=key)


def test_query_of_repeated_passages_has_the_input_sizes(spark, tmp_path):
    docs = [(1, None), (2, "é" * 3), (3, "x" + "passage " * 60), (4, "passage " * 60 + "ü"), (4, "a" * 500), (None, "b" * 399)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = suffixes.op1_suffix_dedup(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    want = [(d, len((t or "").encode()), *r[1:]) for (d, t), r in zip(docs, brute.repeats(docs, suffixes.SPAN), strict=True)]
    assert sorted_rows(got) == sorted(want, key=key)


def test_suffix_order_survives_a_lying_hash(monkeypatch):
    random.seed(2)
    texts = [bytes(random.choices(b"ab", k=120)) for _ in range(40)]
    group = suffixes.Surroundings(texts, np.full(40, 20), span=100, reach=20)
    starts = np.array([0, 3, 4, 20])
    rows, shared = group.order(starts, True)
    group.sums[:] = 0  # every extension now seems common
    again, same = group.order(starts, True)
    assert again.tolist() == rows.tolist() and same.tolist() == shared.tolist()
    for a, b in zip(starts, [3, 4, 20, 40]):
        assert [texts[k][20:] for k in rows[a:b]] == sorted(texts[k][20:] for k in range(a, b))


def test_nothing_from_nothing(empty):
    assert grace.exact_groups(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert suffixes.without_repeats(empty).count() == 0
    assert grace.drop_exact(empty).columns == empty.columns
