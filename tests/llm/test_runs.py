"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from edge_cases import edge_rows, key, sorted_rows
from pyspark.sql import functions as F

from cohortpulse.llm import runs


def plain_runs(words):
    """Runs by comparing the words with themselves shifted by each period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        k = 0
        while k + q < len(words):
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            stretch = start, k + q
            if k + q - start >= max(6, 4 * q) and stretch not in found:
                found[stretch] = q  # a shorter period came first
    # a stretch with a multiple of a run's period lies in that run
    return sorted(
        ((a, b - a, q) for (a, b), q in found.items() if not any(c <= a and b <= d and p < q and q % p == 0 for (c, d), p in found.items())),
        key=lambda r: (r[0], r[2]),
    )


def plain_rows(rows):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain_runs(words)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        left = b" ".join(w for k, w in enumerate(words) if k not in gone)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((doc_id, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_of_random_words(letters):
    random.seed(letters)
    for _ in range(400):
        words = []
        while len(words) < random.randrange(1, 120):
            piece = [b"w%d" % random.randrange(letters) for _ in range(random.randrange(1, 9))]
            words += piece * random.choice([1, 1, 2, 4, 5, 9])
            words += piece[: random.randrange(len(piece) + 1)]
        assert runs.runs_of(words) == plain_runs(words)


def test_tree_extensions_and_ranks():
    random.seed(3)
    for _ in range(100):
        s = [random.randrange(1, 4) for _ in range(random.randrange(1, 60))]
        tree = runs.SuffixTree(s)
        suffixes = [s[k:] for k in range(len(s) + 1)]
        assert np.argsort(tree.rank).tolist() == sorted(range(len(s) + 1), key=lambda k: suffixes[k])
        turned = tree.turned_ranks()
        assert np.argsort(turned).tolist() == sorted(range(len(s) + 1), key=lambda k: [-x for x in suffixes[k]])
        a, b = (np.array([random.randrange(len(s) + 1) for _ in range(50)]) for _ in range(2))
        for x, y, n in zip(a, b, tree.common(a, b)):
            shared = 0
            while max(x, y) + shared < len(s) and s[x + shared] == s[y + shared]:
                shared += 1
            assert x == y or n == shared


def test_regions_leave_plain_prose_alone():
    random.seed(9)
    words = [b"w%d" % int(random.paretovariate(1)) for _ in range(5000)]
    found = runs.regions(words)
    assert sum(b - a for a, b in found) < 2000
    assert runs.runs_of(words) == plain_runs(words)


def test_query_rows(spark, tmp_path, empty):
    random.seed(6)
    texts = [" ".join(random.choice("abc") for _ in range(random.randrange(200))) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(r[0], r[1]) for r in edge_rows() if len(r[1] or "") < 5000]
    rows += [(900, "x " * 5000), (901, ("a b " * 300 + "c ") * 5), (902, "é ß " * 50), (902, "é ß " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted_rows(runs.op11_periodic_runs(spark, str(tmp_path))) == sorted(plain_rows(rows), key=key)
    assert runs.find_runs(empty).count() == 0


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted_rows(runs.op11_periodic_runs(spark, folder)) == sorted(plain_rows(rows), key=key)
