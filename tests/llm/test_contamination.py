"""Benchmark windows in documents against sets of word tuples."""

import hashlib
import random
import re

import pytest
from edge_cases import edge_rows, key, sorted_rows
from pyspark.sql import functions as F

from cohortpulse.llm import contamination as c

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words_of(text):
    return WORD.findall("".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or ""))


def plain(docs, items, window=10):
    held = {}
    for item, text in items:
        words = words_of(text)
        width = min(window, len(words))
        for k in range(len(words) - width + 1 if words else 0):
            held.setdefault(tuple(words[k : k + width]), set()).add(item)
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for k in range(len(words)):
            for width in range(1, window + 1):
                if k + width <= len(words) and (items_ := held.get(tuple(words[k : k + width]))):
                    hit.update(range(k, k + width))
                    found |= {str(i) for i in items_ if i is not None}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=key)


def cases():
    random.seed(11)
    say = lambda n, of=40: " ".join(random.choice(["W", "w", "é"]) + str(random.randrange(of)) for _ in range(n))
    items = [(k, say(random.choice([0, 1, 3, 9, 10, 11, 40]), 400)) for k in range(60)]
    items += [(100, None), (None, say(14, 400)), (101, "one, TWO"), (101, items[0][1]), (102, "!!! ..."), (103, say(3000, 4000)), (104, items[7][1]), (105, "7")]
    docs = [(r[0], r[1]) for r in edge_rows()]
    for k in range(80):
        parts = [say(random.randrange(30), 400)]
        for _ in range(random.randrange(4)):
            words = (random.choice(items)[1] or "").split()
            a = random.randrange(len(words) + 1)
            parts += [" - ".join(words[a : a + random.choice([5, 9, 10, 25, 60])]), say(random.randrange(12), 400)]
        docs.append((k, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("block_bytes", [c.BLOCK_BYTES, 6000])
def test_hits(spark, tmp_path, block_bytes):
    docs, items = cases()
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("x")).repartition(3).write.parquet(str(tmp_path / "d"))
    found = c.scan(spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = found.select("doc_id", "n_words", c.n_hit(), F.size("items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256), F.size("spans") > 0)
    assert sorted_rows(got) == plain(docs, items)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(c, "hash", lambda w: 5, raising=False)
    windows = c.WindowSet([("a", b"x y z"), ("b", b"u v w")], 10)
    assert windows.hits([b"u", b"v", b"w", b"q", b"r", b"s"]) == ([(0, 3)], {"b"})


def test_removal(spark, tmp_path, edge, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, f"Before. {item.upper()}! After"), (2, "clean text"), (2, "clean text"), (3, None), (4, item.replace(" ", ", ") + " " + item)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(0)).repartition(2).write.parquet(str(tmp_path / "d"))
    given, benchmark = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = c.without_documents(given, benchmark)
    assert kept.columns == given.columns and sorted_rows(kept.select("doc_id", "text")) == sorted([docs[1], docs[2], docs[3]], key=key)
    cut = c.without_spans(given, benchmark)
    assert cut.columns == given.columns
    assert sorted_rows(cut.select("doc_id", "text")) == sorted([(1, "Before. ! After"), *docs[1:4], (4, "")], key=key)
    nothing = benchmark.limit(0)
    assert sorted_rows(c.without_spans(edge, nothing).select("doc_id", "text")) == sorted_rows(edge.select("doc_id", "text"))
    assert c.scan(empty, benchmark).count() == c.without_spans(empty, benchmark).count() == c.without_documents(empty, nothing).count() == 0
