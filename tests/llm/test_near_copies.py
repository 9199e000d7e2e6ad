"""Near copies by exact five-word similarity, against all pairs."""

import itertools
import random

from cohortpulse.llm import simhash


def shingles(text, k=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def left_over(docs):
    """Ids that stay when links of at least 0.8 are followed."""
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, s), (b, t) in itertools.combinations(docs, 2):
        if similarity(s, t) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted({find(i) for i, _ in docs})


def stage(spark, folder, docs):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(folder))
    return sorted(r.doc_id for r in simhash.drop_similar(spark.read.parquet(str(folder))).collect())


def test_edited_copies_are_found(spark, tmp_path):
    """Pairs from 0.6 to 1, of which those from 0.8 on are near copies."""
    random.seed(6)
    docs = []
    for k in range(150):
        words = [f"w{random.randrange(5000)}" for _ in range(random.choice([60, 150, 400]))]
        docs.append((2 * k, " ".join(words)))
        for at in random.sample(range(len(words)), max(1, round(len(words) * random.uniform(0.0, 0.05)))):
            words[at] = "new"
        docs.append((2 * k + 1, " ".join(words)))
    near = [0.8 <= similarity(docs[k][1], docs[k + 1][1]) for k in range(0, 300, 2)]
    assert 50 < sum(near) < 140
    assert stage(spark, tmp_path / "d", docs) == left_over(docs)


def test_members_that_miss_the_first_one(spark, tmp_path):
    """Edits of one text that are near it but not each other, and a chain."""
    random.seed(1)
    base = [f"w{k}" for k in range(300)]
    docs = [(500, " ".join(base))]
    for k in range(40):
        words = list(base)
        for at in random.sample(range(5, 295), 6):
            words[at] = f"v{random.random()}"
        docs.append((k, " ".join(words)))
    docs += [(600 + k, " ".join(f"c{j}" for j in range(12 * k, 12 * k + 300))) for k in range(12)]
    assert stage(spark, tmp_path / "d", docs) == left_over(docs)


def test_a_dominating_repeated_line_joins_nothing(spark, tmp_path):
    """Most shingles, counted with repeats, are of one line; the sets are far apart."""
    line = "all rights reserved by the owners of this very site and its many pages "
    docs = [(k, line * 120 + " ".join(f"own{k}x{j}" for j in range(90))) for k in range(6)]
    assert similarity(docs[0][1], docs[1][1]) < 0.2
    codes = [simhash.fingerprint(t.encode(), 5) for _, t in docs]
    assert any(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in itertools.combinations(codes, 2))
    assert stage(spark, tmp_path / "d", docs) == list(range(6))
