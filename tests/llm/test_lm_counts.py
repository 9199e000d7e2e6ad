"""Bigram counts and scores against exact ones in plain Python."""

import math
import random
from collections import Counter

import pytest

from cohortpulse.llm import lm, tokens

VOCABULARY = tokens.vocabulary_path()


def test_scores_rest_on_exact_bigram_counts(spark):
    """More distinct bigrams than 2^19 hashed cells tell apart."""
    random.seed(12)
    words = ["".join(random.choices("abcdefghijklmnoprstuvw", k=random.randrange(2, 7))) for _ in range(6000)]
    docs = [(k, " ".join(random.choices(words, k=1500))) for k in range(260)] + [(300, ""), (301, None), (None, "a b a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(k,) for k in range(0, 260, 3)], "doc_id long")
    ids = [[*tokens.document_ids(VOCABULARY, (t or "").encode()).tolist()] for _, t in docs]
    pairs = {False: Counter(), True: Counter()}
    singles = {False: Counter(), True: Counter()}
    for (k, _), row in zip(docs, ids):
        for which in (False, True) if k is not None and k < 260 and k % 3 == 0 else (False,):
            pairs[which].update(zip([tokens.END, *row], row))
            singles[which].update(row)
    assert len(pairs[False]) > 100_000
    scale = singles[True].total() / singles[False].total()
    target, background = lm.models(df, good, VOCABULARY)
    got = {r.doc_id: r for r in lm.scored(df, target, background, VOCABULARY).collect()}
    assert len(got) == len(docs)

    def loss(row, which, scale):
        total = singles[which].total() * scale + lm.IDS
        parts = [
            -math.log((pairs[which][a, b] * scale + lm.PRIOR * (singles[which][b] * scale + 1) / total) / (singles[which][a] * scale + lm.PRIOR))
            for a, b in zip([tokens.END, *row], row)
        ]
        return sum(parts) / len(parts)

    for (k, _), row in zip(docs, ids):
        assert got[k].n_tokens == len(row)
        assert got[k].target_loss == pytest.approx(loss(row, True, 1.0))
        assert got[k].background_loss == pytest.approx(loss(row, False, scale))


@pytest.mark.parametrize("widths", ["own", "wide"])
def test_sized_by_the_vocabulary(spark, monkeypatch, widths):
    """Another file's ids, and ids beyond two bytes."""
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    assert lm.ids_below(path) == 50_257 and lm.ids_below(VOCABULARY) == lm.IDS
    n = 50_257 if widths == "own" else 70_000
    shift = n - 50_257
    own = tokens.document_ids
    monkeypatch.setattr(lm, "ids_below", lambda vocabulary: n)
    monkeypatch.setattr(lm, "document_ids", lambda vocabulary, text: own(vocabulary, text) + shift)
    docs = [(1, "One text, and another.  Spaces"), (2, "one text"), (3, None)]
    chunks = lm.stored(lm.chunked(lm.flagged(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")), path), "c")
    counts = {r.cell: r.background for r in lm.stored(lm._summed(lm.pairs_of(chunks, n)), "p").collect()}
    want = Counter()
    for _, text in docs:
        row = (own(path, (text or "").encode()) + shift).tolist()
        want.update(a * n + b for a, b in zip([tokens.END, *row], row))
    assert counts == dict(want)
