"""Quality classifier, mixing, top-k search, language-model scores and the pipeline."""

import math
import random
import zlib

import brute
import numpy as np
import pytest
from edge_cases import PROSE, edge_rows
from pyspark.sql import functions as F

import corpus_pipeline
from cohortpulse.llm import lm, mixing, quality, tokens, topk

VOCABULARY = tokens.vocabulary_path()


def test_features_of_any_text():
    for text in (b"", b" ", b"\n\n", "é".encode() * 10, b"a" * 100_000):
        values = quality.features(text)
        assert len(values) == len(quality.NAMES) and all(map(math.isfinite, values))


def test_trees_cut_where_the_gain_is():
    g, h = np.array([5.0, 5, -5, -5]), np.ones(4)
    one = quality._tree(g, h, 1)
    assert (one[:2] > 0).all() and (one[2:] < 0).all()
    square, gain = quality._pair_tree(np.array([[5.0, -5], [-5, 5]]), np.ones((2, 2)))
    assert gain > 0 and (np.sign(square) == [[1, -1], [-1, 1]]).all()


def test_model_learns_single_features_and_a_pair():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, len(quality.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    half = len(y) // 2
    model = quality.fit_rows(x[:half], y[:half])
    assert {(i, j) for i, j, *_ in model.pairs} & {(0, 1)}
    assert ((model.score(x[half:]) >= 0.5) == y[half:]).mean() > 0.9
    by_bins = model.base + sum(t[np.searchsorted(e, x[:5, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
    by_bins += sum(t[np.searchsorted(a, x[:5, i], side="right"), np.searchsorted(b, x[:5, j], side="right")] for i, j, a, b, t in model.pairs)
    assert np.allclose(model.margins(x[:5]), by_bins)


def test_model_without_two_classes():
    x = np.zeros((4, len(quality.NAMES)))
    assert quality.fit_rows(x, np.ones(4)).score(x)[0] == pytest.approx(0.9)
    assert quality.fit_rows(x[:0], np.ones(0)).score(x)[0] == 0.5


def test_held_out_labels_play_no_part(spark):
    ids = range(60)
    docs = spark.createDataFrame([(k, PROSE if k % 2 else "!! ## " * 9) for k in ids], "doc_id long, text string")
    held = {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in ids}
    assert {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()} == held
    given = [(k, k % 2) for k in ids if not held[k]]
    lies = [(k, 1 - k % 2) for k in ids if held[k]] + [(None, 1), (3, None), (999, 0)]
    schema = "doc_id long, quality int"
    plain = quality.fit(docs, spark.createDataFrame(given, schema))
    lied = quality.fit(docs, spark.createDataFrame(given + lies, schema))
    rows = quality.feature_rows([PROSE.encode(), b"!! ## " * 9])
    assert plain.score(rows).tolist() == lied.score(rows).tolist()
    good, bad = plain.score(rows)
    assert good > 0.5 > bad


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scored = quality.op6_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    pairs = [(a.score > b.score) + (a.score == b.score) / 2 for a in rows if a.quality for b in rows if not b.quality]
    assert sum(pairs) / len(pairs) > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_of_edge_rows(spark, edge, empty):
    model = quality.fit(edge, spark.createDataFrame([(4, 1), (16, 0)], "doc_id long, quality int"))
    scores = [r.s for r in edge.select(quality.scorer(model)(F.col("text")).alias("s")).collect()]
    assert len(scores) == len(edge_rows()) and all(0 <= s <= 1 for s in scores)
    assert quality.keep_good(edge, model, 0.0).columns == edge.columns
    assert quality.keep_good(edge, model, 0.0).count() == len(edge_rows())
    assert quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int")).score(np.zeros((1, len(quality.NAMES))))[0] == 0.5
    assert quality.keep_good(empty, model).count() == 0


TOTALS = {"a": 1000, "b": 200, "c": 50}


def test_exponent_meets_a_limit_of_passes():
    x = mixing.exponent_for(TOTALS, most_passes=2.0)
    rates = mixing.passes(TOTALS, x)
    assert max(rates.values()) == pytest.approx(2.0) and min(rates.values()) == pytest.approx(1.0)
    assert 0 < x < 1
    assert mixing.exponent_for(TOTALS, most_passes=1e9) == 0.0
    assert mixing.exponent_for(TOTALS, most_passes=1.0) == pytest.approx(1.0)
    assert mixing.exponent_for({}, most_passes=1.0) == 1.0


def test_exponent_meets_an_entropy():
    x = mixing.exponent_for(TOTALS, target_entropy=0.9)
    assert mixing.entropy(mixing.weights(TOTALS, x)) == pytest.approx(0.9)
    assert mixing.exponent_for(TOTALS, target_entropy=9.0) == 0.0
    with pytest.raises(ValueError):
        mixing.exponent_for(TOTALS)
    with pytest.raises(ValueError):
        mixing.exponent_for(TOTALS, 1.0, 1.0)


@pytest.mark.parametrize("target", [{"most_passes": 2.0}, {"most_passes": 1e9}, {"most_passes": 1.0}, {"most_passes": 1.2, "budget": 900.0}, {"target_entropy": 0.9}, {"target_entropy": 9.0}])
def test_exponent_of_a_table(spark, target):
    """A table of totals and a dictionary of them lead to the same exponent and weights."""
    x = mixing.exponent_for(TOTALS, **target)
    blocks = spark.createDataFrame([(s, k, n // 2 + (n % 2) * k) for s, n in TOTALS.items() for k in (0, 1)], "source string, block int, n long")
    planned = mixing.schedule(blocks, **{"most_passes": None, **target}).collect()
    assert {r.source: r.weight for r in planned} == pytest.approx(mixing.weights(TOTALS, x), rel=1e-6)
    rates = mixing.passes(TOTALS, x, target.get("budget"))
    assert {r.source: r.share / TOTALS[r.source] for r in planned} == pytest.approx(rates, rel=1e-6)


def test_each_source_with_a_name_of_its_own(spark):
    """More sources than a driver should hold: every document is its own."""
    blocks = spark.range(150_000).selectExpr("concat('site-', id) as source", "cast(id % 1024 as int) as block", "1 + id % 9 as n")
    planned = mixing.schedule(blocks, most_passes=2.0)
    assert planned.select("source").distinct().count() == 150_000
    assert planned.selectExpr("max(share / n)").first()[0] <= 2.0 + 1e-9


def test_mixture_realises_its_weights(spark, tmp_path):
    docs = [(k, "word " * (5 + k % 7), "a" if k < 2000 else "b" if k < 2400 else None) for k in range(2500)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4).write.parquet(str(tmp_path / "d"))
    given = spark.read.parquet(str(tmp_path / "d"))
    rows = mixing.mixture(given, VOCABULARY, blocks=64, most_passes=3.5).collect()
    size = {k: len(t.split()) + 1 for k, t, _ in docs}
    totals, used, uses = {}, {}, {}
    for k, _, s in docs:
        totals[s or ""] = totals.get(s or "", 0) + size[k]
    for r in rows:
        used[r.source] = used.get(r.source, 0) + size[r.doc_id]
        uses.setdefault(r.source, {}).setdefault(r.doc_id, []).append(r["pass"])
    want = mixing.weights(totals, mixing.exponent_for(totals, most_passes=3.5))
    whole = sum(used.values())
    assert {s: used[s] / whole for s in used} == pytest.approx(want, rel=0.03)
    assert used[""] / totals[""] == pytest.approx(3.5, rel=0.05)
    for source, by_doc in uses.items():  # every document at least once, and no pass twice
        assert len(by_doc) == sum((s or "") == source for *_, s in docs)
        assert all(sorted(p) == list(range(len(p))) for p in by_doc.values())
    rows.sort(key=lambda r: r.position)
    half = [r for r in rows if r.position < 0.5]
    early = sum(size[r.doc_id] for r in half if r.source == "b") / sum(size[r.doc_id] for r in half)
    assert early == pytest.approx(want["b"], rel=0.1)


def test_mixed_documents(edge, empty):
    left = mixing.mixed(edge, VOCABULARY, most_passes=1.0)
    assert left.columns == edge.columns
    key = lambda r: repr(tuple(r))
    assert sorted(left.collect(), key=key) == sorted(edge.collect(), key=key)
    assert mixing.mixed(empty, VOCABULARY, most_passes=2.0).count() == 0
    assert mixing.mixture(empty, VOCABULARY, most_passes=2.0).count() == 0


def plain_top_k(rows, every, k):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in good]
    out = []
    for a, (i, v) in enumerate(whole):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(whole) if a != b and len(v) == len(w))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,queries", [(7, 3), (4096, 512)])
def test_top_k(spark, tmp_path, block, queries):
    random.seed(8)
    rows = [(k, [random.choice([-1.5, 0.25, random.gauss(0, 1)]) for _ in range(6)]) for k in range(120)]
    rows += [(130, rows[3][1]), (131, rows[3][1]), (3, rows[3][1]), (140, None), (150, [1.0, None] * 3), (160, [math.nan] * 6), (170, [math.inf] * 6)]
    rows += [(None, rows[4][1]), (180, [1.0, 2.0]), (190, [3.0, 4.0]), (200, []), (210, [1e6] * 6), (-20, [-1e6] * 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "v"))
    got = topk.top_k(spark.read.parquet(str(tmp_path / "v")), F.col("id") % 10 == 0, 5, block=block, queries=queries)
    assert sorted(tuple(r) for r in got.collect()) == plain_top_k(rows, 10, 5)


@pytest.mark.parametrize("read,held", [(1, 1 << 20), (32, 8)])
def test_top_k_with_many_copies(spark, tmp_path, monkeypatch, read, held):
    """A third of the rows are one vector; rounds of one query block; early hand-over."""
    monkeypatch.setattr(topk, "ROUND", 1)
    monkeypatch.setattr(topk, "HELD", held)
    random.seed(9)
    rows = [(k, [random.gauss(0, 1) for _ in range(5)]) for k in range(200)]
    rows += [(k, [2.0] * 5) for k in range(300, 400)] + [(k, rows[k % 3][1]) for k in range(400, 430)]
    random.shuffle(rows)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    got = topk.top_k(vectors, F.col("id") % 10 == 0, 4, block=16, queries=9, read=read)
    assert sorted(tuple(r) for r in got.collect()) == plain_top_k(rows, 10, 4)


def test_top_k_moves_no_vectors_but_candidates(spark, tmp_path):
    """What the scan of the cells leaves grows with the queries, not with pairs of blocks."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(3000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).write.parquet(str(tmp_path / "v"))
    given = spark.read.parquet(str(tmp_path / "v")).select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("vector"))
    cells = topk.approximation_file(given, 64)
    assert cells.agg(F.sum(F.length("cells"))).first()[0] == 3000 * 16
    left = topk._left(cells.coalesce(4), topk._asked(given.filter("row % 100 = 0"), 512), 10)
    assert "Exchange hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
    assert left.count() < 30 * 4 * 60


def test_top_k_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "v"))
    assert topk.top_k(spark.read.parquet(str(tmp_path / "v")), F.col("id") % 10 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    data = rng.integers(-2000, 2000, (500, 16))
    near = topk.Approximation.of(data.astype(float))
    assert near.cell.dtype == np.uint8
    queries = rng.integers(-2000, 2000, (20, 16))
    low, high = near.bounds(queries.astype(float))
    assert (low <= queries @ data.T).all() and (queries @ data.T <= high).all()
    assert np.median(high - low) < 1e-2 * np.abs(data).max() ** 2 * 16


def test_language_model_scores(spark, edge, empty):
    docs = [(k, "alpha beta gamma delta " * 20) for k in range(10)] + [(k, "one two three four " * 20) for k in range(10, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 1), (None, 1)], "doc_id long, quality int")
    target, background = lm.models(df, labels, VOCABULARY)
    ids = {k: tokens.document_ids(VOCABULARY, t.encode()) for k, t in docs}
    counts = {r.cell: (r.target, r.background) for r in lm.counted(lm.flagged(df, labels), VOCABULARY).collect()}
    for place in (0, 1):
        want = sum(map(len, ids.values())) if place else len(ids[0]) + len(ids[1])
        assert sum(c[place] for cell, c in counts.items() if cell < lm.CELLS) == want
        assert sum(c[place] for cell, c in counts.items() if cell >= lm.CELLS) == want
    assert target.singles.sum() == pytest.approx(background.singles.sum()) == len(ids[0]) + len(ids[1])
    scale = (len(ids[0]) + len(ids[1])) / sum(map(len, ids.values()))
    rows = {r.doc_id: r for r in lm.scored(df, target, background, VOCABULARY).collect()}
    assert all(rows[k].difference < 0 for k in range(10)) and all(rows[k].difference > 0 for k in range(10, 40))
    a, b = int(ids[0][0]), int(ids[0][1])
    pairs = sum(((i[:-1] == a) & (i[1:] == b)).sum() for i in ids.values())
    alone = (background.singles[b] + 1) / (background.singles.sum() + lm.IDS)
    want = -math.log((pairs * scale + lm.PRIOR * alone) / (background.singles[a] + lm.PRIOR))
    assert background.losses(ids[0].astype(np.int64))[1] == pytest.approx(want)
    alike = lm.scored(df, *lm.models(df, labels.filter("doc_id < 0"), VOCABULARY), VOCABULARY)
    assert {r.difference for r in alike.collect()} == {0.0}
    assert lm.scored(edge, target, background, VOCABULARY).count() == len(edge_rows())
    assert lm.scored(empty, *lm.models(empty, labels, VOCABULARY), VOCABULARY).count() == 0


def test_pipeline_stages_in_turn(spark, edge):
    """Each stage against a plain count on what the one before kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.common.stored(stage(spark, seen[-1], folder), name.replace(" ", "-"))
        assert name == "packing" or out.columns == docs.columns
        seen.append(out)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = sorted(tuple(r) for r in docs.collect())
    scores = model.score(quality.feature_rows(r[1].encode() for r in rows))
    good = [r for r, s in zip(rows, scores) if s >= 0.5]
    assert sorted(tuple(r) for r in seen[1].collect()) == good
    single = sorted(r for r, e in zip(good, sorted(brute.exact(good), key=lambda e: e[0])) if e[3])
    assert sorted(tuple(r) for r in seen[2].collect()) == single
    firsts = {c for _, _, c in brute.near(single)}
    assert sorted(r.doc_id for r in seen[3].collect()) == sorted(firsts)
    mixed = [r.doc_id for r in seen[4].collect()]
    assert set(mixed) == firsts and len(mixed) <= 2 * len(firsts)
    packed = seen[5].collect()
    assert {p.doc_id for p in packed} == firsts
    assert sum(p.length for p in packed if p.start == 0) > 0
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


def test_pipeline_of_edge_rows(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.common.stored(stage(spark, docs, "/root/testdata/sf0.001"), name.replace(" ", "-"))
