import math
from fractions import Fraction
from random import Random

import pytest
from results import rows
from pyspark.sql import functions as F

from cohortpulse.models import evaluate as V
from cohortpulse.models import importance as I
from cohortpulse.models import nodes as N
from cohortpulse.models import split as S
from cohortpulse.models import train as T
from cohortpulse.operators.encode import clean_columns
from cohortpulse.schemas import ENROLMENT_KEYS, MOMENT_COLUMNS, modelling_columns

QUICK = T.Settings(rounds=5)


@pytest.fixture(scope="module")
def frame(spark):
    """A modelling frame whose label follows the click variance; group 2 has one class."""
    random = Random(4)
    data = []
    for i in range(900):
        group = [1, 2, None][i % 3]
        missing = random.random() < 0.2
        variance = random.uniform(0, 100)
        label = 0 if group == 2 else int(not missing and variance > 60)
        values = dict.fromkeys(modelling_columns(), 0)
        values |= dict.fromkeys(MOMENT_COLUMNS, None if missing else random.uniform(-1, 1))
        values |= {
            "studied_credits": random.choice([30, 60]),
            "total_clicks_quiz": random.randrange(50),
            "pres_groups": group,
            "dep_dec": random.choice([None, 1, 5]),
            "distinction": label,
            "click_time_variance": None if missing else variance,
        }
        data.append((i, "AAA", "2013J", *values.values()))
    kinds = {**dict.fromkeys(modelling_columns(), "int"), **dict.fromkeys(MOMENT_COLUMNS, "double")}
    columns = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    keys = "id_student int, code_module string, code_presentation string"
    return clean_columns(spark.createDataFrame(data, f"{keys}, {columns}"))


def test_split_ignores_partitioning_and_order(spark):
    df = spark.range(4000).select(
        F.col("id").alias("id_student"), F.lit("AAA").alias("code_module"), F.lit("2013J").alias("code_presentation")
    )
    train, test = S.train_test_split(df)
    again = S.train_test_split(df.repartition(13).orderBy(F.desc("id_student")))[1]
    assert rows(test) == rows(again)
    assert train.count() + test.count() == 4000 and 700 < test.count() < 900
    assert rows(S.train_test_split(df, seed=2)[1]) != rows(test)


def test_split_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "AAA", None), (2, "AAA", "2013J")], "id_student int, code_module string, code_presentation string")
    train, test = S.train_test_split(df)
    assert train.count() + test.count() == 2 and train.where("code_presentation is null").count() == 1


def report(df, **options):
    return {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in V.classification_report(df, **options).collect()}


def test_report(spark):
    df = spark.createDataFrame(
        [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4, "distinction int, prediction int"
    )
    got = report(df)
    assert got["1"] == pytest.approx((0.6, 0.75, 2 / 3, 4))
    assert got["0"] == pytest.approx((0.8, 2 / 3, 8 / 11, 6))
    assert got["accuracy"] == pytest.approx((0.7, 0.7, 0.7, 10))
    assert got["macro avg"] == pytest.approx((0.7, (0.75 + 2 / 3) / 2, (2 / 3 + 8 / 11) / 2, 10))
    assert got["weighted avg"] == pytest.approx((0.72, 0.7, (4 * 2 / 3 + 6 * 8 / 11) / 10, 10))
    assert rows(V.confusion(df)) == [(4, 2, 1, 3)]


def test_report_with_one_class(spark):
    df = spark.createDataFrame([(0, 0)] * 3, "distinction int, prediction int")
    got = report(df)
    assert got.keys() == {"0", "accuracy", "macro avg", "weighted avg"}
    assert set(got.values()) == {(1.0, 1.0, 1.0, 3)}


def test_threshold_of_the_settings_is_used(spark, frame):
    fitted = T.fit_pooled(T.stage(frame), T.Settings(rounds=2, threshold=0.0))
    assert T.score(fitted).where("prediction = 0").count() == 0
    assert T.score(fitted, 2.0).where("prediction = 1").count() == 0


def test_every_missing_input_is_flagged(spark, frame):
    holes = frame.withColumn("total_clicks_quiz", F.when(F.col("id_student") % 7 != 0, F.col("total_clicks_quiz")))
    prepared, features = T.prepare(holes, T.feature_columns())
    assert {"total_clicks_quiz_missing", "dep_dec_missing"} <= set(features)
    assert "studied_credits_missing" not in features
    flagged = prepared.where("total_clicks_quiz_missing = 1")
    assert flagged.count() == holes.where("total_clicks_quiz is null").count() and flagged.where("total_clicks_quiz <> 0").count() == 0


def test_report_without_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "distinction int, prediction int")
    assert report(df)["1"] == (0.0, 0.0, 0.0, 1)


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.3,), (0.2999,), (0.9,)], "probability_1 double")
    assert [r[0] for r in df.select(V.predicted()).collect()] == [1, 0, 1]


def test_study(spark, frame):
    models = T.fit_study(frame, groups=[0, 1, 2], settings=QUICK, parallelism=2)
    # Group 0 is absent and group 2 has a single class.
    assert [m.name for m in models] == ["0", "1", "2", T.POOLED]
    assert models[0].model is models[2].model is None
    study, models = models, [m for m in models if m.model is not None]
    assert "total_clicks_forumng" not in models[0].features
    assert "total_clicks_forumng" in models[1].features
    assert models[0].model.getMaxDepth() == 3 and models[0].model.getNumTrees == QUICK.rounds

    result = T.study_report(study)
    untrained = {r.model: r.support for r in result.collect() if r["class"] == T.UNTRAINED}
    assert untrained.keys() == {"0", "2"} and untrained["0"] == 0 and untrained["2"] > 0
    assert result.where("decision = 'default'").select("model").distinct().count() == 2
    got = {(r.model, r["class"]): r for r in result.where("decision = 'threshold'").collect()}
    assert got["1", "1"].f1 > 0.7 and got[T.POOLED, "accuracy"].f1 > 0.8

    scored = T.score(models[1])
    missing = models[1].test.where("click_time_variance_missing = 1").count()
    assert missing > 0 and scored.count() == models[1].test.count()
    assert scored.where("probability_1 < 0 or probability_1 > 1 or probability_1 is null").count() == 0

    gains = I.top_gains(study, n=3)
    first = {r.model: r.feature for r in gains.where("place = 1").collect()}
    assert first["1"] == "click_time_variance"
    assert gains.where("place > 3").count() == 0
    assert I.node_importance(models[0])[0][0] == "click_time_variance"


def test_same_seed_same_metrics(spark, frame):
    staged = T.stage(frame)
    once, twice = (T.study_report([T.fit_pooled(staged, QUICK)]) for _ in range(2))
    assert rows(once) == rows(twice)


def test_staged_frame_equals_its_source(spark, frame):
    staged = T.stage(frame)
    order = [f"`{c}`" for c in ENROLMENT_KEYS]
    assert staged.columns == frame.columns
    assert rows(staged, *order) == rows(frame, *order)


def test_weights_raise_recall(spark, frame):
    staged = T.stage(frame)

    def recall(weight):
        fitted = T.fit_pooled(staged, T.Settings(rounds=2, pooled_weight=weight))
        report = T.study_report([fitted]).where("decision = 'threshold'")
        return {r["class"]: r.recall for r in report.collect()}["1"]

    assert recall(9.0) >= recall(0.1)


@pytest.mark.parametrize("n,share", [(0, 0.2), (1, 0.2), (10, 0.2), (11, 0.2), (5000, 0.2), (997, 0.33), (100, 0.07), (50, 1.0), (50, 0.0)])
def test_exact_number_of_test_rows(spark, n, share):
    df = spark.range(n).withColumn("x", F.col("id") % 3)
    train, test = S.exact_test_split(df, ["id"], share)
    ids = sorted(r.id for r in test.collect())
    assert len(ids) == math.ceil(Fraction(str(share)) * n)
    assert sorted(ids + [r.id for r in train.collect()]) == list(range(n))
    assert test.columns == train.columns == df.columns
    other = S.exact_test_split(df.repartition(7, "x"), ["id"], share)[1]
    assert sorted(r.id for r in other.collect()) == ids


def test_exact_split_of_rows_that_are_alike(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("k"), F.lit(None).cast("string").alias("none"))
    train, test = S.exact_test_split(df, ["k", "none"], 0.3)
    assert test.count() == 300 and train.count() == 700
    sizes = {r.k: r["count"] for r in test.groupBy("k").count().collect()}
    assert sorted(sizes.values()) == [50, 250]


def test_node_table_gives_the_model_s_scores(spark, frame):
    """Probability and both decisions of every test row, and the report, by joins."""
    models = T.fit_study(frame, [1, 2], T.Settings(rounds=12))
    trained = [m for m in models if m.model is not None]
    assert [m.name for m in trained] == ["1", "all"]
    for m in trained:
        assert N.node_table(m).count() == sum(t.numNodes for t in m.model.trees)
        found = N.route_differences(m).first()
        assert found.n_rows == found.n_by_nodes == m.test.count() > 50
        assert found.n_far == found.n_decided_otherwise == 0
    one, other = T.study_report(models), T.study_report(models, scorer=N.score_by_nodes)
    key = lambda r: str(r[:3])
    assert sorted((tuple(r) for r in one.collect()), key=key) == sorted((tuple(r) for r in other.collect()), key=key)


def test_exact_share_in_training(spark, frame):
    settings = T.Settings(rounds=2, exact_share=True)
    model = T.fit_pooled(T.stage(frame), settings)
    assert model.test.count() == math.ceil(Fraction("0.2") * frame.count())


def test_rows_are_assembled_once_a_model(spark, frame, monkeypatch):
    """The trees' passes before the first round read kept rows, which go after the fit."""
    seen, fit = [], T.GBTClassifier.fit
    monkeypatch.setattr(T.GBTClassifier, "fit", lambda self, rows: (seen.append(rows), seen.append(rows.storageLevel), fit(self, rows))[-1])
    T.fit_pooled(T.stage(frame), T.Settings(rounds=1))
    given, level = seen
    assert level.useDisk and not level.useMemory
    assert not given.storageLevel.useDisk


def test_routes_read_kept_test_rows(spark, frame):
    model = T.fit_pooled(T.stage(frame), T.Settings(rounds=2))
    want = N.route_differences(model).first()
    with N.test_rows_kept([model]) as (kept,):
        assert kept.test.storageLevel.useDisk and not kept.test.storageLevel.useMemory
        assert N.route_differences(kept).first() == want
    assert not model.test.storageLevel.useDisk
