"""Boosted-tree classifiers per presentation group and pooled."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortpulse.functions.columns import clean_name, identifier
from cohortpulse.models.evaluate import THRESHOLD, classification_report, predicted
from cohortpulse.models.split import exact_test_split, in_test, train_test_split
from cohortpulse.operators.cohort import in_group
from cohortpulse.operators.encode import MISSING_SUFFIX, fill_missing, non_zero_columns, non_zero_flags
from cohortpulse.schemas import (
    ENROLMENT_KEYS,
    MODEL_GROUPS,
    MOMENT_COLUMNS,
    modelling_columns,
)
from cohortpulse.session import shared_folder
from cohortpulse.sources.sinks import write_and_read

LABEL = "distinction"
GROUP = "pres_groups"
POOLED = "all"
# Shown by the registered query of the indicators; models flag whatever is null.
MAY_BE_MISSING = ["dep_dec", *MOMENT_COLUMNS]


@dataclass(frozen=True)
class Settings:
    """Model settings; the defaults are those of the study."""

    max_depth: int = 3
    subsample: float = 0.5
    step_size: float = 0.3
    rounds: int = 100
    seed: int = 1
    group_weight: float = 9.0
    pooled_weight: float = 2.0
    threshold: float = THRESHOLD
    test_percent: int = 20
    #: Exactly this share of a model's rows, rounded up, instead of one in expectation.
    exact_share: bool = False


@dataclass(frozen=True)
class Fitted:
    """A trained model with the input columns it saw.

    ``model`` is None where the training part lacks a class.
    """

    name: str
    model: GBTClassificationModel | None
    features: list[str]
    test: DataFrame
    threshold: float = THRESHOLD


def feature_columns() -> list[str]:
    """Model inputs: the modelling columns without label and group."""
    return [clean_name(c) for c in modelling_columns() if c not in (LABEL, GROUP)]


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that hold a null or NaN anywhere, from one aggregate."""
    counts = df.agg(
        *[F.expr(f"count_if(nullif(double({identifier(c)}), double('NaN')) is null) as {identifier(c)}") for c in columns]
    ).first()
    return [c for c in columns if counts[c]]


def prepare(
    df: DataFrame, columns: Sequence[str], flagged: Sequence[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Fill missing values; returns the frame and the widened input columns.

    One rule for every input: a column with missing values, found in ``df`` unless
    ``flagged`` names them, is filled with 0 and gets an indicator.
    """
    columns = list(columns)
    flagged = missing_columns(df, columns) if flagged is None else [c for c in columns if c in flagged]
    return fill_missing(df, flagged), [*columns, *[c + MISSING_SUFFIX for c in flagged]]


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the frame, by group, to ``path`` or the shared folder and read it back.

    Every boosting round reads its input; a written table makes that cheap,
    survives lost executors, and lets a group's model read its group only.
    """
    return write_and_read(df, "features", GROUP, path)


def fit(
    train: DataFrame, features: Sequence[str], positive_weight: float, settings: Settings = Settings()
) -> GBTClassificationModel:
    """Boosted trees with the positive class weighted up.

    The assembled rows are kept on the executors' disks during the fit, as the trees' bins take
    several passes; memory is left to the binned rows.
    """
    spark = train.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    weighted = train.withColumn(
        "_weight", F.when(F.col(LABEL) == 1, F.lit(positive_weight)).otherwise(F.lit(1.0))
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    booster = GBTClassifier(
        labelCol=LABEL,
        featuresCol="features",
        weightCol="_weight",
        maxDepth=settings.max_depth,
        subsamplingRate=settings.subsample,
        stepSize=settings.step_size,
        maxIter=settings.rounds,
        seed=settings.seed,
    )
    rows = assembler.transform(weighted).select("features", LABEL, "_weight").persist(StorageLevel.DISK_ONLY)
    try:
        return booster.fit(rows)
    finally:
        rows.unpersist()


def score(fitted: Fitted, threshold: float | None = None) -> DataFrame:
    """Test rows with positive-class probability, default and shifted decision.

    The shifted one is at the model's own threshold unless another is given.
    """
    if fitted.model is None:
        raise ValueError(f"model {fitted.name} could not be trained")
    assembler = VectorAssembler(inputCols=fitted.features, outputCol="features")
    scored = fitted.model.transform(assembler.transform(fitted.test))
    shifted = predicted("probability_1", fitted.threshold if threshold is None else threshold)
    return scored.select(
        F.lit(fitted.name).alias("model"),
        *ENROLMENT_KEYS,
        LABEL,
        vector_to_array("probability")[1].alias("probability_1"),
        F.col("prediction").cast("int").alias("prediction_default"),
    ).withColumn("prediction", shifted)


def supports(modelling: DataFrame, groups: Sequence[int] = MODEL_GROUPS, settings: Settings = Settings()) -> DataFrame:
    """Training and test rows of each model and class: ``model, class, n_train, n_test``.

    All models come from one aggregate: a row counts for its group and for the pooled one.
    """
    test = in_test(test_percent=settings.test_percent, seed=settings.seed)
    own = F.when(F.col(GROUP).isin(list(groups)), F.col(GROUP).cast("string"))
    rows = modelling.select(F.explode(F.array_compact(F.array(F.lit(POOLED), own))).alias("model"), F.col(LABEL).alias("class"), test.alias("_test"))
    return rows.groupBy("model", "class").agg(F.count_if(~F.col("_test")).alias("n_train"), F.count_if("_test").alias("n_test"))


def kept_features(modelling: DataFrame, groups: Sequence[int] = MODEL_GROUPS) -> DataFrame:
    """Inputs of each model before indicators: ``model, feature``. A group's model
    keeps the columns used in the group, the pooled one all of them."""
    names = feature_columns()
    listed = modelling.where(F.col(GROUP).isin(list(groups)))
    flags = non_zero_flags(listed, names, GROUP)
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(identifier(c)).alias("used")) for c in names]))
    own = flags.select(F.col(GROUP).cast("string").alias("model"), pairs).where("used = 1").select("model", "feature")
    spark = modelling.sparkSession
    return own.unionByName(spark.createDataFrame([(POOLED, c) for c in names], "model string, feature string"))


def _trainable(staged: DataFrame, groups: Sequence[int], settings: Settings) -> set[str]:
    """Models whose training part holds both classes."""
    classes = supports(staged, groups, settings).where("n_train > 0").groupBy("model").count()
    return {r["model"] for r in classes.where("count > 1").collect()}


def _fit_part(
    name: str, part: DataFrame, columns: Sequence[str], flagged: Sequence[str], weight: float, trainable: bool, settings: Settings
) -> Fitted:
    prepared, features = prepare(part, columns, flagged)
    if settings.exact_share:
        train, test = exact_test_split(prepared, share=settings.test_percent / 100, seed=settings.seed)
    else:
        train, test = train_test_split(prepared, test_percent=settings.test_percent, seed=settings.seed)
    model = fit(train, features, weight, settings) if trainable else None
    return Fitted(name, model, features, test, settings.threshold)


def fit_pooled(staged: DataFrame, settings: Settings = Settings()) -> Fitted:
    """One model over all rows, those without a group included."""
    flagged = missing_columns(staged, feature_columns())
    trainable = POOLED in _trainable(staged, (), settings)
    return _fit_part(POOLED, staged, feature_columns(), flagged, settings.pooled_weight, trainable, settings)


def fit_groups(
    staged: DataFrame,
    groups: Sequence[int] = MODEL_GROUPS,
    settings: Settings = Settings(),
    parallelism: int = 12,
) -> list[Fitted]:
    """One model per presentation group, on the columns used in that group.

    A group whose training part lacks a class has no model to train; its entry says
    so. The fits are independent Spark jobs and are submitted side by side.
    """
    listed = staged.where(F.col(GROUP).isin(list(groups)))
    kept = non_zero_columns(listed, feature_columns(), GROUP)
    flagged = missing_columns(listed, feature_columns())
    trainable = _trainable(listed, groups, settings)

    def one(group: int) -> Fitted:
        part = in_group(staged, group)
        return _fit_part(str(group), part, kept.get(group, []), flagged, settings.group_weight, str(group) in trainable, settings)

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(one, groups))


def fit_study(
    modelling: DataFrame,
    groups: Sequence[int] = MODEL_GROUPS,
    settings: Settings = Settings(),
    parallelism: int = 12,
    path: str | None = None,
) -> list[Fitted]:
    """All group models followed by the pooled one; ``path`` is where rows are staged.

    A boosting round is a few short jobs, so models are trained side by side.
    """
    staged = stage(modelling, path)
    with ThreadPoolExecutor(1) as beside:
        pooled = beside.submit(fit_pooled, staged, settings)
        return [*fit_groups(staged, groups, settings, parallelism), pooled.result()]


UNTRAINED = "not trained: one class"


def study_report(
    models: Sequence[Fitted], threshold: float | None = None, scorer: Callable[[Fitted, float | None], DataFrame] = score
) -> DataFrame:
    """Classification report of every model on its own test rows, at its threshold and,
    as ``decision`` says, at the default of 0.5.

    A model that could not be trained has one row, with its test rows as support. Test rows
    are scored by ``scorer``.
    """
    parts = []
    for m in models:
        if m.model is None:
            counted = m.test.agg(F.count(F.lit(1)).alias("support"))
            none = F.lit(None).cast("double")
            parts.append(
                counted.select(
                    F.lit(m.name).alias("model"), F.lit(None).cast("string").alias("decision"), F.lit(UNTRAINED).alias("class"),
                    none.alias("precision"), none.alias("recall"), none.alias("f1"), "support",
                )
            )
    trained = [scorer(m, threshold) for m in models if m.model is not None]
    if trained:
        scored = reduce(DataFrame.unionByName, trained)
        decisions = F.explode(
            F.array(
                F.struct(F.lit("threshold").alias("decision"), F.col("prediction").alias("said")),
                F.struct(F.lit("default").alias("decision"), F.col("prediction_default").alias("said")),
            )
        )
        both = scored.select("model", LABEL, decisions.alias("d")).select("model", LABEL, "d.decision", F.col("d.said").alias("prediction"))
        parts.append(classification_report(both, by=["model", "decision"]))
    return reduce(DataFrame.unionByName, parts)
