"""Thresholding and per-class reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.3


def predicted(probability: str | Column = "probability_1", threshold: float = THRESHOLD) -> Column:
    """1 where the positive-class probability reaches the threshold."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return (p >= threshold).cast("int")


def confusion(
    scored: DataFrame,
    label: str = "distinction",
    prediction: str = "prediction",
    by: Sequence[str] = (),
) -> DataFrame:
    """True/false positives and negatives, optionally per model."""
    y, p = F.col(label), F.col(prediction)

    def cell(actual: int, said: int) -> Column:
        return F.count_if((y == actual) & (p == said))

    return scored.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    )


def classification_report(
    scored: DataFrame,
    label: str = "distinction",
    prediction: str = "prediction",
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and averages.

    Rows per model: the classes that occur among labels or predictions,
    'accuracy' (its value in every score column), 'macro avg' over the classes that
    occur, and 'weighted avg'. The data is reduced to four counts per model before
    anything else.
    """
    cells = confusion(scored, label, prediction, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def class_row(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        # F1 as 2 hit / (2 hit + wrong + missed) is exact up to one division.
        return F.struct(
            F.lit(name).alias("class"),
            _share(hit, hit + wrong).alias("precision"),
            _share(hit, hit + missed).alias("recall"),
            _share(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    classes = cells.select(
        *by, "tn", "fp", "fn", "tp", class_row("0", tn, fn, fp).alias("c0"), class_row("1", tp, fp, fn).alias("c1")
    )
    total = tn + fp + fn + tp
    accuracy = _share(tn + tp, total)

    def average(name: str, combine) -> Column:
        scores = [combine(F.col(f"c0.{s}"), F.col(f"c1.{s}")).alias(s) for s in ("precision", "recall", "f1")]
        return F.struct(F.lit(name).alias("class"), *scores, total.alias("support"))

    def weighted(a: Column, b: Column) -> Column:
        parts = a * F.col("c0.support") + b * F.col("c1.support")
        return _share(parts, total)

    # the scores of a class that occurs nowhere are all 0
    occurring = F.when(tn + fn + fp > 0, 1).otherwise(0) + F.when(tp + fp + fn > 0, 1).otherwise(0)
    rows = F.array(
        F.when(tn + fn + fp > 0, F.col("c0")),
        F.when(tp + fp + fn > 0, F.col("c1")),
        average("accuracy", lambda a, b: accuracy),
        average("macro avg", lambda a, b: _share(a + b, occurring)),
        average("weighted avg", weighted),
    )
    return classes.select(*by, F.inline(F.array_compact(rows)))
