"""Feature importance from the trained trees."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortpulse.models.train import Fitted
from cohortpulse.session import shared_folder


def split_gains(fitted: Fitted, folder: str | None = None) -> DataFrame:
    """Gain per feature: mean and sum over its splits, and their number.

    Spark's own importance is normalised and weighted by node size, so the
    gains are read from the node table of the model, saved below ``folder`` or in
    the shared folder.
    """
    spark = fitted.test.sparkSession
    path = f"{folder or shared_folder(spark)}/model-{uuid.uuid4().hex}"
    fitted.model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*")
    names = F.create_map(*[F.lit(x) for pair in enumerate(fitted.features) for x in pair])
    return (
        nodes.where(F.col("leftChild") >= 0)
        .groupBy(F.col("split.featureIndex").alias("_index"))
        .agg(
            F.avg("gain").alias("mean_gain"),
            F.sum("gain").alias("total_gain"),
            F.count(F.lit(1)).alias("n_splits"),
        )
        .select(
            F.lit(fitted.name).alias("model"),
            names[F.col("_index")].alias("feature"),
            "mean_gain",
            "total_gain",
            "n_splits",
        )
    )


def top_gains(models: Sequence[Fitted], n: int = 15, path: str | None = None) -> DataFrame:
    """The ``n`` features with the highest mean gain, per trained model."""
    gains = reduce(DataFrame.unionByName, [split_gains(m, path) for m in models if m.model is not None])
    order = Window.partitionBy("model").orderBy(F.desc("mean_gain"), "feature")
    return gains.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def node_importance(fitted: Fitted) -> list[tuple[str, float]]:
    """Spark's normalised importance, for comparison."""
    values = fitted.model.featureImportances.toArray()
    return sorted(zip(fitted.features, map(float, values)), key=lambda x: (-x[1], x[0]))
