"""Scoring by the saved node table: a second route to the trees' probabilities.

A trained model is saved as a table of nodes. Here rows walk down it by joins, one level
after the other, without the tree code of the library: a row starts at the root of each
tree, is joined to the node it is at, and goes left where its value is at most the node's
threshold. What the leaves say, weighted by tree, adds up to the margin.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortpulse.functions.columns import identifier
from cohortpulse.models.evaluate import predicted
from cohortpulse.models.train import LABEL, Fitted, score
from cohortpulse.schemas import ENROLMENT_KEYS
from cohortpulse.session import shared_folder

ROW = "_row"


def node_table(fitted: Fitted, folder: str | None = None) -> DataFrame:
    """``tree, node, left, right, feature, threshold, says`` of a saved model; inner nodes
    have children, leaves say what the tree predicts times the tree's weight."""
    spark = fitted.test.sparkSession
    path = f"{folder or shared_folder(spark)}/model-{uuid.uuid4().hex}"
    fitted.model.write().save(path)
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate(fitted.model.treeWeights)], "tree int, weight double")
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    return nodes.join(F.broadcast(weights), "tree").select(  # a row per boosting round
        "tree",
        F.col("id").alias("node"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        (F.col("prediction") * F.col("weight")).alias("says"),
    )


def score_by_nodes(fitted: Fitted, threshold: float | None = None, folder: str | None = None) -> DataFrame:
    """What :func:`cohortpulse.models.train.score` gives, from the node table.

    The table has at most ``2**(depth + 1)`` rows a tree, so it is broadcast; rows move once,
    already added up, when the trees' shares of the margin come together.
    """
    if fitted.model is None:
        raise ValueError(f"model {fitted.name} could not be trained")
    nodes = node_table(fitted, folder)
    depth = max(t.depth for t in fitted.model.trees)
    values = F.array(*[F.col(identifier(c)).cast("double") for c in fitted.features])
    trees = F.sequence(F.lit(0), F.lit(len(fitted.model.trees) - 1))
    # rows are numbered before they are repeated for each tree
    rows = fitted.test.select(F.monotonically_increasing_id().alias(ROW), *ENROLMENT_KEYS, LABEL, values.alias("_x"))
    walk = rows.select("*", F.explode(trees).alias("tree"), F.lit(0).alias("node"))
    for _ in range(depth):
        at = walk.join(F.broadcast(nodes), ["tree", "node"])
        lower = F.when(F.get("_x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        walk = at.withColumn("node", F.when(F.col("left") < 0, F.col("node")).otherwise(lower)).select(walk.columns)
    said = walk.join(F.broadcast(nodes.select("tree", "node", "says")), ["tree", "node"])
    summed = said.groupBy(ROW, *ENROLMENT_KEYS, LABEL).agg(F.sum("says").alias("_margin"))
    shifted = predicted("probability_1", fitted.threshold if threshold is None else threshold)
    return summed.select(
        F.lit(fitted.name).alias("model"),
        *ENROLMENT_KEYS,
        LABEL,
        (1 / (1 + F.exp(-2 * F.col("_margin")))).alias("probability_1"),
        (F.col("_margin") > 0).cast("int").alias("prediction_default"),
    ).withColumn("prediction", shifted)


@contextmanager
def test_rows_kept(models: Sequence[Fitted]) -> Iterator[list[Fitted]]:
    """The models with their test rows on the executors' disks, as either route reads them:
    finding them takes a scan of all rows."""
    kept = [replace(m, test=m.test.persist(StorageLevel.DISK_ONLY)) for m in models]
    try:
        yield kept
    finally:
        for m in kept:
            m.test.unpersist()


def route_differences(fitted: Fitted, folder: str | None = None, within: float = 1e-9) -> DataFrame:
    """One row: test rows of a model on either route, and those whose probability or whose
    decisions differ; enrolments are the key of both."""
    one, other = score(fitted), score_by_nodes(fitted, folder=folder)
    alike = [one[k].eqNullSafe(other[k]) for k in ENROLMENT_KEYS]
    joined = one.join(other, alike, "full")
    far = F.abs(one["probability_1"] - other["probability_1"]) > within
    # a decision can only differ where a probability is at its threshold, but for rounding
    said = (one["prediction"] != other["prediction"]) | (one["prediction_default"] != other["prediction_default"])
    return joined.agg(
        F.count(one["model"]).alias("n_rows"),
        F.count(other["model"]).alias("n_by_nodes"),
        F.count_if(F.coalesce(far, F.lit(True))).alias("n_far"),
        F.count_if(F.coalesce(said, F.lit(True))).alias("n_decided_otherwise"),
    ).select(F.lit(fitted.name).alias("model"), "*")
