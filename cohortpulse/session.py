"""Spark session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Adaptive execution only joins small shuffle partitions of an aggregate and never
# splits a large one, so shuffles start from thousands of partitions: at 100 TB with a
# shuffle of a tenth, 8000 are some 1 GB each, and a few MB of input end up in one.
# Lookup tables of two columns are broadcast up to 256 MB, as Spark measures them.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.autoBroadcastJoinThreshold": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(
    app_name: str = "cohortpulse",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the settings this package relies on.

    ``master`` stays unset on a cluster, where ``spark-submit`` supplies it. On a
    single machine shuffles start from ``spark.sql.shuffle.partitions`` instead.
    """
    builder = SparkSession.builder.appName(app_name)
    settings = dict(ADAPTIVE)
    if master:
        builder = builder.master(master)
    if master and is_local(master):
        del settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    for key, value in {**settings, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, with one set of folders."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only within one process (tests, a laptop) may the setting be missing; the
    context's own checkpoint folder then serves, which is made if need be. On a
    cluster a folder of the driver's machine would lose rows, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not is_local(context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortpulse-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")
