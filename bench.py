"""Headline queries, timed warm on one node; prints one JSON line.

Every query is run once unmeasured and then timed, each time in full into
Spark's no-op sink. The model query trains 13 models of 100 rounds each and is timed on
its first run; ``gbt_gain_top15`` trains the same models.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cohortpulse.plans.queries import REGISTRY
from cohortpulse.session import build_session

HEADLINE = [
    "scan_student_vle",
    "pk_violations",
    "fk_orphans",
    "activity_counts",
    "clicks_total",
    "clicks_one_type",
    "clicks_by_type_pivot",
    "click_moments",
    "moments_events",
    "moments_joined",
    "engagement_features",
    "first_attempts",
    "one_hot",
    "feature_matrix",
    "nonzero_columns",
    "profile_numeric",
    "top10_with_ties",
    "degree_share",
    "hash_split",
    "class_report",
]
COLD = ["gbt_group_report"]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, folder)
        seconds[name] = timed(spark, name, folder)
        print(name, seconds[name], file=sys.stderr)
    for name in COLD:
        seconds[name] = timed(spark, name, folder)
        print(name, seconds[name], file=sys.stderr)
    result = {
        "metric": "headline queries, total wall-clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
