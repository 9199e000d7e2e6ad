import sys
from pathlib import Path

import pytest

sys.path.append(str(Path(__file__).parent))

from edge_cases import SCHEMA, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """The edge rows as a stored table."""
    path = str(tmp_path_factory.mktemp("edge") / "documents")
    spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
