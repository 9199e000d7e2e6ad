import sys
from pathlib import Path

import pytest

sys.path += [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from cohortpulse.session import build_session  # noqa: E402

SETTINGS = {
    "spark.sql.shuffle.partitions": "4",
    "spark.driver.memory": "6g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", "local[8]", {**SETTINGS, "spark.checkpoint.dir": folder})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def setting(spark):
    """Change session settings for one test."""
    before = {}

    def change(**values):
        for key, value in values.items():
            name = key.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)
