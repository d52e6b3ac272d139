import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from veritally.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def no_broadcast(spark):
    """Joins as they run on tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def tables(spark):
    """Three matched rows: one label and one attribute are NULL."""
    scored = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "name string, pred boolean")
    labels = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, isfraud boolean")
    attributes = spark.createDataFrame(
        [("a", "E1", "yes"), ("b", "E2", "no"), ("c", None, "no")],
        "id string, ethnicity string, is_veteran string",
    )
    return scored, labels, attributes
