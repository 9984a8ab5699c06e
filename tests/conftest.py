import os
import sys

import pytest
from retail_help import SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillcast.session import build_session  # noqa: E402
from tillcast.sources.tables import RetailTables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.checkpoint.dir": str(shared / "checkpoints"),
        "spark.sql.warehouse.dir": str(shared / "warehouse"),
        "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return RetailTables(spark, SMALL, grain="brand")
