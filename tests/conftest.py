import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from swipewatch.sources.tables import prepare_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("swipewatch-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        # Plans are built from many small expressions; recording a call site for each doubles the time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield prepare_session(session)
    session.stop()
