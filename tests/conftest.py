import pathlib
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession


ROOT = pathlib.Path(__file__).resolve().parent
sys.path[:0] = [str(ROOT.parent), str(ROOT)]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("crawlwright-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="crawlwright-checkpoint-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
