import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Table (pos, v) from a list of values."""
    def make(values, kind="string"):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"pos int, v {kind}")
    return make


@pytest.fixture
def values():
    """Values of column v in row order."""
    def read(df, name="v"):
        return [r[name] for r in df.orderBy("pos").collect()]
    return read
