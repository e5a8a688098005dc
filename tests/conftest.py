import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    s.conf.set("spark.sql.session.timeZone", "UTC")
    yield s
    s.stop()


@pytest.fixture
def lines(spark):
    def make(values, source="test.log"):
        rows = [(i, v, source) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "seq bigint, value string, source_file string").selectExpr(
            "*", "timestamp '2024-06-01 00:00:00' as modified")
    return make
