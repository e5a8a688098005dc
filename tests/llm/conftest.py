import pytest


SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text, source) with columns whose names clash with those the operators use."""
    def make(rows, schema="doc_id bigint, text string, source string"):
        return spark.createDataFrame(rows, schema).selectExpr("*", "1 as n", "'x' as cell", "2 as shard", "3 as fp", "4 as key", "5 as size")
    return make


@pytest.fixture
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
