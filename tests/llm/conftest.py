import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs, with columns that clash with names used inside."""
    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        extra = {name: F.lit(1) for name in ("words", "len", "start", "digest", "rank", "hits", "score", "n", "_key2")}
        return docs.withColumns(extra)

    return make


@pytest.fixture
def small_shuffles(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
