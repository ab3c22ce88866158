import pytest


@pytest.fixture
def frame(spark):
    """A table of documents from rows of (doc_id, text, ...)."""

    def made(rows, schema="doc_id long, text string", partitions=3):
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return made
