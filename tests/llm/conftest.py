import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Frame from rows and a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
