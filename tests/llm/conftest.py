import pytest


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame with a schema, in three partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
