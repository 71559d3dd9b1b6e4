import pytest

from trendloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture()
def frame(spark):
    """Rows to DataFrame with a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
