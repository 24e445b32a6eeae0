import pytest

from foliograph.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, "foliograph-tests", **{"spark.checkpoint.dir": str(shared)})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Evaluate columns over literal rows: rows(data, schema, **columns) -> list of tuples."""

    def run(data, schema, **columns):
        df = spark.createDataFrame(data, schema)
        return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]

    return run
