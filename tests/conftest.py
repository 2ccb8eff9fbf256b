import pytest
from pyspark import SparkConf

from pagetrawl.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # a setting of the machine goes first
    named = SparkConf().get("spark.checkpoint.dir") or str(tmp_path_factory.mktemp("checkpoints"))
    session = local_session(8, **{"spark.checkpoint.dir": named})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    """Rows as sorted tuples of text-comparable values."""
    return sorted((tuple(r) for r in df.collect()), key=str)
