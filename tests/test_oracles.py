"""Every registered query against its SQL oracle on the small tables."""

import os

import pytest

from foliograph.catalog import ORACLES, QUERIES
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    ok, message = compare(spark, con, name, SF_DIR)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0


@pytest.mark.parametrize("name", ["R5_search", "A10_item_fold", "D3_survivors", "W5_tuned_threshold", "W4_history_entries"])
def test_result_does_not_depend_on_partitioning(spark, name):
    def result(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            return sorted(map(str, QUERIES[name](spark, SF_DIR).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert result(3) == result(11)
