"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

from noticeflow.workload import all_queries
from tests.oracle_compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) is None
    else:
        assert df.count() >= 0
