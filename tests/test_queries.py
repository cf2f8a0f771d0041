import pytest

from relspan import case_queries, queries, reader_queries, rule_queries
from tests.oracle import compare, connect

QUERIES = queries.QUERIES | reader_queries.QUERIES | case_queries.QUERIES | rule_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | reader_queries.ORACLE_SQL | case_queries.ORACLE_SQL | rule_queries.ORACLE_SQL
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, con, name):
    out = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        compare(out, con, ORACLE_SQL[name])
    else:
        assert out.count() > 0
