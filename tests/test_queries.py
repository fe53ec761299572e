import pytest
from compare import compare

from luxflow import queries, scans

D = "/root/testdata/sf0.001"
ALL, SQL = queries.queries() | scans.queries(), queries.oracle_sql() | scans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_as_sql(spark, name):
    df = ALL[name](spark, D)
    sql = SQL.get(name)
    if sql is None:
        df.collect()
    else:
        assert compare(df, sql, D) > 0
