import pytest
from compare import compare

from luxflow.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_as_sql(spark, name):
    assert compare(queries.queries()[name](spark, D), queries.oracle_sql()[name], D) > 0


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11))
