import pytest

from tests.compare import DATA, both
from tessera.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    got, want = both(spark, name, QUERIES[name], SQL[name])
    assert got == want
