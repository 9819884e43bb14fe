import pytest

from chunkloom import llm
from tests.duck import SF, same


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert same(llm.queries()[name](spark, SF), llm.oracle_sql()[name]) > 0
