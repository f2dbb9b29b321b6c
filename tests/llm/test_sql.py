import pytest

from paperloom.llm import registry
from tests.conftest import SF, compare

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck):
    compare(registry.queries()[name](spark, SF), duck, SQL[name])


def test_every_number_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")) == list(range(1, 14))
