import pytest

from pricewright import plans
from tests.compare import assert_same, duck

QUERIES, SQL = plans.registered()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data), duck(data), SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
