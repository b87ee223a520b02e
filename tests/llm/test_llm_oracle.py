import pytest

from tabweave.llm import queries
from tests.compare import SF, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    found = spark_rows(queries.QUERIES[name](spark, SF))
    if name in queries.ORACLES:
        assert found == duck_rows(queries.ORACLES[name])
    else:
        assert found[1]
