"""Every core query runs on the smallest tables, and gives the rows of its SQL where there is one."""

import pytest

from tabweave import core_queries, table_queries
from tests.compare import SF, duck_rows, spark_rows

QUERIES = core_queries.QUERIES | table_queries.QUERIES
ORACLES = core_queries.ORACLES | table_queries.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLES:
        assert found == duck_rows(ORACLES[name])
    else:
        # Ten suppliers give no class to lift; a hundred do.
        assert found[1] or spark_rows(QUERIES[name](spark, SF.replace("0.001", "0.01")))[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
