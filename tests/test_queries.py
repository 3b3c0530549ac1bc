"""Every query of the library runs, and gives the rows of its SQL where it has one."""

import pytest
from compare import difference

from lodestone.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    if name in SQL:
        assert difference(spark, QUERIES[name], SQL[name], small) == ""
    else:
        assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["row", "score", "channels", "rank"]
