"""Every registered query of the core library at the smallest size, against its SQL where it has one."""

import pytest
from compare import assert_same, connect

from tallymill import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert_same(df, connect(SF), registry.ORACLE_SQL[name])
    else:
        rows = df.collect()
        assert rows and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
