"""Every registered query of the library runs; those with SQL give its rows."""

import pytest
from sitelens.plans import all as plans

from compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns, rows = spark_rows(df)
    if name in plans.ORACLE_SQL:
        assert (columns, rows) == duck_rows(plans.ORACLE_SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
