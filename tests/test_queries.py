"""Every query of the catalogue against its SQL on the smallest tables; those without SQL run and keep their schema."""

import pytest

from tessera import catalogue
from tests.compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_has_the_rows_of_its_sql(spark, name):
    check(catalogue.QUERIES[name], catalogue.ORACLES[name], spark, SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
