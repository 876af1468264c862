"""Every query with a SQL twin gives the same rows as the SQL over the same tables."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import difference, sql_tables


@pytest.fixture(scope="module")
def con(folder):
    return sql_tables(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, con, name):
    try:
        assert difference(spark, con, folder, name) is None
    finally:
        spark.catalog.clearCache()


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert {"gene_id", "variant_id", "beta", "pvalue", "fdr"} <= set(df.columns)
    assert entry.queries().keys() >= entry.oracle_sql().keys()
