"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_queries import normal, sql_result

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    columns, rows, _ = sql_result(SF, ORACLES[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, rows)


def test_entry(spark):
    assert entry.entry(spark).columns == ["term", "df", "is_stop"]
