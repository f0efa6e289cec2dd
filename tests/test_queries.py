"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare, connect
from conftest import SF_DIR

import __spark_entry__ as contract

SQL = contract.oracle_sql()
# queries for one unit or pattern that the ten suppliers of these tables lack
UNITS_OF_LARGER_TABLES = {
    "district_boundaries", "find_pin", "price_outliers", "quality_map", "series_district",
    "stats_district", "tonnage_aggregate", "trade_map", "union_of_selections",
    "units_for_commodity",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    problem, rows, _ = compare(spark, con, SF_DIR, contract.queries()[name], SQL.get(name))
    assert problem is None
    assert rows > 0 or name in UNITS_OF_LARGER_TABLES


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["date", "state", "commodity", "category", "price", "tonnage", "contrib",
                          "districts"]
    assert df.count() > 0


def test_sql_names_are_query_names():
    assert set(SQL) <= set(contract.queries())
