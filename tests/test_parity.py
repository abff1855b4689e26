"""Every query with an SQL twin gives the same rows and types in DuckDB."""

import pytest
from parity import connect, differences

import __spark_entry__ as contract
from querybook import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    sql = ORACLES[name]
    assert differences(df, duck, sql) == []
    wanted = {c[0]: str(c[1]) for c in duck.execute(sql).description}
    assert {c: TYPES[t] for c, t in df.dtypes} == wanted


def test_entry_gives_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
