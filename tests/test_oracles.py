"""Every registered query: equal to its DuckDB SQL, or at least not empty and stable in schema."""

import pytest
from compare import compare, connect
from conftest import SF

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        equal, message = compare(df, con, ORACLES[name])
        assert equal and not message, message
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["item", "total_value", "value_pct", "cumulative_pct", "abc_class"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
