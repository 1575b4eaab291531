"""Each query of the engine against its SQL, by another engine over the same tables."""

from __future__ import annotations

import pytest

from driftline.queries import ORACLES, QUERIES

from .conftest import DATA, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    assert rows_of(df) == sql_rows(duck, ORACLES[name], df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["tid", "n_types", "span"]
