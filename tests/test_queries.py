"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest

from check import rows_of
from stargauge.queries import all_queries

QUERIES = all_queries()
# Fits without SQL; their estimators are tested in test_models.
FITS = {name for name, found in QUERIES.items() if found.sql is None}


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - FITS))
def test_query_matches_sql(name, warehouse, duck):
    df = QUERIES[name].run(warehouse)
    expected = duck.execute(QUERIES[name].sql)
    names = [column[0] for column in expected.description]
    assert sorted(names) == sorted(df.columns)
    mine = rows_of(df.columns, [tuple(row) for row in df.collect()])
    assert mine == rows_of(names, expected.fetchall())


def test_only_iterative_fits_lack_sql():
    assert all(name.startswith(("m7_", "m8_", "m9_", "m10_", "m11_", "m17_")) for name in FITS)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as contract

    first, second = contract.entry(spark), contract.entry(spark)
    assert first.schema == second.schema
    assert first.count() == second.count() > 0
