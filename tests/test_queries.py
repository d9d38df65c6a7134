"""Every registered query with SQL against DuckDB; those without must run."""

from __future__ import annotations

import pytest

from tests.compare import assert_same
from winnower.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, duck, SQL[name])
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
