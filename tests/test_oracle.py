"""Every registered query equals its DuckDB oracle on the sf0.01 tables."""

import pytest

from canopy.plans import load_all
from oracle import compare

REG = load_all()
WITH_SQL = sorted(n for n, q in REG.items() if q.sql is not None)
NO_SQL = sorted(n for n, q in REG.items() if q.sql is None)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, duck, name):
    r = compare(spark, duck, name, REG[name], "/root/testdata/sf0.01")
    assert "error" not in r, r
    assert r["rows"] == r["oracle_rows"]


@pytest.mark.parametrize("name", NO_SQL)
def test_runs_without_oracle(spark, name):
    assert REG[name].build(spark, "/root/testdata/sf0.01").count() >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
