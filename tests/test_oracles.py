"""Every query with SQL gives what DuckDB gives on the same tables."""

import pytest
from common import DATA, duck, rows_of

from voxmere.plans import registry

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, con, name):
    ours = registry.QUERIES[name](spark, f"{DATA}/{SF}").toPandas()
    theirs = con.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows_of(ours.astype(object).where(ours.notna(), None)), rows_of(theirs.astype(object).where(theirs.notna(), None))
    assert len(a) == len(b)
    assert [[_number(v) for v in r] for r in a] == [[_number(v) for v in r] for r in b]


def _number(v):
    try:
        return float(v)
    except ValueError:
        return v


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
