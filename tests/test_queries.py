"""Every registered query of the engine against its SQL."""

import pytest

from comparing import assert_equal, database
from scrollsift.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert_equal(registry.QUERIES[name](spark, FOLDER), con, registry.ORACLES[name])


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
