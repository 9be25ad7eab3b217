"""Every catalogue entry against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from posequarry.plans import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
catalog.load_all()
NAMES = sorted(catalog.PLANS)


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_plan_equals_sql(spark, tables, name):
    ok, message, _, _ = compare(spark, tables, name, FOLDER)
    assert ok, message


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 12


def test_sql_covers_only_known_plans():
    assert set(entry.oracle_sql()) <= set(entry.queries())
