"""Every registered query against its check SQL on the smallest data set."""
import pytest
from conftest import SMALL
from oracle import compare, connect

from promptloom.plans import catalog


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, name, catalog.QUERIES[name], catalog.CHECKS.get(name), SMALL)
    assert ok, note


def test_every_check_has_a_query():
    assert set(catalog.CHECKS) <= set(catalog.QUERIES)


def test_entry_runs(spark):
    from __spark_entry__ import entry
    assert entry(spark).columns == ["conv_id", "turn", "system", "user", "assistant"]
