"""Every query with an oracle gives what SQL gives; the others give rows."""

from __future__ import annotations

import pytest

import registry.jobs_catalog  # noqa: F401
from registry.catalog import ENTRIES
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", sorted(ENTRIES))
def test_query(spark, sf_dir, con, entries, key):
    entry = entries[key]
    if entry.sql:
        assert difference(spark, con, sf_dir, entry) is None
    else:
        rows = entry.query(spark, sf_dir).collect()
        assert rows


def test_contract(spark):
    import __spark_entry__ as contract

    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert contract.entry(spark).columns == ["service_name", "stack", "f1"]
