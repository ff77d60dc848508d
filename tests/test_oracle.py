"""Every registered query of the library against DuckDB over the smallest driver tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from siftlake.plans import catalog
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """All comparisons, several at a time: on so little data planning takes most of it."""
    con = connect(SF_DIR)

    def run(name):
        try:
            return compare(spark, con.cursor(), name, catalog.QUERIES[name], catalog.ORACLE[name], SF_DIR)
        except Exception as e:  # noqa: BLE001
            return f"{type(e).__name__} {e}"

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(catalog.ORACLE, pool.map(run, catalog.ORACLE)))


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query_equals_sql(results, name):
    assert results[name].startswith("ok"), results[name]


def test_every_query_has_a_twin():
    assert set(catalog.ORACLE) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert "highest_severity" in entry.entry(spark).columns
