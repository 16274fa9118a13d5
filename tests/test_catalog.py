"""Every catalog entry against its DuckDB oracle, on the smallest given tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from herdwatch.catalog.all import entries
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ENTRIES = {e.name: e for e in entries()}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["node", "op", "n", "overflowed", "p95", "p99"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert all(e.oracle for e in ENTRIES.values())
    assert set(ENTRIES) <= set(contract.queries()) & set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query_equals_its_oracle(spark, duck, name):
    assert compare(ENTRIES[name].run(spark, SF_DIR), duck, ENTRIES[name].oracle) is None
