"""Every query of the core that has SQL gives the same rows in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

from foliolake.queries import registry
from tests.parity import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, con, name):
    assert compare(con, registry.QUERIES[name](spark, SF), registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
