"""Plans stay scalable: no cross or nested-loop joins, and scans read no more columns than they need."""

from pathlib import Path

import pytest

from foliolake.queries import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"running_status_stream", "recovered_pages"}))
def test_no_cross_joins(spark, name):
    p = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_pushdown(spark):
    p = plan(registry.QUERIES["queue_by_status"](spark, SF))
    assert "PushedFilters: [In(status" in p and "ocr_text" not in p
    assert "ocr_text" not in plan(registry.QUERIES["project_progress"](spark, SF))
