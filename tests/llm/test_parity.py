"""Queries with SQL give the same rows in DuckDB; every query runs on the smallest tables and comes out with its columns."""

from pathlib import Path

import pytest

from foliolake.llm import queries as q
from tests.parity import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
COLUMNS = {
    "p1_found": "rec_kind string, rec_id bigint, defect string",
    "p3_found": "rec_kind string, rec_id bigint, line_no int, noise string",
    "p4_found": "rec_kind string, id_a bigint, id_b bigint",
    "p5_found": "page_id bigint, src_start int, tgt_start int",
    "p6_found": "rec_kind string, rec_id bigint, start_pos int, lang string",
    "p7_found": "page_id bigint, start_pos int",
    "p8_ids": "doc_id bigint, ids array<int>",
    "p9_found": "doc_id bigint, item_id bigint",
    "p10_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows(spark, name):
    assert compare(connect(SF), q.QUERIES[name](spark, SF), q.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_runs(spark, name):
    df = q.QUERIES[name](spark, SF)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
        rows = df.collect()
        assert rows and (name in ("p8_ids",) or len(set(rows)) == len(rows))
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["p4_found", "p4_classes", "p4_forms", "p8_ids", "p9_found", "p9_runs", "p10_found", "p10_pieces"])
def test_no_cross_joins(spark, name):
    plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
