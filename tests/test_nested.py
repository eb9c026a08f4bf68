import json
import random

from foliolake.operators.nested import dewey_nodes, related_tables


def brute(body):
    """Plain recursion over the same rules."""
    try:
        top = json.loads(body or "")
    except ValueError:
        return set()
    out = set()

    def items(v):
        while isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return []
        return [v] if isinstance(v, dict) else v if isinstance(v, list) else []

    def annotations(v, member, parent):
        for i, a in enumerate(items(v)):
            if isinstance(a, dict):
                path = f"{parent + '.' if parent else ''}{member}[{i}]"
                out.add(("annotation", parent, path))
                annotations(a.get("children"), "children", path)

    if isinstance(top, dict):
        for i, t in enumerate(items(top.get("tables"))):
            if isinstance(t, dict):
                out.add(("table", "", f"tables[{i}]"))
                out.update(("cell", f"tables[{i}]", f"tables[{i}].cells[{j}]") for j, c in enumerate(items(t.get("cells"))) if isinstance(c, dict))
        for i, r in enumerate(items(top.get("diagram_renderings"))):
            if isinstance(r, dict):
                out.add(("rendering", "", f"diagram_renderings[{i}]"))
                annotations(r.get("annotations"), "annotations", f"diagram_renderings[{i}]")
        annotations(top.get("annotations"), "annotations", "")
    return out


def tree(rnd, depth=0):
    a = {"text": "t", "x": "3"}
    if depth < 4 and rnd.random() < 0.5:
        kids = [tree(rnd, depth + 1) if rnd.random() < 0.8 else None for _ in range(rnd.randint(0, 3))]
        a["children"] = rnd.choice([kids, json.dumps(kids), kids[0] if kids and kids[0] else [], None])
    return a


BODIES = [None, "", "[]", "5", '{"tables": [', '{"tables": null}', '{"tables": {"cells": {"row": 1}}, "meta": {"tables": [{}], "annotations": [{}]}}', '{"tables": "[{\\"cells\\": \\"[null, {}]\\"}]"}', '{"annotations": ["x", 3, null, {}]} trailing', '{"annotations": [NaN, {}]}', '{"annotations": ' + '{"children": [' * 60 + "{}" + "]}" * 60 + "}"]


def test_against_recursion(spark):
    rnd = random.Random(1)
    bodies = BODIES + [json.dumps({"annotations": [tree(rnd)], "diagram_renderings": [{"annotations": tree(rnd)}], "tables": [None, {"cells": [{}, None, {}]}]}) for _ in range(40)]
    df = spark.createDataFrame([(i, b, "clash", "x") for i, b in enumerate(bodies)], "artifact_id long, body string, node_path string, key string")
    rows = dewey_nodes(df, "artifact_id", "body").collect()
    for i, b in enumerate(bodies):
        want = set() if b and "NaN" in b else brute(b)
        assert {(r.node_kind, r.parent_path, r.node_path) for r in rows if r.artifact_id == i} == want, b


def test_empty_and_tables(spark):
    empty = spark.createDataFrame([], "artifact_id long, body string")
    assert dewey_nodes(empty, "artifact_id", "body").count() == 0
    one = spark.createDataFrame([(1, '{"tables": [{"id": "a", "cells": [{"text": "x"}]}]}'), (None, '{"tables": {}}')], "artifact_id long, body string")
    flat = related_tables(one, "artifact_id", "body")
    assert set(flat) == {"table", "cell", "rendering", "annotation"}
    assert [(r.artifact_id, r.parent_path, r.ordinal, r.text, r.row_idx) for r in flat["cell"].collect()] == [(1, "tables[0]", 0, "x", None)]
    assert sorted((r.artifact_id or 0, r.table_key or "") for r in flat["table"].collect()) == [(0, ""), (1, "a")]
    boxes = spark.createDataFrame([(1, '{"diagram_renderings": [{"bbox": {"x": "3", "y": 4.7, "w": null}}, {"bbox": [5, 6, 7, 8]}, {"bbox": "odd", "mode": 5}]}')], "artifact_id long, body string")
    got = related_tables(boxes, "artifact_id", "body")["rendering"].orderBy("ordinal").collect()
    assert [(r.x, r.y, r.w, r.h, r.mode) for r in got] == [(3, 4, None, None, None), (5, 6, 7, 8, None), (None, None, None, None, "5")]
