"""Deeply nested semi-structured records as flat related tables, by Dewey labelling.

Every node of interest in a JSON body gets a label: the list of (member, ordinal) steps from the
root to it. The label alone determines the node's path, its parent (the label cut by one step)
and its table (the members without the ordinals), so no join is needed to relate the rows.

Defined results: a null, empty or incomplete body gives no rows, nor does one whose top is no
object; null elements use up an ordinal but give no row; one object in place of an array has
ordinal 0; a member that is a string holding JSON is read as that JSON (also when encoded twice);
elements that are no objects give no row. Members nested deeper than the JSON parser's limit
(some thousands of levels) make the body unreadable and give no rows. Of a repeated member the
last one counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: member -> (kind, members below); "*" below repeats the same members at any depth.
Spec = dict[str, tuple[str, "Spec | str"]]

_ANNOTATION: Spec = {"children": ("annotation", "*")}
PAGE_ARTIFACTS: Spec = {
    "tables": ("table", {"cells": ("cell", {})}),
    "diagram_renderings": ("rendering", {"annotations": ("annotation", _ANNOTATION)}),
    "annotations": ("annotation", _ANNOTATION),
}

_STEP = pa.struct([("member", pa.string()), ("ord", pa.int32())])


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _loads(text: str):
    return json.loads(text, parse_constant=_no_constant)


def _elements(value: object) -> list:
    """The array a member stands for."""
    while isinstance(value, str):
        try:
            value = _loads(value)
        except (ValueError, RecursionError):
            return []
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def walk(body: str | None, spec: Spec) -> Iterator[tuple[str, list[tuple[str, int]], dict]]:
    """(kind, label, node) of every node of ``spec`` in one body, parents before children."""
    if not body:
        return
    try:
        top = _loads(body)
    except (ValueError, RecursionError):
        return
    if not isinstance(top, dict):
        return
    stack = [(top, spec, ())]
    while stack:
        node, members, label = stack.pop()
        below = []
        for member, (kind, deeper) in members.items():
            if member not in node:
                continue
            for i, child in enumerate(_elements(node[member])):
                while isinstance(child, str):
                    try:
                        child = _loads(child)
                    except (ValueError, RecursionError):
                        break
                if isinstance(child, dict):
                    at = (*label, (member, i))
                    yield kind, list(at), child
                    below.append((child, members if deeper == "*" else deeper, at))
        stack.extend(reversed(below))


def _names(spec: Spec) -> set[str]:
    """All members that have rows of their own."""
    out = set(spec)
    for _, deeper in spec.values():
        if deeper != "*":
            out |= _names(deeper)
    return out


def _payload(node: dict, nested: set[str]) -> str:
    """The node's own values, those of inner objects and lists under dotted names; what has rows of its own is left out."""
    out: dict[str, object] = {}
    stack = [(k, v) for k, v in node.items() if k not in nested]
    while stack:
        name, v = stack.pop()
        if isinstance(v, (dict, list)):
            stack += [(f"{name}.{k}", x) for k, x in (v.items() if isinstance(v, dict) else enumerate(v))]
        else:
            out[name] = v
    return json.dumps(out, ensure_ascii=False)


def _path(label: Column) -> Column:
    return F.array_join(F.transform(label, lambda s: F.concat(s["member"], F.lit("["), s["ord"].cast("string"), F.lit("]"))), ".")


def dewey_nodes(df: DataFrame, key: str, body: str, spec: Spec = PAGE_ARTIFACTS, payload: bool = False) -> DataFrame:
    """One row for each node: key, node_kind, label, node_path, parent_path, schema_path[, payload].

    One pass over the bodies inside the partitions, no shuffle: a body of any size or a key that
    holds a third of the rows costs no more than its bytes.
    """
    kind_of = df.schema[key].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind_of]
    nested = _names(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("key", arrow_key), ("node_kind", pa.string()), ("label", pa.list_(_STEP))] + [("payload", pa.string())] * payload
        schema = pa.schema(fields)

        def out(keys, kinds, members, ords, ends, loads):
            steps = pa.StructArray.from_arrays([pa.array(members, pa.string()), pa.array(ords, pa.int32())], fields=list(_STEP))
            cols = [pa.array(keys, arrow_key), pa.array(kinds, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)]
            return pa.RecordBatch.from_arrays(cols + [pa.array(loads, pa.string())] * payload, schema=schema)

        for batch in batches:
            keys, kinds, members, ords, ends, loads = [], [], [], [], [0], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, label, node in walk(text, spec):
                    keys.append(k)
                    kinds.append(kind)
                    for member, i in label:
                        members.append(member)
                        ords.append(i)
                    ends.append(len(members))
                    if payload:
                        loads.append(_payload(node, nested))
                if len(keys) >= 20_000:
                    yield out(keys, kinds, members, ords, ends, loads)
                    keys, kinds, members, ords, ends, loads = [], [], [], [], [0], []
            if keys:
                yield out(keys, kinds, members, ords, ends, loads)

    schema = f"key {kind_of}, node_kind string, label array<struct<member:string,ord:int>>" + ", payload string" * payload
    nodes = df.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body")).mapInArrow(run, schema)
    label = F.col("label")
    return nodes.select(
        F.col("key").alias(key),
        "node_kind",
        "label",
        _path(label).alias("node_path"),
        _path(F.slice(label, 1, F.size(label) - 1)).alias("parent_path"),
        F.array_join(F.transform(label, lambda s: s["member"]), ".").alias("schema_path"),
        *(["payload"] * payload),
    )


_BOX = [(c, "int", (f"bbox.{c}", f"bbox.{i}")) for i, c in enumerate("xywh")]
#: Columns of each kind's table beside its keys: name, type and the members it may come from (fixed values, the first that is there counts).
COLUMNS: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {
    "table": [("table_key", "string", ("id",)), ("table_type", "string", ("type",)), ("rows", "int", ("rows",)), ("cols", "int", ("cols",)), *_BOX],
    "cell": [("row_idx", "int", ("row",)), ("col_idx", "int", ("col",)), ("text", "string", ("text",)), ("translation", "string", ("translation",)), ("row_span", "int", ("row_span",)), ("col_span", "int", ("col_span",))],
    "rendering": [("diagram_key", "string", ("diagram_id",)), ("mode", "string", ("mode",)), *_BOX],
    "annotation": [*[(c, "int", (c,)) for c in "xywh"], ("original", "string", ("original",)), ("text", "string", ("text",)), ("mode", "string", ("mode",))],
}


def related_tables(df: DataFrame, key: str, body: str, spec: Spec = PAGE_ARTIFACTS, columns: dict[str, list[tuple[str, str, tuple[str, ...]]]] = COLUMNS) -> dict[str, DataFrame]:
    """The nodes as one flat table for each kind: (key, node_path), parent_path, schema_path, ordinal, and the kind's own columns.

    The bodies are parsed once (the nodes are written to a reliable checkpoint, of which each table is a
    filter). A member that is missing, or is no value of the column's type, gives null; numbers
    written as strings are numbers.
    """
    from foliolake.session import checkpointed

    nodes = checkpointed(dewey_nodes(df, key, body, spec, payload=True))
    kinds: dict[str, None] = {}

    def collect(members: Spec) -> None:
        for kind, deeper in members.values():
            kinds[kind] = None
            if deeper != "*":
                collect(deeper)

    collect(spec)
    return {kind: flat(nodes, key, kind, columns.get(kind, [])) for kind in kinds}


def flat(nodes: DataFrame, key: str, kind: str, columns: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """The typed table of one kind of ``dewey_nodes`` with payload."""
    members = [m for _, _, ms in columns for m in ms]
    some = nodes.filter(F.col("node_kind") == kind)
    if members:
        some = some.withColumn("m", F.from_json("payload", ", ".join(f"`{m}` string" for m in dict.fromkeys(members))))
    typed = [F.coalesce(*[F.col(f"m.`{m}`") if t == "string" else F.col(f"m.`{m}`").try_cast("double").try_cast(t) for m in ms]).alias(name) for name, t, ms in columns]
    return some.select(key, "node_path", "parent_path", "schema_path", F.element_at("label", -1)["ord"].alias("ordinal"), *typed)
