"""Queries of nested records. Their SQL steps through the JSON with a recursive query."""

from pyspark.sql import functions as F

from foliolake.operators import nested as n
from foliolake.operators import quality as q
from foliolake.session import spread, table


def bodies(spark, sf_dir):
    return spread(table(spark, sf_dir, "artifacts").select("artifact_id", "body"))


def p2_found(spark, sf_dir):
    """Every table, cell, rendering and annotation of every artifact body, linked to its parent."""
    return n.dewey_nodes(bodies(spark, sf_dir), "artifact_id", "body").select("artifact_id", "node_kind", "parent_path", "node_path")


def _flat(kind):
    def run(spark, sf_dir):
        nodes = n.dewey_nodes(bodies(spark, sf_dir), "artifact_id", "body", payload=True)
        return n.flat(nodes, "artifact_id", kind, n.COLUMNS[kind])

    run.__doc__ = f"The flat table of the {kind}s: one row each with its own columns and its parent's path."
    return run


def diagram_annotations(spark, sf_dir):
    """Annotations of the artifacts with defaults and ids."""
    return q.normal_annotations(_flat("annotation")(spark, sf_dir))


def rendered_key(spark, sf_dir):
    """Labels of the key and on the image by the renderings' modes; the stored modes say how a diagram is drawn, so a label's mode is laid by a formula."""
    a = _flat("annotation")(spark, sf_dir).filter("schema_path = 'diagram_renderings.annotations'")
    mode = F.when(F.length(F.coalesce("text", F.lit(""))) % 3 == 0, "key").when(F.length(F.coalesce("text", F.lit(""))) % 3 == 1, "image").otherwise("other")
    return q.rendered_key(a.select("artifact_id", "text", mode.alias("mode"), (F.regexp_extract("parent_path", r"(\d+)", 1).cast("int") * 10_000 + F.col("ordinal")).alias("seq")))


QUERIES = {
    "p2_found": p2_found, "p2_tables": _flat("table"), "p2_cells": _flat("cell"), "p2_renderings": _flat("rendering"), "p2_annotations": _flat("annotation"),
    "diagram_annotations": diagram_annotations, "rendered_key": rendered_key,
}


def _read(e):
    """A member stored as a string of JSON, also of one encoded twice, is that JSON."""
    inner = f"case when json_type({e}) = 'VARCHAR' then case when json_valid({e}->>'$') then cast({e}->>'$' as json) end else {e} end"
    return inner


def _items(e):
    return f"case json_type({e}) when 'ARRAY' then cast({e} as json[]) when 'OBJECT' then [{e}] else cast([] as json[]) end"


def _members(source, columns, member, alias):
    """Rows of ``source`` with the elements of a member: c (its JSON) and i (its ordinal)."""
    got = f"select {columns}, j->'$.{member}' as m0 from {source}"
    once = f"select *, {_read('m0')} as m1 from ({got})"
    twice = f"select *, {_read('m1')} as m2 from ({once})"
    each = f"select *, {_items('m2')} as l from ({twice})"
    return f"(select * exclude (m0, m1, m2, l), {_read('e')} as c, i as ord from (select *, unnest(l) as e, unnest(range(len(l))) as i from ({each}))) {alias}"


_TOP = " union all ".join(
    f"select artifact_id, '{kind}' as node_kind, '' as parent_path, '{member}['||ord||']' as node_path, '{member}' as schema_path, ord, c as j from {_members('body', 'artifact_id, j', member, 'x')} where json_type(c) = 'OBJECT'"
    for member, (kind, _) in n.PAGE_ARTIFACTS.items()
)
_BELOW = "case node_kind when 'table' then 'cells' when 'rendering' then 'annotations' else 'children' end"
_STEP = _members("(select *, case node_kind when 'table' then j->'$.cells' when 'rendering' then j->'$.annotations' when 'annotation' then j->'$.children' end as below from nodes)", "artifact_id, node_kind, node_path, schema_path, below", "x", "y").replace("j->'$.x' as m0", "below as m0")
NODES = (
    "body as (select artifact_id, case when json_valid(body) then cast(body as json) end as j from artifacts where json_valid(body) and json_type(case when json_valid(body) then cast(body as json) end) = 'OBJECT'), "
    f"top as ({_TOP}), nodes as (select * from top union all select artifact_id, case node_kind when 'table' then 'cell' else 'annotation' end, node_path, node_path||'.'||{_BELOW}||'['||ord||']', schema_path||'.'||{_BELOW}, ord, c from {_STEP} where json_type(c) = 'OBJECT')"
)


def _flat_sql(kind):
    def column(name, kind_, members):
        at = [f"j->>'$.{m.split('.')[0]}[{m.split('.')[1]}]'" if m[-1].isdigit() else f"j->>'$.{m}'" for m in members]
        value = [a if kind_ == "string" else f"try_cast(trunc(try_cast({a} as double)) as int)" for a in at]
        return f"coalesce({', '.join(value)}) as {name}" if len(value) > 1 else f"{value[0]} as {name}"

    columns = ", ".join(column(*c) for c in n.COLUMNS[kind])
    return f"with recursive {NODES} select artifact_id, node_path, parent_path, schema_path, cast(ord as int) as ordinal, {columns} from nodes where node_kind = '{kind}'"


_Z = ", ".join(f"coalesce({c}, 0) as {c}" for c in "xywh")
SQL: dict[str, str] = {
    "p2_found": f"with recursive {NODES} select artifact_id, node_kind, parent_path, node_path from nodes",
    **{f"p2_{kind}s": _flat_sql(kind) for kind in n.COLUMNS},
    "diagram_annotations": f"select artifact_id, node_path, substring(sha256(artifact_id||'/'||node_path), 1, 32) as annotation_id, {_Z}, coalesce(original,'') as original, coalesce(text,'') as text from ({_flat_sql('annotation')})",
    "rendered_key": f"with a as ({_flat_sql('annotation')}), k as (select artifact_id, coalesce(text,'') as text, case length(coalesce(text,'')) % 3 when 0 then 'key' when 1 then 'on_image' end as list, cast(regexp_extract(parent_path,'(\\d+)',1) as int) * 10000 + ordinal as seq from a where schema_path = 'diagram_renderings.annotations'), f as (select artifact_id, list, text, min(seq) as seq from k where list is not null group by 1,2,3) select artifact_id, list, string_agg(text, '|' order by seq, text) as labels from f group by 1,2",
}
