"""Queries over boxes and regions, with their SQL."""

from pyspark.sql import functions as F

from foliolake.operators import layout as o
from foliolake.session import table

QUERIES, SQL = {}, {}

B = "b as (select distinct page_id, seq, box_id, coalesce(text,'') as text, translation, x, y, w, h, confidence from text_boxes)"
#: Eight regions on every page, in pairs of the same height that overlap. The tables hold no layout regions.
R = (
    "r as (select page_id, cast(k as int) as region_seq, case (k + page_id) % 6 when 0 then 'text_block' when 1 then 'technical_diagram' when 2 then 'chart' when 3 then 'table' when 4 then 'caption' else 'header_footer' end as region_type, "
    "cast(case when k % 2 = 0 then 20 else 100 end as int) as rx, cast(50 + (k // 2) * 400 as int) as ry, cast(case when k % 2 = 0 then 620 else 900 end as int) as rw, cast(case when k % 2 = 0 then 260 else 380 end as int) as rh, "
    "cast((k * 5 + 3) % 7 as int) as reading_order from book_pages cross join (select unnest(range(0, 8)) as k))"
)
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
POS = "partition by page_id order by y, x, seq, box_id"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def boxes(spark, d):
    return o.unique_boxes(table(spark, d, "text_boxes"))


def regions(spark, d):
    k = F.col("k")
    names = F.array(*[F.lit(x) for x in ("text_block", "technical_diagram", "chart", "table", "caption", "header_footer")])
    base = table(spark, d, "book_pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return base.select(
        "page_id", k.alias("region_seq"), F.element_at(names, ((k + F.col("page_id")) % 6 + 1).cast("int")).alias("region_type"), F.when(k % 2 == 0, 20).otherwise(100).alias("rx"), (F.floor(k / 2) * 400 + 50).cast("int").alias("ry"),
        F.when(k % 2 == 0, 620).otherwise(900).alias("rw"), F.when(k % 2 == 0, 260).otherwise(380).alias("rh"), ((k * 5 + 3) % 7).cast("int").alias("reading_order"),
    )


@query(f"with {B} select page_id, box_id, confidence from b where confidence > 30 and {STRIP.format('text')} <> ''")
def confident_boxes(spark, d):
    return o.confident(boxes(spark, d)).select("page_id", "box_id", "confidence")


@query(f"with {B} select page_id, box_id, cast(trunc(x*1240/1000.0) as int) as x, cast(trunc(y*1754/1000.0) as int) as y, cast(trunc(w*1240/1000.0) as int) as w, cast(trunc(h*1754/1000.0) as int) as h from b")
def denormalize_boxes(spark, d):
    return o.denormalize(boxes(spark, d), 1240, 1754)


@query(
    f"with {B}, q as (select page_id, box_id, greatest(0,x-50) as x1, greatest(0,y-50) as y1, least(1000,x+w+50) as x2, least(1700,y+h+50) as y2 from b) select page_id, box_id, x1 as x, y1 as y, x2-x1 as w, y2-y1 as h from q where x2 > x1 and y2 > y1"
)
def padded_boxes(spark, d):
    return o.pad_and_clamp(boxes(spark, d), 50)


@query(f"with {B} select page_id, box_id, cast(trunc(x*0.5) as int) as x, cast(trunc(y*0.5) as int) as y, cast(trunc(w*0.5) as int) as w, cast(trunc(h*0.5) as int) as h from b")
def scaled_boxes(spark, d):
    return o.scale_back(boxes(spark, d))


@query(f"with {B} select page_id, box_id, h > 1.6*w as vertical, greatest(10, least(cast(trunc(0.8*h) as int), cast(trunc(1.2*w) as int))) as font_size from b")
def vertical_text(spark, d):
    return o.vertical_text(boxes(spark, d))


@query(f"with {B} select page_id, box_id from b where w > 30 and h > 20 and w < 950 and h < 1615")
def region_size_filter(spark, d):
    return o.sized_regions(boxes(spark, d)).select("page_id", "box_id")


@query(f"with {B} select page_id, box_id from b where ((y < 5 or y + h > 1695) and length(text) > 10) or (y + h/2.0 > 1530 and length(text) > 20)")
def leaked_labels(spark, d):
    return o.leaked_labels(boxes(spark, d)).select("page_id", "box_id")


@query(f"with {B} select page_id, box_id, text, x, y, w, h, round(confidence/100.0*100, 6) as confidence from b")
def vertices_to_bbox(spark, d):
    b = boxes(spark, d)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    words = b.select("page_id", "box_id", F.split("text", "").alias("symbols"), F.array(corner(x + w, y + h), corner(x, y), corner(x, y + h), corner(x + w, y)).alias("vertices"), (F.col("confidence") / 100.0).alias("score"))
    return o.vertices_to_bbox(words)


_PROSE = f"{B}, {R}, p as (select * from b where not exists (select 1 from r where r.page_id=b.page_id and region_type in ('technical_diagram','chart') and b.x >= rx-5 and b.y >= ry-5 and b.x+b.w <= rx+rw+5 and b.y+b.h <= ry+rh+5))"


@query(f"with {_PROSE} select page_id, box_id from p")
def prose_boxes(spark, d):
    return o.prose_boxes(boxes(spark, d), regions(spark, d)).select("page_id", "box_id")


@query(f"with {_PROSE} select page_id, string_agg(text, chr(10) order by seq, box_id) as text, count(*) as n from p where text <> '' group by page_id")
def prose_text(spark, d):
    return o.joined_text(o.prose_boxes(boxes(spark, d), regions(spark, d)))


_ASSIGN = (
    f"{B}, {R}, k as (select *, row_number() over (partition by page_id order by ry, reading_order, region_seq) as rank from r), "
    "i as (select b.page_id, b.box_id, k.region_seq, k.region_type, k.rank, b.w*b.h as size, least(x+w,rx+rw)-greatest(x,rx) as ix, least(y+h,ry+rh)-greatest(y,ry) as iy from b join k on k.page_id=b.page_id), "
    "a as (select *, row_number() over (partition by page_id, box_id order by ix*iy desc, rank) as n from i where ix > 0 and iy > 0 and ix*iy > 0.5*size)"
)


@query(f"with {_ASSIGN} select page_id, box_id, region_seq, region_type, ix*iy as area from a where n = 1")
def region_assignment(spark, d):
    return o.assign_regions(boxes(spark, d), regions(spark, d))


@query(f"with {_ASSIGN} select page_id, box_id from b where box_id not in (select box_id from a)")
def unassigned_boxes(spark, d):
    b = boxes(spark, d)
    return b.join(o.assign_regions(b, regions(spark, d)), ["page_id", "box_id"], "left_anti").select("page_id", "box_id")


@query(
    f"with {B} select page_id, box_id from b where w > 250 or exists (select 1 from b n where n.page_id=b.page_id and n.box_id<>b.box_id and abs(n.y-b.y) > 0 and abs(n.y-b.y) < b.h*(case when b.w < 200 then 1.5 else 3.0 end) and (least(b.x+b.w,n.x+n.w)-greatest(b.x,n.x) > 0.3*least(b.w,n.w) or abs(n.x-b.x) < 30))"
)
def paragraph_boxes(spark, d):
    return o.paragraph_boxes(boxes(spark, d)).select("page_id", "box_id")


@query(
    f"with {B}, t as (select *, row_number() over ({POS}) as rank from b), m as (select page_id, rank, regexp_extract(text,'[-—]\\s*(\\d{{1,3}})\\s*[-—]',1) as num from t where rank <= 20 and (x < 300 or x > 700) and y < 255) select page_id, cast(arg_min(num, rank) as int) as number from m where num <> '' group by page_id"
)
def page_number_ocr(spark, d):
    return o.page_number_boxes(boxes(spark, d))


@query(f"with {R} select page_id, case when bool_or(rw*rh*(1 + page_id % 5) > 0.7*1700000) then 'full_page' else 'crops' end as strategy from r group by 1")
def table_strategy(spark, d):
    r = regions(spark, d).withColumn("rh", F.col("rh") * (1 + F.col("page_id") % 5))
    return o.table_strategy(r)


_GROUPS = f"{B}, l as (select *, case when abs(y - lag(y) over ({POS})) > 50 then 1 else 0 end as brk from b), g as (select *, cast(sum(brk) over ({POS}) as int) as group_no from l)"


@query(f"with {_GROUPS} select page_id, box_id, group_no from g")
def paragraph_groups(spark, d):
    return o.paragraph_groups(boxes(spark, d)).select("page_id", "box_id", "group_no")


@query(
    f"with {B}, l as (select *, case when abs(y - lag(y) over ({POS})) > 1.5*lag(h) over ({POS}) then 1 else 0 end as brk from b), g as (select *, cast(sum(brk) over ({POS}) as int) as line from l) "
    "select page_id, line, string_agg(text,' ' order by x, y, seq, box_id) as text, min(x) as x, min(y) as y, max(x+w)-min(x) as w, max(y+h)-min(y) as h, round(avg(confidence),6) as confidence from g group by 1,2"
)
def line_groups(spark, d):
    return o.line_groups(boxes(spark, d))


@query(f"with {B}, t as (select *, {STRIP.format('translation')} as t from b) select page_id, string_agg(t,' ' order by y,x,seq,box_id) as text from t where t <> '' group by 1")
def reading_text(spark, d):
    return o.reading_text(boxes(spark, d))


@query(
    f"with {B}, k as (select distinct page_id, least(y // 170, 9) as band from b), i as (select *, band - row_number() over (partition by page_id order by band) as island from k) select page_id, min(band)*170 as y_start, (max(band)+1)*170 as y_end from i group by page_id, island"
)
def band_merge(spark, d):
    return o.band_merge(boxes(spark, d))


_SECTIONS = (
    f"{B}, e as (select *, max(y+h) over ({POS} rows between unbounded preceding and 1 preceding) as before from b), k as (select *, case when y - before > 120 then 1 else 0 end as brk from e), "
    f"s as (select *, cast(sum(brk) over ({POS}) as int) as sec from k), t as (select page_id, sec*2+1 as n, 'text' as section_type, min(y) as y_start, greatest(max(y+h), coalesce(max(before),0)) as y_end from s group by page_id, sec), "
    "g as (select page_id, sec, before as a, y as z from s where brk = 1), v as (select g.page_id, g.sec, a, z, count(b.box_id) as k, avg(case when length(b.text) > 15 then 1.0 when b.box_id is not null then 0.0 end) as long, avg(length(b.text)) as mean from g left join b on b.page_id=g.page_id and b.y > a and b.y+b.h < z group by 1,2,3,4), "
    "sections as (select * from t union all select page_id, sec*2, case when k >= 8 and (long > 0.3 or mean > 20) then 'text' else 'diagram' end, a, z from v)"
)


@query(f"with {_SECTIONS} select page_id, n, section_type, y_start, y_end from sections")
def layout_sections(spark, d):
    return o.layout_sections(boxes(spark, d))


@query(f"with {R} select page_id, region_seq, row_number() over (partition by page_id order by ry, reading_order, region_seq) as position from r")
def reading_order(spark, d):
    return o.reading_order(regions(spark, d))


_DISPATCH = (
    f"{_ASSIGN}, c as (select page_id, region_seq, count(*) as boxes from a where n = 1 group by 1,2), "
    "q as (select r.page_id, r.region_seq, case region_type when 'technical_diagram' then 'diagram' when 'chart' then 'chart' when 'table' then 'table' else 'text' end as section_type, case region_type when 'technical_diagram' then 30 when 'chart' then 50 else 0 end as pad, ry, rh, coalesce(c.boxes,0) as nb from r left join c using (page_id, region_seq)), "
    "z as (select page_id, region_seq, section_type, greatest(0, ry-pad) as y_start, least(1700, ry+rh+pad) as y_end, case when section_type='table' then 0 else nb end as boxes from q where section_type <> 'text' or nb > 0)"
)


def _dispatched(spark, d):
    r = regions(spark, d)
    return o.dispatch_sections(r, o.assign_regions(boxes(spark, d), r))


@query(f"with {_DISPATCH} select * from z")
def section_dispatch(spark, d):
    return _dispatched(spark, d)


@query(
    f"with {_DISPATCH} select page_id, region_seq, 'paragraphs' as list from z where section_type='text' union all select page_id, region_seq, 'diagram_regions' from z where section_type in ('diagram','chart') union all select page_id, region_seq, 'chart_regions' from z where section_type='chart'"
)
def region_lists(spark, d):
    return o.region_lists(_dispatched(spark, d))


@query(
    f"with {_DISPATCH}, f as (select *, cast(coalesce(sum(boxes) over (partition by page_id order by y_start, region_seq rows between unbounded preceding and 1 preceding),0) as bigint) as off from z), "
    "t as (select page_id, region_seq, row_number() over (partition by page_id order by y_start, region_seq) as k from z where section_type='table'), u as (select page_id, table_id as artifact_seq, row_number() over (partition by page_id order by table_id) as k from (select distinct page_id, table_id from table_cells)) "
    "select f.page_id, f.region_seq, f.section_type, f.off as \"offset\", u.artifact_seq from f left join t using (page_id, region_seq) left join u on u.page_id = t.page_id and u.k = t.k"
)
def positional_zip(spark, d):
    arts = table(spark, d, "table_cells").select("page_id", F.col("table_id").alias("artifact_seq")).distinct()
    return o.positional_zip(_dispatched(spark, d), "boxes", arts)


@query(
    f"with {_DISPATCH}, s as (select * from z where section_type in ('text','table')), m as (select page_id, region_seq as mark_seq, y_start as a, y_end as e from z where section_type='diagram') select s.page_id, s.region_seq as section, min(mark_seq) as mark_seq from s join m on m.page_id=s.page_id and a < y_end and e > y_start group by 1,2"
)
def diagram_match(spark, d):
    z = _dispatched(spark, d)
    s = z.filter("section_type in ('text', 'table')").select("page_id", F.col("region_seq").alias("section"), "y_start", "y_end")
    m = z.filter("section_type = 'diagram'").select("page_id", F.col("region_seq").alias("mark_seq"), F.col("y_start").alias("m_start"), F.col("y_end").alias("m_end"))
    return o.match_intervals(s, m)


# Folds: the SQL steps through the ordered boxes with a recursive query.

_PT = (
    f"{_GROUPS}, t as (select *, row_number() over (partition by page_id, group_no order by y, x, seq, box_id) as i, {STRIP.format('translation')} as tr from g where translation is not null and translation <> ''), "
    "f as (select page_id, group_no, i, y as anchor, 0 as line, x, tr from t where i = 1 union all select t.page_id, t.group_no, t.i, case when abs(t.y - f.anchor) <= 20 then f.anchor else t.y end, f.line + case when abs(t.y - f.anchor) <= 20 then 0 else 1 end, t.x, t.tr from f join t on t.page_id=f.page_id and t.group_no=f.group_no and t.i=f.i+1)"
)


@query(f"with recursive {_PT} select page_id, group_no, coalesce(string_agg(case when tr <> '' then tr end, ' ' order by line, x, i), '') as text from f group by 1,2")
def paragraph_text(spark, d):
    return o.paragraph_text(o.paragraph_groups(boxes(spark, d)))


def _cluster_sql(gap):
    return (
        f"with recursive {B}, t as (select *, row_number() over ({POS}) as i from b), "
        "f as (select page_id, i, 0 as cluster, x as cx, y as cy, w as cw, h as ch, text as ct from t where i = 1 union all select t.page_id, t.i, f.cluster + case when m then 0 else 1 end, case when m then f.cx else t.x end, case when m then f.cy else t.y end, "
        f"case when m then greatest(f.cx+f.cw, t.x+t.w)-f.cx else t.w end, case when m then greatest(f.ch,t.h) else t.h end, case when m then {STRIP.format('f.ct||t.text')} else t.text end "
        f"from f join t on t.page_id=f.page_id and t.i=f.i+1, lateral (select abs(t.y-f.cy) <= 8 and t.x-(f.cx+f.cw) between 0 and {gap} as m)) "
        "select page_id, cluster, cx as x, cy as y, cw as w, ch as h, ct as text from (select *, row_number() over (partition by page_id, cluster order by i desc) as last from f) where last = 1"
    )


def _labels(spark, d):
    """Boxes squeezed into rows of labels, so that neighbours meet."""
    b = boxes(spark, d)
    return b.withColumn("y", F.expr("cast(y div 100 * 40 as int)")).withColumn("x", F.expr("cast(x + (seq % 5) * 60 as int)")).withColumn("w", F.expr("cast(least(w, 55) as int)"))


_LB = B.replace("x, y, w, h,", "cast(x + (seq % 5) * 60 as int) as x, cast(y // 100 * 40 as int) as y, cast(least(w, 55) as int) as w, h,")


@query(_cluster_sql(10).replace(B, _LB))
def label_clusters(spark, d):
    return o.label_clusters(_labels(spark, d), 10)


@query(_cluster_sql(15).replace(B, _LB))
def chart_label_clusters(spark, d):
    return o.label_clusters(_labels(spark, d), 15)


_TOUCH = "not (t.x > o.x + o.w or o.x > t.x + t.w or t.y > o.y + o.h or o.y > t.y + t.h)"
_UNION = "struct_pack(x := least(o.x, t.x), y := least(o.y, t.y), w := greatest(o.x + o.w, t.x + t.w) - least(o.x, t.x), h := greatest(o.y + o.h, t.y + t.h) - least(o.y, t.y))"


@query(
    f"with recursive {B}, t as (select *, row_number() over (partition by page_id order by seq, box_id) as i from b), "
    "f as (select page_id, i, [struct_pack(x := x, y := y, w := w, h := h)] as out from t where i = 1 union all "
    f"select t.page_id, t.i, case when k = 0 then list_append(f.out, struct_pack(x := t.x, y := t.y, w := t.w, h := t.h)) else list_transform(f.out, lambda o, n: case when n = k then {_UNION} else o end) end "
    f"from f join t on t.page_id = f.page_id and t.i = f.i + 1, lateral (select coalesce(list_position(list_transform(f.out, lambda o: {_TOUCH}), true), 0) as k)), "
    "z as (select page_id, out from (select *, row_number() over (partition by page_id order by i desc) as last from f) where last = 1) "
    "select page_id, cast(n as int) as merged, m.x, m.y, m.w, m.h from (select page_id, unnest(out) as m, unnest(range(len(out))) as n from z)"
)
def merge_overlaps(spark, d):
    return o.merge_overlaps(boxes(spark, d))


@query(f"with {B} select page_id, box_id from b where confidence > 20 and {STRIP.format('text')} <> '' and w > 3 and w < 1000 and h > 3 and h < 1700")
def diagram_text_boxes(spark, d):
    return o.confident(boxes(spark, d), 20, within=(o.PAGE_W, o.PAGE_H)).select("page_id", "box_id")


@query(f"with {B} select page_id, box_id from b where confidence >= 10 and {STRIP.format('text')} <> ''")
def overlay_boxes(spark, d):
    return o.confident(boxes(spark, d), 10, inclusive=True).select("page_id", "box_id")


@query(f"with {B} select page_id, box_id, greatest(4, least(cast(trunc(h*0.7*0.5) as int), 10)) as chart_font, greatest(6, least(cast(trunc(h*0.6*0.5) as int), 10)) as diagram_font from b")
def label_fonts(spark, d):
    h = F.col("h")
    return boxes(spark, d).select("page_id", "box_id", o.label_font(h, 0.5, True).alias("chart_font"), o.label_font(h, 0.5, False).alias("diagram_font"))


def _merge_sql(short):
    absorb = f" or (f.st='diagram' and o.section_type='text' and o.y_end-o.y_start < {short})" if short else ""
    return (
        f"with recursive {_SECTIONS}, o as (select *, row_number() over (partition by page_id order by n, section_type, y_start, y_end) as i from sections), "
        "f as (select page_id, i, 0 as grp, section_type as st, y_start as a, y_end as z from o where i = 1 union all select o.page_id, o.i, f.grp + case when m then 0 else 1 end, case when m then f.st else o.section_type end, case when m then f.a else o.y_start end, case when m and o.section_type='diagram' then greatest(f.z,o.y_end) else o.y_end end "
        f"from f join o on o.page_id=f.page_id and o.i=f.i+1, lateral (select (f.st='diagram' and o.section_type='diagram' and o.y_start-f.z < 300){absorb} as m)) "
        "select page_id, grp as n, st as section_type, a as y_start, z as y_end from (select *, row_number() over (partition by page_id, grp order by i desc) as last from f) where last = 1"
    )


@query(_merge_sql(80))
def merged_sections(spark, d):
    return o.merge_sections(o.layout_sections(boxes(spark, d)))


@query(_merge_sql(None))
def merged_diagrams(spark, d):
    return o.merge_sections(o.layout_sections(boxes(spark, d)), short=None)
