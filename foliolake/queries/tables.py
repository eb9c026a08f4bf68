"""Queries over table cells, with their SQL."""

from pyspark.sql import functions as F

from foliolake.operators import tables as t
from foliolake.session import table

QUERIES, SQL = {}, {}
C = "c0 as (select distinct * from table_cells), c as (select * from (select *, row_number() over (partition by table_id, row_idx, col_idx order by cell_id desc) as last from c0) where last = 1)"
SHOWN = "coalesce(nullif(translation,''), text, '')"
G = f"{C}, z as (select table_id, max(row_idx) as mr, max(col_idx) as mc from c group by 1), g as (select z.table_id, i as row_idx, j as col_idx, mr, mc, c.cell_id, {SHOWN} as shown, row_span, col_span from z, lateral (select unnest(range(0, mr+1)) as i), lateral (select unnest(range(0, mc+1)) as j) left join c on c.table_id=z.table_id and c.row_idx=i and c.col_idx=j)"
NUM = "case when regexp_matches({0}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') then try_cast({0} as double) end"
TRIM = "regexp_replace({0},'^ +| +$','','g')"
CLEAN = "regexp_replace(" + TRIM.format("replace({0},',','')") + ",'%$','')"
DATE = "regexp_matches(trim({0}), '(?i)^(\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}|\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{4}}|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\s+\\d{{4}}|\\d{{4}})$')"
E = f"{C}, e as (select table_id, max(row_idx)+1 as rws, max(col_idx)+1 as cls from c group by 1 having max(row_idx) >= 1 and max(col_idx) >= 1), v0 as (select c.table_id, rws, cls, row_idx, col_idx, {TRIM.format(SHOWN)} as v from c join e using (table_id)), v as (select *, {NUM.format(CLEAN.format('v'))} as num, {DATE.format('v')} as dt from v0)"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cells(spark, d):
    return t.unique_cells(table(spark, d, "table_cells"))


@query(f"with {C} select table_id, max(row_idx)+1 as rows, max(col_idx)+1 as cols, count(*) as cells, (max(row_idx)+1)*(max(col_idx)+1)-count(*) as missing from c group by 1")
def grid_cells(spark, d):
    return t.grid_cells(cells(spark, d))


@query("select doc_id, cast(i - 1 as int) as row_idx, cast(j - 1 as int) as col_idx, string_split(string_split(text, chr(10))[i],' | ')[j] as text, string_split(string_split(text, chr(10))[i],' | ')[j] as translation from documents, lateral (select unnest(range(1, len(string_split(text, chr(10)))+1)) as i), lateral (select unnest(range(1, len(string_split(string_split(text, chr(10))[i],' | '))+1)) as j) where kind='parts_list' and text is not null")
def grid_from_lines(spark, d):
    """Lists of parts as cells: a line is a row, bars part the columns."""
    docs = table(spark, d, "documents").filter("kind = 'parts_list' and text is not null")
    grid = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda s: F.split(s, r" \| ")).alias("grid"))
    return t.rows_to_cells(grid, "doc_id", "grid")


@query(f"with {G}, l as (select table_id, row_idx, string_agg(replace(case when cell_id is null then '' else shown end, chr(10), ' '), ',' order by col_idx) as line from g group by 1,2) select table_id, regexp_replace(string_agg(line, chr(10) order by row_idx), '\\s+$', '') as csv from l group by 1")
def table_csv(spark, d):
    return t.csv_lines(cells(spark, d))


@query(
    f"with {G}, x as (select g.*, exists (select 1 from g o where o.cell_id is not null and o.table_id=g.table_id and (o.row_idx<>g.row_idx or o.col_idx<>g.col_idx) and g.row_idx between o.row_idx and o.row_idx+coalesce(o.row_span,1)-1 and g.col_idx between o.col_idx and o.col_idx+coalesce(o.col_span,1)-1 "
    "and not exists (select 1 from g q where q.cell_id is not null and q.table_id=o.table_id and (q.row_idx<>o.row_idx or q.col_idx<>o.col_idx) and o.row_idx between q.row_idx and q.row_idx+coalesce(q.row_span,1)-1 and o.col_idx between q.col_idx and q.col_idx+coalesce(q.col_span,1)-1)) as covered from g), "
    "r as (select table_id, row_idx, '<tr>'||string_agg(case when covered then '' when cell_id is null then '<td></td>' else '<td'||case when row_span > 1 then ' rowspan='''||row_span||'''' else '' end||case when col_span > 1 then ' colspan='''||col_span||'''' else '' end||'>'||shown||'</td>' end, '' order by col_idx)||'</tr>' as h from x group by 1,2) "
    "select table_id, '<table>'||string_agg(h,'' order by row_idx)||'</table>' as html from r group by 1"
)
def table_html(spark, d):
    return t.html_tables(cells(spark, d))


@query(f"with {C} select table_id, row_idx, col_idx, case when row_idx+row_span <= 3 and col_idx+col_span <= 3 then row_span else 1 end as row_span, case when row_idx+row_span <= 3 and col_idx+col_span <= 3 then col_span else 1 end as col_span from c where row_idx < 3 and col_idx < 3")
def table_matrix(spark, d):
    return t.in_grid(cells(spark, d), 3, 3)


@query(f"with {E} select distinct table_id, rws as rows, cls as cols from v")
def chart_eligible(spark, d):
    return t.eligible(cells(spark, d))


_TWO = f"{E}, h as (select table_id, max(rws) as rws, max(case when row_idx=0 and col_idx=0 then num end) is null and max(case when row_idx=0 and col_idx=1 then num end) is null as header, max(case when row_idx=0 and col_idx=1 then v end) as yt, count(*) filter (col_idx=1 and num is not null) as nn, count(*) filter (col_idx=0 and dt) as nd from v where cls=2 group by 1)"


@query(f"with {_TWO} select table_id, header, round(nn/rws,6) as numeric_ratio, nd/rws >= 0.7 as temporal from h")
def chart_two_col(spark, d):
    return t.two_column_charts(cells(spark, d)).select("table_id", "header", "numeric_ratio", "temporal")


@query(
    f"with {_TWO} select table_id, case when nd/rws >= 0.7 then 'line' when nn/rws >= 0.7 then 'bar' else 'line' end as mark, case when nn/rws >= 0.7 then 'quantitative' else 'nominal' end as y_type, case when header then yt||coalesce(' ['||nullif(trim(regexp_extract(yt,'\\(([^)]+)\\)',1)),'')||']','') end as title from h"
)
def chart_spec(spark, d):
    return t.two_column_charts(cells(spark, d)).select("table_id", "mark", "y_type", "title")


@query(f"with {_TWO} select x.table_id, x.row_idx, x.v as x, y.num as y, case when y.num is null then y.v end as y_text from v x join v y on y.table_id=x.table_id and y.row_idx=x.row_idx and y.col_idx=1 join h on h.table_id=x.table_id where x.cls=2 and x.col_idx=0 and (x.row_idx > 0 or not header)")
def chart_points(spark, d):
    return t.chart_points(cells(spark, d))


_MULTI = f"{E}, h as (select table_id, count(*) filter (row_idx=0 and col_idx>=1 and num is null) >= greatest(1, (max(cls)-1)//2) as header from v where cls >= 3 group by 1), m as (select v.*, header from v join h using (table_id)), body as (select * from m where row_idx > 0 or not header)"


@query(
    f"with {_MULTI} select y.table_id, y.row_idx, coalesce(x.v,'') as x, coalesce(nullif(n.v,''), 'Series '||y.col_idx) as series, y.num as y, case when y.num is null then y.v end as y_text from body y left join body x on x.table_id=y.table_id and x.row_idx=y.row_idx and x.col_idx=0 left join m n on n.table_id=y.table_id and n.col_idx=y.col_idx and n.row_idx=0 and n.header where y.col_idx >= 1"
)
def chart_multi_series(spark, d):
    return t.multi_series(cells(spark, d))


_STACK = f"{_MULTI}, a as (select table_id, coalesce(avg(case when col_idx=0 and row_idx < cast(header as int)+6 then cast(dt as int) end) >= 0.7, false) as temporal, avg(case when col_idx>=1 then case when num is not null then 1 else 0 end end) as nums, avg(case when col_idx>=1 then case when v like '%\\%' escape '\\' then 1 else 0 end end) as pct from body group by 1)"


@query(f"with {_STACK} select table_id, temporal, case when not temporal and nums >= 0.7 then 'bar' else 'line' end as mark, case when not temporal and nums >= 0.7 and pct >= 0.7 then 'normalize' when not temporal and nums >= 0.7 then 'zero' else 'none' end as stack from a")
def chart_stacking(spark, d):
    return t.stacking(cells(spark, d))


@query(f"with {_STACK} select table_id, 'zero' as stack from a")
def chart_stack_override(spark, d):
    return t.stacking(cells(spark, d)).select("table_id", t.override_stack(F.col("stack"), "zero").alias("stack"))


def _dated(spark, d):
    """First columns made of dates of several shapes, from the orders."""
    o = table(spark, d, "orders")
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 6
    shape = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "d.M.yyyy")).when(k == 2, F.date_format(day, "MMM yyyy")).when(k == 3, F.date_format(day, "yyyy")).when(k == 4, F.date_format(day, "dd/MM/yyyy")).otherwise("n/a")
    return o.select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").cast("int").alias("row_idx"), F.lit(0).alias("col_idx"), shape.alias("text"), F.lit(None).cast("string").alias("translation"))


_DATED = "o as (select o_custkey as table_id, o_orderkey as row_idx, case o_orderkey % 6 when 0 then strftime(o_orderdate,'%Y-%m-%d') when 1 then strftime(o_orderdate,'%-d.%-m.%Y') when 2 then strftime(o_orderdate,'%b %Y') when 3 then strftime(o_orderdate,'%Y') when 4 then strftime(o_orderdate,'%d/%m/%Y') else 'n/a' end as text, o_orderdate, o_orderkey % 6 as k from orders)"


@query(f"with {_DATED}, q as (select table_id, case k when 2 then 'yearmonth' when 3 then 'year' when 5 then '' else 'date' end as granularity, row_idx from o), n as (select table_id, granularity, count(*) as n, min(row_idx) as first from q group by 1,2) select table_id, granularity from (select *, row_number() over (partition by table_id order by n desc, first) as r from n) where r = 1")
def dominant_granularity(spark, d):
    return t.dominant_granularity(_dated(spark, d))


@query(f"with {_DATED} select row_idx, text, case k when 0 then strftime(o_orderdate,'%Y-%m-%d') when 1 then strftime(o_orderdate,'%Y-%m-%d') when 4 then strftime(o_orderdate,'%Y-%m-%d') when 2 then strftime(o_orderdate,'%Y-%m-01') when 3 then strftime(o_orderdate,'%Y-01-01') end as day, case k when 2 then 'yearmonth' when 3 then 'year' when 5 then null else 'date' end as granularity, k <> 5 as date_like from o")
def date_normalise(spark, d):
    x = _dated(spark, d)
    return x.select("row_idx", "text", t.normalize_date(F.col("text"))["day"].alias("day"), t.normalize_date(F.col("text"))["granularity"].alias("granularity"), t.looks_like_date(F.col("text")).alias("date_like"))


@query(f"with {C} select cell_id, {NUM.format(CLEAN.format('text'))} as num, nullif(trim(regexp_extract(text,'\\(([^)]+)\\)',1)),'') as unit from c")
def numeric_parse(spark, d):
    return cells(spark, d).select("cell_id", t.parse_number(F.col("text")).alias("num"), t.unit_of(F.col("text")).alias("unit"))
