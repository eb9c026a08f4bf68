"""Queries of quality and labels, with their SQL."""

from pyspark.sql import functions as F

from foliolake.operators import quality as q
from foliolake.session import table

QUERIES, SQL = {}, {}
BL = "coalesce(regexp_replace({0},'^\\s+|\\s+$','','g'),'') = ''"
LEN = "length(regexp_replace({0},'^\\s+|\\s+$','','g'))"
#: A table's cells count once; a box is a label of its page's diagram (of its third of the page).
C = "c as (select distinct * from table_cells)"
A = "b as (select distinct page_id, seq, box_id, text, y, h, confidence from text_boxes), an as (select page_id, y // 600 as diagram_id, seq, box_id, text as label, y - y // 600 * 600 as y, h, coalesce(confidence,0) > 30 as has_region, 600 as region_h from b)"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cells(spark, d):
    return table(spark, d, "table_cells").repartition("table_id").dropDuplicates(["table_id", "cell_id"])


def annotations(spark, d):
    b = table(spark, d, "text_boxes").repartition("page_id").dropDuplicates(["page_id", "box_id"])
    dia = F.expr("cast(y div 600 as int)")
    return b.select("page_id", dia.alias("diagram_id"), "seq", "box_id", F.col("text").alias("label"), (F.col("y") - dia * 600).alias("y"), "h", (F.coalesce("confidence", F.lit(0)) > 30).alias("has_region"), F.lit(600).alias("region_h"))


def chart_stats():
    return [
        F.max(F.when((F.col("row_idx") == 0) & (F.col("col_idx") == 0), F.col("translation"))).alias("mark"),
        F.count_if(F.col("row_idx") > 1).alias("n_values"),
        (F.count_if(F.col("row_idx") == 0) > 2).alias("has_spec"),
    ]


def charts(spark, d):
    """Tables as charts: the cell at the origin is the mark, its body the data; untitled ones have no spec."""
    g = cells(spark, d).groupBy("page_id", "table_id").agg(*chart_stats())
    return g.withColumnRenamed("table_id", "chart")


_CH = f"{C}, ch as (select page_id, table_id, max(case when row_idx=0 and col_idx=0 then translation end) as mark, count(*) filter (row_idx > 1) as n_values, count(*) filter (row_idx = 0) > 2 as has_spec from c group by 1,2)"


def _i(src, component, severity, kind, message, n="1"):
    return f"select page_id, '{component}' as component, '{severity}' as severity, '{kind}' as issue_type, '{message}' as message, cast({n} as bigint) as n from {src}"


_FILES = " union all ".join([
    _i(f"book_pages where status in ('COMPLETED','NEEDS_REVIEW') and {BL.format('original_image_path')}", "filesystem", "critical", "missing_input", "Input file missing"),
    _i(f"book_pages where status in ('COMPLETED','NEEDS_REVIEW') and {BL.format('output_pdf_path')}", "pdf_generation", "critical", "missing_output", "Output file missing"),
])
_DG = f"dg as (select page_id, diagram_id, count(seq) as labels, bool_or(has_region) as region, count(*) filter ({BL.format('label')}) as blanks from an group by 1,2)"
_DIAGRAMS = " union all ".join([
    _i("dg where labels < 2", "diagram_agent", "warning", "few_labels", "Diagram has few labels", "labels"),
    _i("dg where not region", "diagram_agent", "error", "no_region", "Diagram has no region"),
    _i("dg where blanks > 0", "diagram_agent", "warning", "blank_labels", "Diagram has blank labels", "blanks"),
])
_TG = f"tg as (select page_id, table_id, max(row_idx)+1 as rws, max(col_idx)+1 as cls, count(*) as k, count(*) filter ({BL.format('text')}) as emp, count(*) filter (not ({BL.format('text')}) and {BL.format('translation')}) as opn from c group by 1,2)"
_TABLES = " union all ".join([
    _i("tg where k < rws*cls", "table_agent", "error", "missing_cells", "Table lacks cells", "rws*cls-k"),
    _i("tg where emp/k > 0.3", "table_agent", "warning", "empty_cells", "Table has many empty cells", "emp"),
    _i("tg where opn > 0", "table_agent", "error", "untranslated", "Table has untranslated cells", "opn"),
])
_CHARTS = " union all ".join([
    _i("ch where not has_spec", "chart_agent", "error", "no_spec", "Chart has no spec"),
    _i("ch where has_spec and n_values = 0", "chart_agent", "error", "no_data", "Chart has no data"),
    _i(f"ch where has_spec and {BL.format('mark')}", "chart_agent", "warning", "no_mark", "Chart has no mark"),
])
_TR = f"tr as (select page_id, {LEN.format('ocr_text')} as a, {LEN.format('translated_text')} as b from book_pages where ocr_text <> '' and translated_text <> '')"
_TRANS = " union all ".join([
    _i("tr where b = 0", "translator", "critical", "empty_translation", "Translation is empty"),
    _i("tr where a > 0 and b > 0 and b/a < 0.5", "translator", "warning", "short_translation", "Translation is short"),
    _i("tr where a > 0 and b > 0 and b/a > 2.5", "translator", "warning", "long_translation", "Translation is long"),
])
_PROC = " union all ".join([
    _i("book_pages where status='FAILED'", "pdf_generation", "critical", "failed", "PDF creation failed"),
    _i("book_pages where status='COMPLETED' and page_id not in (select page_id from artifacts)", "processing", "warning", "no_artifacts", "Page has no artifacts"),
])
_ALL = f"{A}, {_DG}, {_CH}, {_TG}, {_TR}, iss as ({' union all '.join([_FILES, _DIAGRAMS, _TABLES, _CHARTS, _TRANS, _PROC])})"


@query(_FILES)
def quality_files(spark, d):
    return q.file_issues(table(spark, d, "book_pages"))


@query(f"with {A}, {_DG} {_DIAGRAMS}")
def quality_diagrams(spark, d):
    return q.diagram_issues(annotations(spark, d))


@query(f"with {C}, {_TG} {_TABLES}")
def quality_tables(spark, d):
    return q.table_issues(cells(spark, d))


@query(f"with {_CH} {_CHARTS}")
def quality_charts(spark, d):
    return q.chart_issues(charts(spark, d))


@query(f"with {_TR} {_TRANS}")
def quality_translation(spark, d):
    return q.translation_issues(table(spark, d, "book_pages"))


@query(_PROC)
def quality_processing(spark, d):
    return q.processing_issues(table(spark, d, "book_pages"), table(spark, d, "artifacts"))


def issues(spark, d):
    """All issues: one scan of the pages, one aggregate of the cells for tables and charts together, one of the annotations."""
    grids = cells(spark, d).groupBy("page_id", "table_id").agg(*q.table_stats(), *chart_stats())
    return q.union([q.page_issues(table(spark, d, "book_pages"), table(spark, d, "artifacts")), q.diagram_issues(annotations(spark, d)), q.emit(grids, [*q.table_rules(), *q.chart_rules()])])


_W = "sum(case severity when 'critical' then 25 when 'error' then 15 when 'warning' then 5 else 0 end)"
_LV = "case when score >= 90 then 'Excellent' when score >= 80 then 'Good' when score >= 70 then 'Acceptable' when score >= 50 then 'Poor' else 'Failed' end"
_SC = f"{_ALL}, l as (select page_id, {_W} as lost, count(*) filter (severity='critical') as critical, count(*) filter (severity='error') as error, count(*) filter (severity='warning') as warning, count(*) filter (severity='info') as info from iss group by 1), s as (select page_id, cast(greatest(0, least(100, 100-coalesce(lost,0))) as int) as score from book_pages left join l using (page_id))"


@query(f"with {_SC} select page_id, score, {_LV} as level, score >= 70 as passed from s")
def quality_score(spark, d):
    return q.scores(table(spark, d, "book_pages"), issues(spark, d))


@query(f"with {_SC} select page_id, critical, error, warning, info from l")
def issue_summary(spark, d):
    return q.summary(issues(spark, d))


_ADV = ", ".join([f"case when bool_or(severity='critical') then '{q.CRITICAL_ADVICE}' end", f"case when bool_or(component='diagram_agent' and severity in ('error','critical')) then '{q.ADVICE['diagram_agent']}' end", f"case when bool_or(component='table_agent' and issue_type='empty_cells') then '{q.ADVICE['table_agent']}' end", *[f"case when bool_or(component='{k}') then '{q.ADVICE[k]}' end" for k in ("chart_agent", "translator", "pdf_generation")]])


@query(f"with {_ALL} select page_id, concat_ws('; ', {_ADV}) as advice from iss group by 1")
def recommendations(spark, d):
    return q.recommendations(issues(spark, d))


@query("select page_id, quality_score, case when quality_score < 70 then 'NEEDS_REVIEW' else 'COMPLETED' end as status, coalesce(quality_level,'Unknown') as level from book_pages")
def review_gate(spark, d):
    return q.review_gate(table(spark, d, "book_pages"))


@query(f"with {_SC}, a as (select page_id, concat_ws('; ', {_ADV}) as advice from iss group by 1) select s.page_id, score, {_LV} as level, score >= 70 as passed, coalesce(critical,0) as critical, coalesce(error,0) as error, coalesce(warning,0) as warning, coalesce(info,0) as info, coalesce(advice,'') as advice from s left join l using (page_id) left join a using (page_id)")
def quality_report(spark, d):
    return q.report(table(spark, d, "book_pages"), issues(spark, d))


_T = "regexp_replace(text,'^\\s+|\\s+$','','g')"


@query(f"select distinct box_id, coalesce({_T} <> '' and not (length({_T}) = 1 and not regexp_matches({_T}, '[A-Za-z0-9]|[\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}]')), false) as keep from text_boxes")
def label_filter(spark, d):
    return table(spark, d, "text_boxes").select("box_id", q.keep_label(F.col("text")).alias("keep")).distinct()


@query(
    f"select distinct box_id, case when starts_with(lower({_T}),'de') or regexp_matches({_T},'^[0-9]{{2,}}$') or regexp_matches(replace({_T},'.',''),'^[0-9]+$') then 'code' when regexp_matches({_T},'^[\\d.,\\-~]+$') then 'number' when regexp_matches({_T},'^[a-zA-Z0-9/%]+$') then 'unit' else 'translate' end as label_class from text_boxes"
)
def label_classes(spark, d):
    return table(spark, d, "text_boxes").select("box_id", q.label_class(F.col("text")).alias("label_class")).distinct()


@query("select distinct box_id, coalesce(" + " or ".join(f"contains(lower(translation), '{p}')" for p in q.DIAGNOSTICS) + ", false) as diagnostic, lower(regexp_replace(translation,'[^A-Za-z0-9]','','g')) as cleaned from text_boxes")
def diagnostic_filter(spark, d):
    return table(spark, d, "text_boxes").select("box_id", q.diagnostic(F.col("translation")).alias("diagnostic"), q.clean_label(F.col("translation")).alias("cleaned")).distinct()


_KEY = "case when (y + h/2.0)/region_h > 0.75 or (not (lower(regexp_replace(label,'[^A-Za-z0-9]','','g')) in ('a','b','p','v','p1','p2','v1','v2','pa','pb','pc','va','vb','vc')) and not (length(label) <= 10 and len(list_filter(regexp_split_to_array(label,'\\s+'), lambda w: w <> '')) <= 2)) then 'key' else 'on_image' end"


@query(f"with {A}, k as (select page_id, label, min(seq) as seq, l as list from (select *, {_KEY} as l from an where label is not null) group by page_id, label, l) select page_id, list, string_agg(label,'|' order by seq, label) as labels from k group by 1,2")
def diagram_key(spark, d):
    return q.diagram_key(annotations(spark, d).filter("label is not null"))


_SIZES = "files as (select path, max(n) as n from (select original_image_path as path, page_id % 11 * 300 as n from book_pages where page_id % 13 <> 0 and original_image_path is not null union all select output_pdf_path, page_id % 7 * 400 from book_pages where page_id % 17 <> 0 and output_pdf_path is not null) group by 1)"
_DONE = "book_pages b left join files f on f.path = b.{0} where status in ('COMPLETED','NEEDS_REVIEW') and "


@query(
    f"with {_SIZES} "
    + " union all ".join([
        _i(_DONE.format("original_image_path") + "n is null", "filesystem", "critical", "missing_input", "Input file missing"),
        _i(_DONE.format("original_image_path") + "n = 0", "filesystem", "critical", "empty_input", "Input file empty"),
        _i(_DONE.format("output_pdf_path") + "n is null", "pdf_generation", "critical", "missing_output", "Output file missing"),
        _i(_DONE.format("output_pdf_path") + "n = 0", "pdf_generation", "critical", "empty_output", "Output file empty"),
        _i(_DONE.format("output_pdf_path") + "n > 0 and n < 1000", "pdf_generation", "error", "small_output", "Output file too small", "n"),
    ])
)
def quality_file_sizes(spark, d):
    """Files of finished pages that are missing, empty or too small; the tables hold no files, so sizes are laid by a formula."""
    p = table(spark, d, "book_pages")
    inputs = p.filter("page_id % 13 <> 0 and original_image_path is not null").select(F.col("original_image_path").alias("path"), (F.col("page_id") % 11 * 300).alias("length"))
    outputs = p.filter("page_id % 17 <> 0 and output_pdf_path is not null").select(F.col("output_pdf_path").alias("path"), (F.col("page_id") % 7 * 400).alias("length"))
    return q.file_issues(p, inputs.unionByName(outputs))


_RESULTS = "select page_id, case when status='NEEDS_REVIEW' then ['low confidence', coalesce(error_message, 'late')] when page_id % 5 = 0 then ['slow'] end as w, case when status='FAILED' then false when page_id % 2 = 0 then true end as ok, error_message as e, page_id % 3 = 0 as reg, case when page_id % 4 > 0 then page_id % 2 end as dia from book_pages"


@query(
    f"with r as ({_RESULTS}) select page_id, 'pipeline' as component, 'warning' as severity, 'warning' as issue_type, unnest(w) as message, cast(1 as bigint) as n from r "
    "union all select page_id, 'pdf_generation', 'critical', 'failed', 'PDF creation failed: '||coalesce(e,'Unknown error'), 1 from r where not ok "
    "union all select page_id, 'diagram_agent', 'warning', 'no_diagrams', 'Diagram regions detected but no diagram artifacts generated', 1 from r where reg and coalesce(dia,0) = 0"
)
def quality_pipeline(spark, d):
    """Issues of processing results, which are laid by a formula."""
    warnings = F.when(F.col("status") == "NEEDS_REVIEW", F.array(F.lit("low confidence"), F.coalesce("error_message", F.lit("late")))).when(F.col("page_id") % 5 == 0, F.array(F.lit("slow")))
    results = table(spark, d, "book_pages").select(
        "page_id", warnings.alias("warnings"), F.when(F.col("status") == "FAILED", False).when(F.col("page_id") % 2 == 0, True).alias("pdf_success"), F.col("error_message").alias("pdf_error"),
        (F.col("page_id") % 3 == 0).alias("has_regions"), F.when(F.col("page_id") % 4 > 0, F.col("page_id") % 2).alias("diagrams"),
    )
    return q.pipeline_issues(results)
