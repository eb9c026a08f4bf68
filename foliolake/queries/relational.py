"""Queries over projects and pages, with their SQL."""

from pyspark.sql import functions as F

from foliolake.operators import relational as r
from foliolake.session import table

NOW = "timestamp '2024-11-30 12:00:00'"
QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark, d):
    return table(spark, d, "book_pages")


def projects(spark, d):
    return table(spark, d, "projects")


@query("select page_id, project_id, page_number, status from book_pages where project_id in (select project_id from projects where user_id = 1)")
def page_lookup(spark, d):
    return r.owned_pages(pages(spark, d), projects(spark, d), 1).select("page_id", "project_id", "page_number", "status")


@query(
    "with s as (select * from book_pages where project_id = 1 and status in ('COMPLETED','NEEDS_REVIEW')) "
    "select page_id, page_number, status, (select count(*) from s) as total from s order by page_number, page_id limit 500 offset 5"
)
def page_listing(spark, d):
    return r.list_pages(pages(spark, d), 1, 5, 1000, " completed, needs_review ,bogus").select("page_id", "page_number", "status", "total")


@query("select project_id, title, created_at from projects where user_id = 1 order by created_at desc, project_id limit 100")
def project_listing(spark, d):
    return r.list_projects(projects(spark, d), 1).select("project_id", "title", "created_at")


@query(
    "select b.project_id, row_number() over (partition by b.project_id order by page_number, page_id) as position, output_pdf_path as path, replace(p.title,' ','_')||'_complete.pdf' as filename "
    "from book_pages b join projects p using (project_id) where b.status='COMPLETED' and output_pdf_path is not null"
)
def book_assembly(spark, d):
    return r.book_files(pages(spark, d), projects(spark, d))


@query(
    "with q as (select page_id from artifacts union all select page_id + 1000000000 from projects join book_pages using (project_id) where projects.status='FAILED') "
    "select distinct page_id, 'missing' as problem from q where page_id not in (select page_id from book_pages) union all select page_id, 'repeated' from q group by page_id having count(*) > 1"
)
def batch_validation(spark, d):
    failed = projects(spark, d).filter("status = 'FAILED'")
    asked = table(spark, d, "artifacts").select("page_id").unionByName(pages(spark, d).join(failed, "project_id", "left_semi").select((F.col("page_id") + 1000000000).alias("page_id")))
    return r.missing_requests(asked, pages(spark, d))


@query("select page_id, project_id, status as old_status, 'QUEUED' as status from book_pages where status in ('UPLOADED','FAILED')")
def queue_by_status(spark, d):
    return r.queue_by_status(pages(spark, d), ["UPLOADED", "FAILED"])


@query(
    "with n as (select page_id, max(stored_at) as m from artifacts group by 1) select b.page_id, coalesce(case when b.status='FAILED' then 'UPLOADED' end, b.status) as status, coalesce(n.m, b.updated_at) as updated_at from book_pages b left join n using (page_id)"
)
def patch_merge(spark, d):
    b = pages(spark, d).select("page_id", "status", "updated_at")
    newest = table(spark, d, "artifacts").groupBy("page_id").agg(F.max("stored_at").alias("updated_at"))
    patches = b.select("page_id", F.when(F.col("status") == "FAILED", "UPLOADED").alias("status")).join(newest, "page_id", "left")
    return r.patch(b, patches, "page_id", ["status", "updated_at"])


@query(
    "with g as (select project_id, count(*) as gone from book_pages where page_id in (select page_id from artifacts) and status in ('COMPLETED','NEEDS_REVIEW') group by 1) "
    "select project_id, cast(greatest(0, coalesce(completed_pages,0) - coalesce(gone,0)) as bigint) as completed_pages from projects left join g using (project_id)"
)
def replace_reset_counters(spark, d):
    return r.counters_after_reset(projects(spark, d), pages(spark, d), table(spark, d, "artifacts"))


@query(
    f"select page_id, project_id, page_number, 'UPLOADED' as status, cast(null as varchar) as ocr_text, cast(null as integer) as quality_score, {NOW} as replaced_at from book_pages where page_id in (select page_id from artifacts)"
)
def replace_reset(spark, d):
    out = r.reset_replaced(pages(spark, d), table(spark, d, "artifacts"), F.expr(NOW).cast("timestamp_ntz"))
    return out.select("page_id", "project_id", "page_number", "status", "ocr_text", "quality_score", "replaced_at")


@query("select page_id, project_id from book_pages where project_id not in (select project_id from projects where status='FAILED')")
def cascade_delete(spark, d):
    return r.without_projects(pages(spark, d), projects(spark, d).filter("status = 'FAILED'")).select("page_id", "project_id")


_AGE = f"(epoch_us({NOW}) - epoch_us(updated_at)) / 60e6"


@query(
    f"select page_id, k as kind, 'UPLOADED' as status, 'Stuck in '||upper(k)||' for '||printf('%.1f', round(age,1))||' min' as message from (select page_id, {_AGE} as age, case when status='PROCESSING' and {_AGE} > 30 then 'processing' when status='QUEUED' and {_AGE} > 10 then 'queued' end as k from book_pages) where k is not null"
)
def stuck_pages(spark, d):
    return r.stuck_pages(pages(spark, d), F.expr(NOW))


@query(f"select page_id, '[Archived] '||substring(error_message,1,100)||'...' as error_message from book_pages where status='FAILED' and updated_at < {NOW} - interval 7 day and error_message is not null")
def archive_errors(spark, d):
    return r.archive_errors(pages(spark, d), F.expr(NOW))


@query("select s as status, count(page_id) as n from (select unnest(['UPLOADED','QUEUED','PROCESSING','COMPLETED','FAILED','NEEDS_REVIEW']) as s) left join book_pages on status = s group by s")
def status_distribution(spark, d):
    return r.status_distribution(pages(spark, d))


@query(
    f"select count(*) filter (status='PROCESSING' and {_AGE} > 30) as stuck_processing, count(*) filter (status='QUEUED' and {_AGE} > 10) as stuck_queued, (select count(*) from projects) as projects, (select count(*) from projects where status in ('PROCESSING','ACTIVE')) as active from book_pages"
)
def system_report(spark, d):
    return r.system_report(pages(spark, d), projects(spark, d), F.expr(NOW))


@query("select project_id, count(*) as total, count(*) filter (status='COMPLETED') as completed from book_pages group by 1")
def project_progress(spark, d):
    return r.project_progress(pages(spark, d))


@query(
    "select project_id, count(*) as total, count(*) filter (status in ('COMPLETED','NEEDS_REVIEW')) as completed, count(*) - count(*) filter (status in ('COMPLETED','NEEDS_REVIEW')) as failed, round(count(*) filter (status in ('COMPLETED','NEEDS_REVIEW')) / count(*), 6) as done_share from book_pages group by 1"
)
def batch_stats(spark, d):
    return r.batch_stats(pages(spark, d))


@query("select page_id, project_id from book_pages where status='QUEUED' and project_id in (select project_id from projects)")
def requeue_candidates(spark, d):
    return r.requeue_candidates(pages(spark, d), projects(spark, d)).select("page_id", "project_id")


@query("select project_id, page_id, quality_score, row_number() over (partition by project_id order by quality_score asc nulls last, page_number, page_id) as rank, status='NEEDS_REVIEW' as review from book_pages")
def quality_ranking(spark, d):
    return r.quality_ranking(pages(spark, d))


@query("select page_id, coalesce(length(ocr_text),0) as ocr_chars, coalesce(length(translated_text),0) as translated_chars from book_pages")
def page_text_lengths(spark, d):
    return r.page_text_lengths(pages(spark, d))


@query("select project_id, page_number, count(*) as n, min(page_id) as first_page_id from book_pages group by 1,2 having count(*) > 1")
def upload_conflicts(spark, d):
    return r.upload_conflicts(pages(spark, d))


@query("select page_id, page_number, status from book_pages")
def page_status_scan(spark, d):
    """The ordered scan; the order is that of the rows as read back by page number."""
    return pages(spark, d).select("page_id", "page_number", "status").orderBy("page_number", "page_id")


_FIRST = "select project_id, arg_min(detected_language, struct_pack(a := coalesce(epoch_us(processed_at), 4611686018427387904), b := page_number, c := page_id)) as language from book_pages where detected_language is not null and detected_language <> '' group by 1"


@query(f"select p.project_id, f.language from projects p left join ({_FIRST}) f using (project_id) where source_language = 'auto'")
def project_language(spark, d):
    return r.detected_project_language(pages(spark, d), projects(spark, d))


@query(
    "with i as (select project_id, 'page_'||(page_number+1)||'.jpg' as name from book_pages) select distinct project_id, name from i where not exists (select 1 from book_pages b where b.project_id = i.project_id and regexp_extract(b.original_image_path,'([^/]*)$',1) = i.name)"
)
def new_uploads(spark, d):
    p = pages(spark, d)
    incoming = p.select("project_id", F.concat(F.lit("page_"), (F.col("page_number") + 1).cast("string"), F.lit(".jpg")).alias("name"))
    return r.new_uploads(incoming, p.select("project_id", F.col("original_image_path").alias("path"))).distinct()


@query(
    "with t as (select project_id, count(*) as total, max(page_number) // 2 as off from book_pages group by 1) select project_id, cast(off // 20 + 1 as bigint) as page, cast((total + 19) // 20 as bigint) as pages, cast(greatest(0, least(total - 20, off + 20)) as bigint) as next_offset, cast(greatest(0, (total - 1) // 20 * 20) as bigint) as last_offset from t"
)
def paging_math(spark, d):
    t = pages(spark, d).groupBy("project_id").agg(F.count("*").alias("total"), F.expr("max(page_number) div 2").alias("off"))
    return t.select("project_id", *r.paging(F.col("total"), F.col("off"), 20))


_NUMBERS = ", ".join(f"nullif(regexp_extract(lower(name),'{p}',1),'')" for p in (r"page\s*[-_]?\s*(\d{1,9})", r"p\s*[-_]?\s*(\d{1,9})", r"[_-](\d{1,9})\.[a-z0-9]+$", r"^(\d{1,9})\.[a-z0-9]+$"))


@query(
    "with recursive t as (select project_id, list(distinct page_number) as used from book_pages where status='COMPLETED' and page_number is not null group by 1), "
    "u as (select project_id, cast(row_number() over (partition by project_id order by page_id) as int) as seq, regexp_extract(original_image_path,'([^/]*)$',1) as name from book_pages where status <> 'COMPLETED'), "
    f"w as (select *, list_transform(list_filter([{_NUMBERS}], lambda x: x is not null), lambda x: cast(x as int)) as ns from u), "
    "f as (select w.project_id, w.seq, w.name, n as page_number, list_append(used, n) as used from (select w.*, coalesce(t.used, cast([] as int[])) as used from w left join t using (project_id) where w.seq = 1) w, lateral (select coalesce(list_filter(w.ns, lambda x: not list_contains(w.used, x))[1], coalesce(list_max(w.used), 0) + 1) as n) "
    "union all select w.project_id, w.seq, w.name, n, list_append(f.used, n) from f join w on w.project_id = f.project_id and w.seq = f.seq + 1, lateral (select coalesce(list_filter(w.ns, lambda x: not list_contains(f.used, x))[1], coalesce(list_max(f.used), 0) + 1) as n)) "
    "select project_id, seq, name, page_number from f"
)
def page_number_alloc(spark, d):
    p = pages(spark, d)
    seq = F.row_number().over(r.Window.partitionBy("project_id").orderBy("page_id")).cast("int")
    ups = p.filter("status <> 'COMPLETED'").select("project_id", seq.alias("seq"), F.regexp_extract("original_image_path", r"([^/]*)$", 1).alias("name"))
    return r.allocate_page_numbers(ups, p.filter("status = 'COMPLETED'").select("project_id", "page_number"))


@query(
    "with l as (select page_id, lower(status)||', bogus,'||status as raw from book_pages) select page_id, list_aggregate(list_sort(list_distinct(list_filter(list_transform(string_split(raw,','), lambda s: upper(trim(s))), lambda s: s in ('UPLOADED','QUEUED','PROCESSING','COMPLETED','FAILED','NEEDS_REVIEW')))),'string_agg','|') as statuses from l"
)
def status_filter_parse(spark, d):
    raw = F.concat(F.lower("status"), F.lit(", bogus,"), F.col("status"))
    return pages(spark, d).select("page_id", F.concat_ws("|", F.array_sort(r.parse_statuses(raw))).alias("statuses"))


@query()
def bulk_selection(spark, d):
    """Ids asked for in bulk: some twice, some no ids; the first of equal ones counts."""
    p = pages(spark, d).filter("status in ('COMPLETED', 'FAILED', 'NEEDS_REVIEW')")
    raw = F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 0, "x").when(F.col("page_id") % 4 == 1, " ").otherwise(""))
    twice = p.select("project_id", F.explode(F.array(F.struct(F.col("page_id"), F.lit(0).alias("k"), raw.alias("raw")), F.struct(F.col("page_id"), F.lit(1).alias("k"), raw.alias("raw")))).alias("s"))
    g = twice.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["raw"]).alias("raw"))
    return g.select("project_id", F.array_join(r.select_ids(F.col("raw")).cast("array<string>"), ",").alias("ids"))


SQL["bulk_selection"] = "select project_id, coalesce(string_agg(cast(page_id as varchar), ',' order by page_id) filter (page_id % 4 <> 0), '') as ids from book_pages where status in ('COMPLETED','FAILED','NEEDS_REVIEW') group by 1"


@query("select project_id, count(*) filter (status in ('COMPLETED','FAILED','NEEDS_REVIEW')) as selectable, count(a.page_id) as selected, case when count(a.page_id) >= count(*) filter (status in ('COMPLETED','FAILED','NEEDS_REVIEW')) and count(*) filter (status in ('COMPLETED','FAILED','NEEDS_REVIEW')) > 0 then 'deselect' else 'select' end as action from book_pages b left join (select distinct page_id from artifacts) a on a.page_id = b.page_id group by 1")
def selection_toggle(spark, d):
    return r.selection(pages(spark, d), table(spark, d, "artifacts"))


@query("select page_id, project_id, status from book_pages where page_id not in (select page_id from artifacts where page_id is not null)")
def page_delete(spark, d):
    return r.without_pages(pages(spark, d), projects(spark, d), table(spark, d, "artifacts").filter("page_id is not null"))[0].select("page_id", "project_id", "status")


@query("with g as (select project_id, count(*) as gone, count(*) filter (status='COMPLETED') as done from book_pages where page_id in (select page_id from artifacts) group by 1) select p.project_id, cast(greatest(0, coalesce(total_pages,0) - coalesce(gone,0)) as bigint) as total_pages, cast(greatest(0, coalesce(completed_pages,0) - coalesce(done,0)) as bigint) as completed_pages from projects p left join g on g.project_id = p.project_id")
def page_delete_counters(spark, d):
    return r.without_pages(pages(spark, d), projects(spark, d), table(spark, d, "artifacts"))[1]


_INCOMING = "i as (select project_id, page_number + page_id % 3 * 1000 as page_number, page_id as seq from book_pages)"


@query(f"with {_INCOMING} select project_id, page_number, seq, row_number() over (partition by project_id, page_number order by seq) = 1 and not exists (select 1 from book_pages b where b.project_id = i.project_id and b.page_number = i.page_number) as accepted from i")
def upload_check(spark, d):
    p = pages(spark, d)
    return r.accepted_uploads(p.select("project_id", (F.col("page_number") + F.col("page_id") % 3 * 1000).alias("page_number"), F.col("page_id").alias("seq")), p)


@query("with u as (select distinct 'user'||user_id||'@example.org' as email from projects where project_id % 2 = 0), i as (select 'user'||user_id||'@example.org' as email, project_id as seq from projects) select email, seq, row_number() over (partition by email order by seq) = 1 and email is not null and not exists (select 1 from u where u.email = i.email) as accepted from i")
def email_check(spark, d):
    mail = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("email")
    p = projects(spark, d)
    return r.unique_emails(p.select(mail, F.col("project_id").alias("seq")), p.filter("project_id % 2 = 0").select(mail))


_STATUS_TABLES = ("projects", "book_pages")


@query(
    "with t(type_name, table_name) as (values ('pagestatus', 'book_pages'), ('projectstatus', 'projects')), e as (select 'pagestatus' as type_name, unnest(['UPLOADED','QUEUED','PROCESSING','COMPLETED','FAILED','NEEDS_REVIEW']) as label) "
    "select t.type_name, e.label, t.table_name, 'status' as column_name from t join e using (type_name)"
)
def table_catalog(spark, d):
    """The catalog's status columns joined to the labels of their type: columns come from the session's catalog of the tables, registered as views."""
    for name in _STATUS_TABLES:
        table(spark, d, name).createOrReplaceTempView(name)
    columns = None
    for name in _STATUS_TABLES:
        one = spark.sql(f"describe {name}").select(F.lit(name).alias("table_name"), F.col("col_name").alias("column_name")).filter("column_name = 'status'")
        columns = one if columns is None else columns.unionByName(one)
    types = spark.createDataFrame([("pagestatus", "book_pages"), ("projectstatus", "projects")], "type_name string, table_name string")
    labels = spark.createDataFrame([("pagestatus", s) for s in r.PAGE_STATUSES], "type_name string, label string")
    return types.join(F.broadcast(labels), "type_name").join(columns, "table_name").select("type_name", "label", "table_name", "column_name")
