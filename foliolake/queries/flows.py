"""Queries of sources, status events and pipelines, with their SQL."""

import uuid

from pyspark.sql import functions as F

from foliolake.plans import book
from foliolake.queries import quality, relational
from foliolake.session import shared_folder, table
from foliolake.sources import files
from foliolake.streaming import status

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def run_folder(spark):
    """A folder of its own for one run of a stream, shared by the executors."""
    return f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"


@query("select user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) as status, max(ts) as since, count(*) as n from events group by 1")
def latest_status(spark, d):
    return status.latest_status(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("select old, new, count(*) as n from (select lag(event_type) over (partition by user_id order by ts, event_id) as old, event_type as new from events) where old is not null group by 1,2")
def status_transitions(spark, d):
    return status.transitions(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


_STATE = "case event_id % 5 when 0 then 'PENDING' when 1 then 'PROGRESS' when 2 then 'SUCCESS' when 3 then 'FAILURE' else 'REVOKED' end"


@query(f"select event_id, case {_STATE} when 'PENDING' then 'pending' when 'PROGRESS' then 'processing' when 'SUCCESS' then 'completed' when 'FAILURE' then 'failed' else 'revoked' end as status from events")
def task_state_map(spark, d):
    return status.task_states(table(spark, d, "events").withColumn("state", F.expr(_STATE))).select("event_id", "status")


@query("select artifact_id, a.storage_key = 'projects/'||b.project_id||'/outputs/page_'||b.page_number||'_artifacts.json' as same from artifacts a join book_pages b using (page_id)")
def artifact_keys(spark, d):
    p = table(spark, d, "book_pages").select("page_id", "project_id", "page_number")
    return table(spark, d, "artifacts").select("artifact_id", "page_id", "storage_key").join(p, "page_id").select("artifact_id", (F.col("storage_key") == files.artifact_key()).alias("same"))


@query("select artifact_id, storage_key from artifacts where starts_with(storage_key, 'projects/1/')")
def prefix_objects(spark, d):
    return files.under_prefix(table(spark, d, "artifacts").select("artifact_id", "storage_key"), 1)


_LINE = "'5'||chr(9)||'1'||chr(9)||'1'||chr(9)||'1'||chr(9)||'1'||chr(9)||seq||chr(9)||x||chr(9)||y||chr(9)||w||chr(9)||h||chr(9)||coalesce(cast(confidence as varchar),'-1')||chr(9)||replace(coalesce(text,''),chr(10),' ')"


@query("select distinct box_id, x, y, w, h, cast(confidence as double) as confidence, replace(text,chr(10),' ') as text from text_boxes where confidence >= 60 and trim(replace(text,chr(10),' ')) <> ''")
def word_table_parse(spark, d):
    b = table(spark, d, "text_boxes").distinct()
    s = lambda c: F.col(c).cast("string")
    line = F.concat_ws("\t", *[F.lit("1")] * 5, s("seq"), s("x"), s("y"), s("w"), s("h"), F.coalesce(s("confidence"), F.lit("-1")), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    return files.parse_word_lines(b.select("box_id", line.alias("value")), least=60)


_ROLE = "case when page_number = 1 then 'cover' when status='FAILED' then 'note' when page_number % 7 = 0 then 'back' else 'page' end"


@query(f"with p as (select project_id, page_id as seq, {_ROLE} as role from book_pages) select project_id, role, seq, row_number() over (partition by project_id order by case role when 'cover' then 0 when 'page' then 1 else 2 end, seq) as position from p where role <> 'note'")
def book_page_order(spark, d):
    p = table(spark, d, "book_pages").select("project_id", F.expr(_ROLE).alias("role"), F.col("page_id").alias("seq"))
    return files.book_order(p).select("project_id", "role", "seq", "position")


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1,2")
def event_windows(spark, d):
    """Batch form of the windowed stream."""
    return status.windowed_counts(table(spark, d, "events"))


@query("with s as (select user_id as key, ts, event_id, coalesce(event_type,'') as s, lag(coalesce(event_type,'')) over (partition by user_id order by ts, event_id) as old from events) select key, count(*) filter (old is null or old <> s) as changes, arg_max(s, struct_pack(a := ts, b := event_id)) as status from s group by 1")
def running_status_stream(spark, d):
    """Stateful stream over all events, drained once."""
    return status.rolled_up(status.run_once(status.running_state(status.event_stream(spark, d)), run_folder(spark)))


@query(relational.SQL["stuck_pages"])
def recovered_pages(spark, d):
    """Stuck pages found by the recovery stream."""
    return status.recover(status.page_stream(spark, d), F.expr(relational.NOW), run_folder(spark))


@query("select page_id, cast(count(distinct table_id) as int) as tables, cast(count(*) as int) as cells from (select distinct page_id, table_id, cell_id from table_cells) group by 1")
def artifact_round_trip(spark, d):
    """Artifact documents written as JSON by project and read back by their schema."""
    cells = table(spark, d, "table_cells").repartition("page_id").dropDuplicates(["table_id", "cell_id"])
    cell = F.struct(F.col("row_idx").alias("row"), F.col("col_idx").alias("col"), "text", "translation", "row_span", "col_span")
    tables_ = cells.groupBy("page_id", "table_id").agg(F.collect_list(cell).alias("cells"))
    docs = tables_.groupBy("page_id").agg(F.collect_list(F.struct(F.col("table_id").cast("string").alias("id"), "cells")).alias("tables"))
    docs = docs.join(table(spark, d, "book_pages").select("page_id", "project_id"), "page_id", "left")
    folder = f"{run_folder(spark)}/artifacts"
    files.write_artifacts(docs, folder)
    return files.read_artifacts(spark, folder).select("page_id", F.size("tables").alias("tables"), F.aggregate("tables", F.lit(0), lambda acc, t: acc + F.size(t["cells"])).alias("cells"))


@query()
def page_paragraphs(spark, d):
    """Pipeline: boxes to translated paragraphs (rows only)."""
    return book.page_texts(spark, d)


@query()
def table_exports(spark, d):
    """Pipeline: CSV and HTML of every table (each has its own SQL check)."""
    return book.table_exports(spark, d)


@query()
def reviewed_pages(spark, d):
    """Pipeline: the status each page's issues ask for."""
    return book.reviewed(spark, d, quality.issues(spark, d))
