"""Lookups, listings, paging, updates and reports over projects and pages.

All of these are declarative filters, semi/anti joins and conditional aggregates; statuses, limits
and the present moment are parameters. Nulls follow three-valued logic unless a docstring says more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def rank_within(df: DataFrame, group: str, bucket: Column, order: list[Column], name: str = "position") -> DataFrame:
    """Position of each row in its group, without one task for a hot group.

    ``bucket`` must not fall as ``order`` rises. Rows are numbered within (group, bucket); the
    buckets before are counted by a grouped aggregate and added, so a group that holds a third of
    all rows is spread over its buckets. Null groups are one group.
    """
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = b.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)))
    joined = numbered.join(offsets, numbered[group].eqNullSafe(offsets["_g"]) & numbered["_bucket"].eqNullSafe(offsets["_b"]))
    return joined.withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_rank", "_g", "_b", "_before")


#: Page and project statuses (fixed values).
PAGE_STATUSES = ("UPLOADED", "QUEUED", "PROCESSING", "COMPLETED", "FAILED", "NEEDS_REVIEW")
MAX_PAGE_SIZE = 500


def owned_pages(pages: DataFrame, projects: DataFrame, user_id: int) -> DataFrame:
    """Pages of the projects of one user (a semi join; duplicates on the right add nothing)."""
    return pages.join(projects.filter(F.col("user_id") == user_id), "project_id", "left_semi")


def parse_statuses(text: Column, valid: tuple[str, ...] = PAGE_STATUSES) -> Column:
    """Comma-separated statuses as an array: trimmed, upper case, unknown ones dropped. Null gives null."""
    parts = F.transform(F.split(text, ","), lambda s: F.upper(F.trim(s)))
    return F.array_intersect(parts, F.array(*[F.lit(v) for v in valid]))


def list_pages(pages: DataFrame, project_id: int, skip: int = 0, limit: int = 20, statuses: str | None = None) -> DataFrame:
    """One page of a project's pages by number, with the count before paging. No valid status: no filter.

    The total comes from its own aggregate, so the sorted part stays a top-k.
    """
    some = pages.filter(F.col("project_id") == project_id)
    if statuses is not None:
        wanted = [s for s in dict.fromkeys(x.strip().upper() for x in statuses.split(",")) if s in PAGE_STATUSES]
        if wanted:
            some = some.filter(F.col("status").isin(wanted))
    total = some.agg(F.count("*").alias("total"))
    top = some.orderBy("page_number", "page_id").offset(skip).limit(min(limit, MAX_PAGE_SIZE))
    return top.select("*", total.scalar().alias("total"))


def list_projects(projects: DataFrame, user_id: int, skip: int = 0, limit: int = 100) -> DataFrame:
    """A user's projects, newest first."""
    return projects.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "project_id").offset(skip).limit(limit)


def book_files(pages: DataFrame, projects: DataFrame) -> DataFrame:
    """The finished pages of each book in page order: project_id, position, path, and the book's file name."""
    done = pages.filter("status = 'COMPLETED' and output_pdf_path is not null").select("project_id", "page_number", "page_id", F.col("output_pdf_path").alias("path"))
    parts = rank_within(done, "project_id", F.floor(F.col("page_number") / 500), [F.col("page_number"), F.col("page_id")])
    return parts.join(projects.select("project_id", book_filename(F.col("title")).alias("filename")), "project_id").select("project_id", "position", "path", "filename")


def book_filename(title: Column) -> Column:
    return F.concat(F.replace(title, F.lit(" "), F.lit("_")), F.lit("_complete.pdf"))


def missing_requests(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """Requested page ids that don't exist, and those asked for more than once."""
    lost = requested.join(pages, "page_id", "left_anti").select("page_id", F.lit("missing").alias("problem")).distinct()
    twice = requested.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").select("page_id", F.lit("repeated").alias("problem"))
    return lost.unionByName(twice)


def queue_by_status(pages: DataFrame, statuses: list[str]) -> DataFrame:
    """Pages of the given statuses as they are after queueing."""
    return pages.filter(F.col("status").isin(statuses)).select("page_id", "project_id", F.col("status").alias("old_status"), F.lit("QUEUED").alias("status"))


def patch(target: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sparse update: the patch's non-null fields win. One patch for each key is expected."""
    p = patches.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return target.join(p, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


RESULT_FIELDS = ("output_pdf_path", "ocr_text", "translated_text", "error_message", "quality_score", "quality_level", "detected_language", "language_confidence", "processed_at")


def reset_replaced(pages: DataFrame, replaced: DataFrame, now: Column) -> DataFrame:
    """Pages with a new image: result fields null, status UPLOADED, replaced_at set."""
    hit = pages.join(replaced.select("page_id").distinct(), "page_id", "left_semi")
    fields = [F.lit(None).cast(hit.schema[c].dataType).alias(c) if c in RESULT_FIELDS else F.lit("UPLOADED").alias(c) if c == "status" else F.col(c) for c in hit.columns]
    return hit.select(*fields, now.alias("replaced_at"))


def counters_after_reset(projects: DataFrame, pages: DataFrame, replaced: DataFrame) -> DataFrame:
    """completed_pages of each project less its replaced finished pages, never below 0."""
    gone = pages.join(replaced, "page_id", "left_semi").filter("status in ('COMPLETED', 'NEEDS_REVIEW')").groupBy("project_id").agg(F.count("*").alias("gone"))
    return projects.join(gone, "project_id", "left").select("project_id", F.greatest(F.lit(0), F.coalesce("completed_pages", F.lit(0)) - F.coalesce("gone", F.lit(0))).cast("long").alias("completed_pages"))


def without_pages(pages: DataFrame, projects: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages without the ``deleted`` ones (page_id), and the counters of all projects less what was deleted: project_id, total_pages, completed_pages. A null counter counts as 0; none falls below 0."""
    ids = deleted.select("page_id").distinct()
    gone = pages.join(ids, "page_id", "left_semi").groupBy("project_id").agg(F.count("*").alias("gone"), F.count_if(F.col("status") == "COMPLETED").alias("done"))
    less = lambda c, by: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)) - F.coalesce(by, F.lit(0))).cast("long").alias(c)
    counters = projects.join(gone, "project_id", "left").select("project_id", less("total_pages", "gone"), less("completed_pages", "done"))
    return pages.join(ids, "page_id", "left_anti"), counters


def accepted_uploads(incoming: DataFrame, pages: DataFrame) -> DataFrame:
    """Incoming pages (project_id, page_number, seq) with whether they are accepted: the number must be new to the project; of several for one number the first is accepted."""
    taken = pages.select("project_id", "page_number", F.lit(True).alias("taken")).distinct()
    first = F.row_number().over(Window.partitionBy("project_id", "page_number").orderBy("seq")) == 1
    return incoming.withColumn("first", first).join(taken, ["project_id", "page_number"], "left").select("project_id", "page_number", "seq", (F.col("first") & F.col("taken").isNull()).alias("accepted"))


def unique_emails(incoming: DataFrame, users: DataFrame) -> DataFrame:
    """Registrations (email, seq) with whether they are accepted: the address must not be in ``users`` (email), and of equal ones the first is accepted. Null addresses are refused; case counts."""
    known = users.select("email", F.lit(True).alias("known")).distinct()
    first = F.row_number().over(Window.partitionBy("email").orderBy("seq")) == 1
    return incoming.withColumn("first", first).join(known, "email", "left").select("email", "seq", (F.col("first") & F.col("known").isNull() & F.col("email").isNotNull()).alias("accepted"))


def selection(pages: DataFrame, selected: DataFrame, statuses: tuple[str, ...] = ("COMPLETED", "FAILED", "NEEDS_REVIEW")) -> DataFrame:
    """For each project: selectable pages, how many pages are selected, and what the toggle does next."""
    s = selected.select("page_id", F.lit(1).alias("on")).distinct()
    g = pages.select("page_id", "project_id", "status").join(s, "page_id", "left").groupBy("project_id").agg(F.count_if(F.col("status").isin(*statuses)).alias("selectable"), F.count("on").alias("selected"))
    return g.select("project_id", "selectable", "selected", F.when((F.col("selected") >= F.col("selectable")) & (F.col("selectable") > 0), "deselect").otherwise("select").alias("action"))


def without_projects(pages: DataFrame, deleted: DataFrame) -> DataFrame:
    """Cascade of a deletion of projects to their pages."""
    return pages.join(deleted, "project_id", "left_anti")


def stuck_pages(pages: DataFrame, now: Column, processing_minutes: int = 30, queued_minutes: int = 10) -> DataFrame:
    """Pages too long in work or in the queue, with age in minutes to one decimal. A null updated_at never matches."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 60e6
    late = F.when((F.col("status") == "PROCESSING") & (age > processing_minutes), "processing").when((F.col("status") == "QUEUED") & (age > queued_minutes), "queued")
    message = F.concat(F.lit("Stuck in "), F.upper(late), F.lit(" for "), F.format_string("%.1f", F.round(age, 1)), F.lit(" min"))
    return pages.withColumn("kind", late).filter("kind is not null").select("page_id", "kind", F.lit("UPLOADED").alias("status"), message.alias("message"))


def archive_errors(pages: DataFrame, now: Column, days: int = 7, keep: int = 100) -> DataFrame:
    """Old errors of failed pages, shortened and marked."""
    old = (F.col("status") == "FAILED") & (F.unix_micros(F.col("updated_at").cast("timestamp")) < F.unix_micros(now) - days * 86_400_000_000) & F.col("error_message").isNotNull()
    return pages.filter(old).select("page_id", F.concat(F.lit("[Archived] "), F.substring("error_message", 1, keep), F.lit("...")).alias("error_message"))


def status_distribution(pages: DataFrame, statuses: tuple[str, ...] = PAGE_STATUSES) -> DataFrame:
    """Count of each status, zero where there is none."""
    spark = pages.sparkSession
    dim = spark.createDataFrame([(s,) for s in statuses], "status string")
    return F.broadcast(dim).join(pages.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def system_report(pages: DataFrame, projects: DataFrame, now: Column) -> DataFrame:
    """Stuck pages and active projects in one row; each table is read once."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 60e6
    p = pages.agg(F.count_if((F.col("status") == "PROCESSING") & (age > 30)).alias("stuck_processing"), F.count_if((F.col("status") == "QUEUED") & (age > 10)).alias("stuck_queued"))
    j = projects.agg(F.count("*").alias("projects"), F.count_if(F.col("status").isin("PROCESSING", "ACTIVE")).alias("active"))
    one = j.select(F.struct("projects", "active").alias("j")).scalar()
    return p.select("*", one["projects"].alias("projects"), one["active"].alias("active"))


def project_progress(pages: DataFrame) -> DataFrame:
    """Pages and completed pages of each project, exactly."""
    return pages.groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))


def batch_stats(pages: DataFrame) -> DataFrame:
    """Total, completed and failed (all others) of each project's pages, and the share done."""
    done = F.count_if(F.col("status").isin("COMPLETED", "NEEDS_REVIEW"))
    return pages.groupBy("project_id").agg(F.count("*").alias("total"), done.alias("completed"), (F.count("*") - done).alias("failed"), F.round(done / F.count("*"), 6).alias("done_share"))


def requeue_candidates(pages: DataFrame, projects: DataFrame) -> DataFrame:
    """Queued pages whose project exists."""
    return pages.filter("status = 'QUEUED'").join(projects, "project_id", "left_semi")


def quality_ranking(pages: DataFrame) -> DataFrame:
    """Rank of each page in its project by quality score, worst first, unscored last."""
    some = pages.select("project_id", "page_id", "page_number", "quality_score", (F.col("status") == "NEEDS_REVIEW").alias("review"))
    bucket = F.coalesce("quality_score", F.lit(1_000_000)).cast("long") * 100_000 + F.least(F.floor(F.greatest("page_number", F.lit(0)) / 500), F.lit(99_999))
    ranked = rank_within(some, "project_id", bucket, [F.col("page_number"), F.col("page_id")], "rank")
    return ranked.select("project_id", "page_id", "quality_score", "rank", "review")


def page_text_lengths(pages: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    return pages.select("page_id", n("ocr_text").alias("ocr_chars"), n("translated_text").alias("translated_chars"))


def upload_conflicts(pages: DataFrame) -> DataFrame:
    """Page numbers a project holds more than once, with the first page that took them."""
    return pages.groupBy("project_id", "page_number").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page_id")).filter("n > 1")


def new_uploads(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming files (project_id, name) of which the project has none of this name (equal, or at the end of a path)."""
    base = stored.select("project_id", F.regexp_extract("path", r"([^/]*)$", 1).alias("name")).distinct()
    return incoming.join(base, ["project_id", "name"], "left_anti")


def detected_project_language(pages: DataFrame, projects: DataFrame) -> DataFrame:
    """The first detection of each project that asks for it (source label auto): earliest processed page wins."""
    seen = pages.filter("detected_language is not null and detected_language <> ''")
    first = seen.groupBy("project_id").agg(F.min_by("detected_language", F.struct(F.coalesce(F.unix_micros(F.col("processed_at").cast("timestamp")), F.lit(2**62)), "page_number", "page_id")).alias("language"))
    return projects.filter("source_language = 'auto'").join(first, "project_id", "left").select("project_id", "language")


def paging(total: Column, offset: Column, size: int) -> list[Column]:
    """Page number, number of pages, next and last offset (0 where there is nothing)."""
    last = F.greatest(F.lit(0), F.floor((total - 1) / size) * size)
    return [
        (F.floor(offset / size) + 1).cast("long").alias("page"),
        F.ceil(total / size).cast("long").alias("pages"),
        F.greatest(F.lit(0), F.least(total - size, offset + size)).cast("long").alias("next_offset"),
        last.cast("long").alias("last_offset"),
    ]


def allocate_page_numbers(uploads: DataFrame, taken: DataFrame) -> DataFrame:
    """Page numbers for uploads (project_id, seq, name), given the numbers ``taken`` (project_id, page_number): the first number in the name that is free, else the largest plus one.

    Each choice depends on those before, so a project's uploads go in order through one task; they
    are streamed through it in batches from a sort that spills, and what is held is the numbers
    given, never the uploads.
    """
    ns = F.filter(
        F.array(
            *[
                F.try_to_number(F.nullif(F.regexp_extract(F.lower("name"), p, 1), F.lit("")), F.lit("999999999")).cast("int")
                for p in (r"page\s*[-_]?\s*(\d{1,9})", r"p\s*[-_]?\s*(\d{1,9})", r"[_-](\d{1,9})\.[a-z0-9]+$", r"^(\d{1,9})\.[a-z0-9]+$")
            ]
        ),
        lambda x: x.isNotNull(),
    )
    asked = uploads.select("project_id", "seq", "name", ns.alias("ns"))
    schema = "project_id long, seq int, name string, page_number int"
    rows = asked.withColumn("kind", F.lit(1)).unionByName(taken.filter("page_number is not null").select("project_id", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("name"), F.array("page_number").alias("ns"), F.lit(0).alias("kind")).distinct())
    ordered = rows.repartition("project_id").sortWithinPartitions("project_id", "kind", "seq", "name")

    def fold(batches):
        import pyarrow as pa

        project, used, top = object(), set(), 0
        for batch in batches:
            out = []
            for p, seq, name, wanted, kind in zip(*(batch.column(c).to_pylist() for c in ("project_id", "seq", "name", "ns", "kind")), strict=True):
                if p != project:
                    project, used, top = p, set(), 0
                number = wanted[0] if not kind else next((n for n in wanted if n not in used), top + 1)
                used.add(number)
                top = max(top, number)
                if kind:
                    out.append((p, seq, name, number))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int32()))], names=["project_id", "seq", "name", "page_number"])

    return ordered.mapInArrow(fold, schema)


def select_ids(ids: Column) -> Column:
    """Raw ids as integers, those that are none dropped, the first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: x.try_cast("long")), lambda x: x.isNotNull()))
