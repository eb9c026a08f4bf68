"""Queries of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.llm import alignment, encoding, languages, leakage, lookalike, naivebayes, noise, pairs, sentences, splitting
from foliolake.session import checkpointed, lookup, spread, table


def wide(spark, sf_dir, name, *columns):
    """A table for work in Python: only its columns, dealt out over the cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


RECORDS = {"text_box": ("text_boxes", "box_id"), "table_cell": ("table_cells", "cell_id")}


def records(spark, sf_dir, *columns):
    """Boxes and cells as one table: rec_kind, rec_id and the columns."""
    parts = [wide(spark, sf_dir, name, F.lit(kind).alias("rec_kind"), F.col(key).alias("rec_id"), *columns) for kind, (name, key) in RECORDS.items()]
    return parts[0].unionByName(parts[1])


def text_pairs(spark, sf_dir):
    """Boxes and cells with text, translation, the project's target and its source label; these are null where page or project are unknown. Equal pairs are dealt out together, as each is decided once."""
    projects = table(spark, sf_dir, "projects").select("project_id", F.col("target_language").alias("target"), F.col("source_language").alias("label"))
    to_project = lambda df, by: lookup(df, projects, "project_id", by)
    boxes, cells = table(spark, sf_dir, "text_boxes"), table(spark, sf_dir, "table_cells")
    some = lambda df, *columns: df.select(*columns, "text", "translation").filter("text is not null and translation is not null")
    page_target = to_project(table(spark, sf_dir, "book_pages").select("page_id", "project_id"), "page_id").select("page_id", "target", "label")
    b = to_project(some(boxes, "box_id", "project_id"), "box_id").select(F.lit("text_box").alias("rec_kind"), F.col("box_id").alias("rec_id"), "text", "translation", "target", "label")
    c = some(cells, "cell_id", "page_id").join(page_target, "page_id", "left").select(F.lit("table_cell").alias("rec_kind"), F.col("cell_id").alias("rec_id"), "text", "translation", "target", "label")
    most = max(2 * spark.sparkContext.defaultParallelism, *(df.rdd.getNumPartitions() for df in (boxes, cells)))
    return b.unionByName(c).repartition(most, "text", "translation")


def language_rows(spark, sf_dir):
    """The languages (a fixed table of code, code3 and name), in order of their codes."""
    rows = table(spark, sf_dir, "languages").select("code", "code3", "name").filter("code is not null").dropDuplicates(["code"]).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


def p1_found(spark, sf_dir):
    """Defective translations of boxes and cells."""
    languages = language_rows(spark, sf_dir)
    rows = text_pairs(spark, sf_dir)
    return pairs.broken_pairs(rows, pairs.fit_on(rows, [x[0] for x in languages], naivebayes.label_codes(languages)))


def scanned(spark, sf_dir):
    """Pages and distinct boxes with what tells furniture: title, page number, place."""
    pages = wide(spark, sf_dir, "book_pages", F.lit("page").alias("rec_kind"), F.col("page_id").alias("rec_id"), "project_id", F.col("ocr_text").alias("text"), F.col("page_number").alias("number"), F.lit(None).cast("int").alias("y"))
    boxes = wide(spark, sf_dir, "text_boxes", F.lit("text_box").alias("rec_kind"), F.col("box_id").alias("rec_id"), "project_id", "text", F.lit(None).cast("int").alias("number"), "y")
    both = pages.unionByName(boxes).filter("text is not null")
    return noise.with_titles(both, table(spark, sf_dir, "projects"), "rec_id")


def p3_found(spark, sf_dir):
    """Noisy lines of pages and boxes. Boxes delivered twice give the same few rows, made distinct at the end."""
    editor = noise.fit_on(table(spark, sf_dir, "book_pages"), table(spark, sf_dir, "projects"))
    return noise.find_noise(scanned(spark, sf_dir), editor).distinct()


def p3_repaired(spark, sf_dir):
    """Pages and boxes as continuous paragraphs."""
    editor = noise.fit_on(table(spark, sf_dir, "book_pages"), table(spark, sf_dir, "projects"))
    return noise.repaired(scanned(spark, sf_dir), editor).distinct()


def p4_found(spark, sf_dir):
    """Boxes, or cells, of a page that look the same but are stored differently."""
    return lookalike.same_look_pairs(records(spark, sf_dir, "page_id", "text"), ["rec_kind", "page_id"], "rec_id", "text").select("rec_kind", "id_a", "id_b")


def p4_classes(spark, sf_dir):
    """The same as classes with their members: one row for each box or cell that looks like another."""
    return lookalike.same_look_classes(records(spark, sf_dir, "page_id", "text"), ["rec_kind", "page_id"], "rec_id", "text").select("rec_kind", F.col("id").alias("rec_id"), "class_id", "text_id", "links")


def p4_forms(spark, sf_dir):
    """The consistent form of every text of boxes and cells."""
    return lookalike.consistent_form(records(spark, sf_dir, "text").distinct(), "text").select("rec_kind", "rec_id", "form")


def titled_pages(spark, sf_dir):
    """Pages with their book's title."""
    pages = wide(spark, sf_dir, "book_pages", "page_id", "project_id", "page_number", "ocr_text", "detected_language", "original_image_path")
    return noise.with_titles(pages, table(spark, sf_dir, "projects"), "page_id")


def p5_found(spark, sf_dir):
    """Source and target sentences of every page that render each other."""
    titles = table(spark, sf_dir, "projects").select("project_id", "title", F.col("target_language").alias("target"))
    pages = lookup(wide(spark, sf_dir, "book_pages", "page_id", "project_id", "page_number", "ocr_text", "translated_text"), titles, "project_id", "page_id")
    seen = checkpointed(alignment.units(pages, alignment.fit_on(pages)))
    return alignment.aligned(seen, alignment.fit_lexicon_on(seen))


def language_decisions(spark, sf_dir):
    """Decisions of every page, with the code table."""
    rows = language_rows(spark, sf_dir)
    codes, langs = naivebayes.label_codes(rows), [r[0] for r in rows]
    pages, projects = titled_pages(spark, sf_dir), table(spark, sf_dir, "projects")
    model = sentences.fit_on(pages)
    nb = languages.fit_on(pages, langs, codes)
    seen = checkpointed(languages.evidence(pages, model, nb, codes))
    return languages.decided(seen, languages.host_priors(seen, projects, langs), langs), projects, codes


def p6_labels(spark, sf_dir):
    """Missing or wrong labels and mixed stretches, with the confidence of the right language."""
    decisions, projects, codes = language_decisions(spark, sf_dir)
    return languages.mislabelled(checkpointed(decisions), projects, codes)


def p6_found(spark, sf_dir):
    """The same without the confidence."""
    return p6_labels(spark, sf_dir).drop("confidence").distinct()


def p7_found(spark, sf_dir):
    """Starts of the sentences, headings and list items of every page."""
    pages = titled_pages(spark, sf_dir)
    return sentences.unit_starts(pages, sentences.fit_on(pages)).select("page_id", "start_pos")


def p7_units(spark, sf_dir):
    """The units with their text."""
    pages = titled_pages(spark, sf_dir)
    return sentences.unit_starts(pages, sentences.fit_on(pages), with_text=True).select("page_id", "start_pos", "unit")


def p8_ids(spark, sf_dir):
    """Token ids of every document."""
    return encoding.token_ids(wide(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def eval_passages(spark, sf_dir):
    """The test items (a fixed, small table of held-out material, read in full; ``leaked`` takes any number of them)."""
    return [tuple(r) for r in table(spark, sf_dir, "eval_items").select("item_id", "lang", "passage").filter("passage is not null").toLocalIterator()]


def p9_found(spark, sf_dir):
    """Documents that hold a run of a test item's passage."""
    return leakage.leaked(wide(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", eval_passages(spark, sf_dir)).select("doc_id", "item_id").distinct()


def p9_runs(spark, sf_dir):
    """The same with place and length of the longest run."""
    return leakage.leaked(wide(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", eval_passages(spark, sf_dir))


def p10_pieces(spark, sf_dir):
    """Pieces of at most 512 tokens, sharing 64, of every document."""
    return splitting.split_oversized(wide(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p10_found(spark, sf_dir):
    """Documents that had to be split: those of more than one stretch."""
    return splitting.stretches(wide(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").filter(F.size("sizes") > 1).select(F.col("key").alias("doc_id"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_repaired": p3_repaired, "p4_found": p4_found, "p4_classes": p4_classes, "p4_forms": p4_forms, "p5_found": p5_found, "p6_found": p6_found, "p6_labels": p6_labels, "p7_found": p7_found, "p7_units": p7_units, "p8_ids": p8_ids, "p9_found": p9_found, "p9_runs": p9_runs, "p10_found": p10_found, "p10_pieces": p10_pieces}

_TEXTS = "t as (select distinct 'text_box' as rec_kind, page_id, box_id as rec_id, text from text_boxes union all select distinct 'table_cell', page_id, cell_id, text from table_cells)"
#: The forms are made by DuckDB in the query as well; what this checks is that they reach every row once, and the pairs.
SQL: dict[str, str] = {
    "p4_forms": f"with {_TEXTS} select distinct rec_kind, rec_id, {lookalike.form_sql('text')} as form from t",
    "p4_found": f"with {_TEXTS}, f as (select *, {lookalike.form_sql('text')} as form from t where text <> '') select distinct a.rec_kind, a.rec_id as id_a, b.rec_id as id_b from f a join f b on a.rec_kind = b.rec_kind and a.page_id = b.page_id and a.form = b.form and a.text <> b.text and a.rec_id < b.rec_id",
    "p4_classes": f"with {_TEXTS}, f as (select *, {lookalike.form_sql('text')} as form from t where text <> ''), k as (select rec_kind, page_id, form, min(rec_id) as class_id, count(*) as n from f group by 1,2,3 having count(distinct text) > 1), x as (select rec_kind, page_id, form, text, min(rec_id) as text_id, count(*) as m from f group by 1,2,3,4) select f.rec_kind, f.rec_id, class_id, text_id, cast(n - m as bigint) as links from f join k using (rec_kind, page_id, form) join x using (rec_kind, page_id, form, text)",
}
