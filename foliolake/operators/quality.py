"""Quality of processed pages: rules that give issues, and the score, level and advice made of them.

Every rule is a projection or a conditional aggregate that yields rows (page_id, component,
severity, issue_type, message, n); a report is their union, aggregated by page in one shuffle.
Null texts count as empty. Weights and levels are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an issue of each severity takes off the score.
WEIGHTS = {"critical": 25, "error": 15, "warning": 5, "info": 0}
# Least score of each level.
LEVELS = ((90, "Excellent"), (80, "Good"), (70, "Acceptable"), (50, "Poor"))
PASS_SCORE = 70
ISSUE = ("page_id", "component", "severity", "issue_type", "message", "n")


def blank(c: str) -> Column:
    return F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("")) == ""


Rule = tuple  # (condition, component, severity, issue_type, message[, number])


def emit(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each rule that a row of ``df`` meets; ``df`` is read once whatever the number of rules."""
    found = [
        F.when(
            cond,
            F.struct(F.lit(component).alias("component"), F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"), F.lit(message).alias("message"), (n[0] if n else F.lit(1)).cast("long").alias("n")),
        )
        for cond, component, severity, kind, message, *n in rules
    ]
    return df.select("page_id", F.explode(F.array_compact(F.array(*found))).alias("i")).select("page_id", "i.*")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def file_rules() -> list[Rule]:
    """Missing input or output of finished pages."""
    done = F.col("status").isin("COMPLETED", "NEEDS_REVIEW")
    return [
        (done & blank("original_image_path"), "filesystem", "critical", "missing_input", "Input file missing"),
        (done & blank("output_pdf_path"), "pdf_generation", "critical", "missing_output", "Output file missing"),
    ]


#: Bytes under which an output is suspiciously small (fixed value).
SMALL_OUTPUT = 1000


def file_issues(pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Missing, empty and too small files of finished pages.

    ``files`` (path, length) is what a listing or a ``binaryFile`` source gives; a path that is not
    among them is missing. Without it only blank paths are told. Files of one path count once, the largest.
    """
    if files is None:
        return emit(pages, file_rules())
    sizes = files.groupBy("path").agg(F.max("length").alias("length"))
    done = pages.filter("status in ('COMPLETED', 'NEEDS_REVIEW')").select("page_id", F.explode(F.array(F.struct(F.lit(True).alias("input"), F.col("original_image_path").alias("path")), F.struct(F.lit(False).alias("input"), F.col("output_pdf_path").alias("path")))).alias("f"))
    known = done.select("page_id", "f.input", "f.path").join(sizes, "path", "left")
    n = F.col("length")
    return emit(known, [
        (F.col("input") & n.isNull(), "filesystem", "critical", "missing_input", "Input file missing"),
        (F.col("input") & (n == 0), "filesystem", "critical", "empty_input", "Input file empty"),
        (~F.col("input") & n.isNull(), "pdf_generation", "critical", "missing_output", "Output file missing"),
        (~F.col("input") & (n == 0), "pdf_generation", "critical", "empty_output", "Output file empty"),
        (~F.col("input") & (n > 0) & (n < SMALL_OUTPUT), "pdf_generation", "error", "small_output", "Output file too small", n),
    ])


def diagram_issues(annotations: DataFrame) -> DataFrame:
    """Diagrams (page_id, diagram_id, label or null, has_region): few labels, no region, blank labels."""
    g = annotations.groupBy("page_id", "diagram_id").agg(F.count("seq").alias("labels"), F.bool_or("has_region").alias("region"), F.count_if(F.col("seq").isNotNull() & blank("label")).alias("blanks"))
    return emit(g, [
        (F.col("labels") < 2, "diagram_agent", "warning", "few_labels", "Diagram has few labels", F.col("labels")),
        (~F.col("region"), "diagram_agent", "error", "no_region", "Diagram has no region"),
        (F.col("blanks") > 0, "diagram_agent", "warning", "blank_labels", "Diagram has blank labels", F.col("blanks")),
    ])


def table_stats() -> list[Column]:
    """Aggregates of a table's cells that the table rules read."""
    return [(F.max("row_idx").cast("long") + 1).alias("rows"), (F.max("col_idx").cast("long") + 1).alias("cols"), F.count("*").alias("k"), F.count_if(blank("text")).alias("empty"), F.count_if(~blank("text") & blank("translation")).alias("open")]


def table_rules() -> list[Rule]:
    sized, places = (F.col("rows") > 0) & (F.col("cols") > 0), F.col("rows") * F.col("cols")
    return [
        (~sized, "table_agent", "error", "no_size", "Table has no size"),
        (sized & (F.col("k") < places), "table_agent", "error", "missing_cells", "Table lacks cells", places - F.col("k")),
        (sized & (F.col("empty") / F.col("k") > 0.3), "table_agent", "warning", "empty_cells", "Table has many empty cells", F.col("empty")),
        (sized & (F.col("open") > 0), "table_agent", "error", "untranslated", "Table has untranslated cells", F.col("open")),
    ]


def table_issues(cells: DataFrame) -> DataFrame:
    """Tables: missing cells, many empty cells (of those present), untranslated cells. A table of no size is an error and nothing else."""
    return emit(cells.groupBy("page_id", "table_id").agg(*table_stats()), table_rules())


def chart_rules() -> list[Rule]:
    spec = F.col("has_spec")
    return [
        (~spec, "chart_agent", "error", "no_spec", "Chart has no spec"),
        (spec & (F.col("n_values") == 0), "chart_agent", "error", "no_data", "Chart has no data"),
        (spec & blank("mark"), "chart_agent", "warning", "no_mark", "Chart has no mark"),
    ]


def chart_issues(charts: DataFrame) -> DataFrame:
    """Charts (page_id, chart, has_spec, n_values, mark): no spec ends it; no data, no mark."""
    return emit(charts, chart_rules())


def _lengths(pages: DataFrame) -> DataFrame:
    """``pages`` with a and b, the lengths of text and translation without outer white space; null unless both are there."""
    both = F.coalesce((F.col("ocr_text") != "") & (F.col("translated_text") != ""), F.lit(False))
    n = lambda c: F.when(both, F.length(F.regexp_replace(c, r"^\s+|\s+$", "")))
    return pages.withColumn("a", n("ocr_text")).withColumn("b", n("translated_text"))


def translation_rules() -> list[Rule]:
    rated, ratio = (F.col("a") > 0) & (F.col("b") > 0), F.col("b") / F.nullif("a", F.lit(0))
    return [
        (F.col("b") == 0, "translator", "critical", "empty_translation", "Translation is empty"),
        (rated & (ratio < 0.5), "translator", "warning", "short_translation", "Translation is short"),
        (rated & (ratio > 2.5), "translator", "warning", "long_translation", "Translation is long"),
    ]


def translation_issues(pages: DataFrame) -> DataFrame:
    """Only where both texts are there: an empty translation, or one much shorter or longer than the text."""
    return emit(_lengths(pages), translation_rules())


def processing_rules() -> list[Rule]:
    return [
        (F.col("status") == "FAILED", "pdf_generation", "critical", "failed", "PDF creation failed"),
        ((F.col("status") == "COMPLETED") & F.col("have").isNull(), "processing", "warning", "no_artifacts", "Page has no artifacts"),
    ]


def processing_issues(pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Failed pages, and finished pages without artifacts."""
    have = artifacts.select("page_id").distinct().withColumn("have", F.lit(True))
    return emit(pages.select("page_id", "status").filter("status in ('FAILED', 'COMPLETED')").join(have, "page_id", "left"), processing_rules())


def page_issues(pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """File, translation and processing rules together: the pages are read once, and only lengths and tests travel, no text."""
    slim = _lengths(pages).select("page_id", "status", "original_image_path", "output_pdf_path", "a", "b")
    have = artifacts.select("page_id").distinct().withColumn("have", F.lit(True))
    return emit(slim.join(have, "page_id", "left"), [*file_rules(), *translation_rules(), *processing_rules()])


def pipeline_issues(results: DataFrame) -> DataFrame:
    """Issues of a page's processing results (page_id, warnings array, pdf_success, pdf_error, has_regions, diagrams).

    One for each warning, one for a failed PDF step (a missing success counts as success) with its
    error, and one where diagram regions gave no diagrams (a missing number of diagrams is none).
    """
    def issue(cond, component, severity, kind, message):
        return F.when(cond, F.struct(F.lit(component).alias("component"), F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"), message.alias("message"), F.lit(1).cast("long").alias("n")))

    warned = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: issue(F.lit(True), "pipeline", "warning", "warning", F.coalesce(w, F.lit(""))))
    own = F.array(
        issue(~F.coalesce("pdf_success", F.lit(True)), "pdf_generation", "critical", "failed", F.concat(F.lit("PDF creation failed: "), F.coalesce("pdf_error", F.lit("Unknown error")))),
        issue(F.coalesce("has_regions", F.lit(False)) & (F.coalesce("diagrams", F.lit(0)) == 0), "diagram_agent", "warning", "no_diagrams", F.lit("Diagram regions detected but no diagram artifacts generated")),
    )
    return results.select("page_id", F.explode(F.array_compact(F.concat(warned, own))).alias("i")).select("page_id", "i.*")


def weight(severity: str = "severity") -> Column:
    """A missing severity is a warning, an unknown one weighs nothing."""
    c = F.coalesce(severity, F.lit("warning"))
    out = F.lit(0)
    for k, v in WEIGHTS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def level(score: Column) -> Column:
    out = F.lit("Failed")
    for least, name in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def scores(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Score, level and verdict of each page; a page without issues has 100."""
    lost = issues.groupBy("page_id").agg(F.sum(weight()).alias("lost"))
    s = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce("lost", F.lit(0)))).cast("int")
    return pages.select("page_id").join(lost, "page_id", "left").select("page_id", s.alias("score")).select("page_id", "score", level(F.col("score")).alias("level"), (F.col("score") >= PASS_SCORE).alias("passed"))


def summary(issues: DataFrame) -> DataFrame:
    """Issues of each severity by page, zero-filled."""
    return issues.groupBy("page_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS])


# Advice by component, in this order.
ADVICE = {
    "diagram_agent": "Review diagram processing - check if image quality is sufficient for label detection",
    "table_agent": "Tables have many empty cells - verify original image quality or table structure",
    "chart_agent": "Chart processing had issues - may need to reprocess with better image quality",
    "translator": "Translation quality check failed - consider reviewing translation manually",
    "pdf_generation": "PDF generation had issues - page may need reprocessing",
}
CRITICAL_ADVICE = "CRITICAL ISSUES FOUND - Page should be reprocessed or manually reviewed"


def advice() -> Column:
    """Aggregate: advice for a group of issues, the critical one first, then by component; diagrams need an error, tables empty cells."""
    c = lambda name: F.col("component") == name
    tests = {
        "diagram_agent": c("diagram_agent") & F.col("severity").isin("error", "critical"),
        "table_agent": c("table_agent") & (F.col("issue_type") == "empty_cells"),
        **{k: c(k) for k in ("chart_agent", "translator", "pdf_generation")},
    }
    parts = [F.when(F.bool_or(F.col("severity") == "critical"), CRITICAL_ADVICE), *[F.when(F.bool_or(t), ADVICE[k]) for k, t in tests.items()]]
    return F.array_join(F.array_compact(F.array(*parts)), "; ")


def recommendations(issues: DataFrame) -> DataFrame:
    """Advice for each page with issues."""
    return issues.groupBy("page_id").agg(advice().alias("advice"))


def review_gate(pages: DataFrame, least: int = PASS_SCORE) -> DataFrame:
    """A score under ``least`` needs review; no score does not."""
    return pages.select("page_id", "quality_score", F.when(F.col("quality_score") < least, "NEEDS_REVIEW").otherwise("COMPLETED").alias("status"), F.coalesce("quality_level", F.lit("Unknown")).alias("level"))


def report(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Score, level, counts and advice of each page."""
    g = issues.groupBy("page_id").agg(F.sum(weight()).alias("lost"), *[F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS], advice().alias("advice"))
    j = pages.select("page_id").join(g, "page_id", "left")
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce("lost", F.lit(0)))).cast("int")
    j = j.withColumn("score", score)
    return j.select("page_id", "score", level(F.col("score")).alias("level"), (F.col("score") >= PASS_SCORE).alias("passed"), *[F.coalesce(s, F.lit(0)).alias(s) for s in WEIGHTS], F.coalesce("advice", F.lit("")).alias("advice"))


# -- labels of diagrams and charts ------------------------------------------------------------------

CJK = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
# Labels that stay on the image whatever their length.
CRITICAL_LABELS = ("a", "b", "p", "v", "p1", "p2", "v1", "v2", "pa", "pb", "pc", "va", "vb", "vc")
# Phrases of a model's excuses.
DIAGNOSTICS = ("(no content to translate)", "(no text provided)", "no translation needed", "provided japanese text")


def keep_label(text: Column) -> Column:
    """Not blank, and no single character unless a letter, digit or CJK."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.coalesce((t != "") & ~((F.length(t) == 1) & ~t.rlike(f"[A-Za-z0-9]|{CJK}")), F.lit(False))


def label_class(text: Column) -> Column:
    """code (passes through), number, unit, or translate."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    code = F.lower(t).startswith("de") | t.rlike(r"^[0-9]{2,}$") | F.replace(t, F.lit("."), F.lit("")).rlike(r"^[0-9]+$")
    return F.when(code, "code").when(t.rlike(r"^[\d.,\-~]+$"), "number").when(t.rlike(r"^[a-zA-Z0-9/%]+$"), "unit").otherwise("translate")


def diagnostic(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(p) for p in DIAGNOSTICS]), F.lit(False))


def clean_label(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def diagram_key(annotations: DataFrame) -> DataFrame:
    """Labels for the key or on the image: low ones and long uncritical ones go to the key. First occurrence of each text counts.

    annotations: page_id, seq, label, y, h, region_h (0 if unknown: the middle counts as half way).
    """
    ratio = F.when(F.col("region_h") > 0, (F.col("y") + F.col("h") / 2.0) / F.col("region_h")).otherwise(0.5)
    words = F.size(F.filter(F.split("label", r"\s+"), lambda w: w != ""))
    short = (F.length("label") <= 10) & (words <= 2)
    critical = clean_label(F.col("label")).isin(*CRITICAL_LABELS)
    a = annotations.withColumn("list", F.when((ratio > 0.75) | (~critical & ~short), "key").otherwise("on_image"))
    first = a.groupBy("page_id", "list", "label").agg(F.min("seq").alias("seq"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "label")))
    return first.groupBy("page_id", "list").agg(F.array_join(F.transform(ordered, lambda s: s["label"]), "|").alias("labels"))


# Rendering modes whose labels stand in the key, and on the image.
KEY_MODES, IMAGE_MODES = ("key",), ("image", "marker")


def rendered_key(annotations: DataFrame) -> DataFrame:
    """The lists of persisted renderings: annotations (artifact_id, seq, text, mode) go by their mode, the first occurrence of each text counts; other modes are in no list."""
    some = annotations.withColumn("list", F.when(F.col("mode").isin(*KEY_MODES), "key").when(F.col("mode").isin(*IMAGE_MODES), "on_image")).filter("list is not null")
    first = some.groupBy("artifact_id", "list", F.coalesce("text", F.lit("")).alias("text")).agg(F.min("seq").alias("seq"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return first.groupBy("artifact_id", "list").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "|").alias("labels"))


def normal_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations with defaults for what is missing - 0 for places, '' for texts - and an id, the same in every run."""
    z = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c)
    return annotations.select("artifact_id", "node_path", F.sha2(F.concat_ws("/", F.col("artifact_id").cast("string"), "node_path"), 256).substr(1, 32).alias("annotation_id"), z("x"), z("y"), z("w"), z("h"), F.coalesce("original", F.lit("")).alias("original"), F.coalesce("text", F.lit("")).alias("text"))
