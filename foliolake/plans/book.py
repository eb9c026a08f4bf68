"""The processing of all pages at once: boxes to paragraphs, quality, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.operators import layout, quality, tables, textstats
from foliolake.session import table


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every page, translated where they are not (seam), in order."""
    boxes = layout.unique_boxes(table(spark, sf_dir, "text_boxes"))
    filled = textstats.translate_once(boxes, "text").withColumn("translation", F.coalesce("translation", "translated")).drop("translated")
    groups = layout.paragraph_groups(filled)
    return layout.paragraph_text(groups)


def table_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV and HTML of every table."""
    cells = tables.unique_cells(table(spark, sf_dir, "table_cells"))
    return tables.csv_lines(cells).join(tables.html_tables(cells), "table_id")


def reviewed(spark: SparkSession, sf_dir: str, issues: DataFrame) -> DataFrame:
    """Pages with their score and the status it asks for."""
    scored = quality.scores(table(spark, sf_dir, "book_pages"), issues)
    return scored.withColumn("status", F.when(F.col("passed"), "COMPLETED").otherwise("NEEDS_REVIEW"))
