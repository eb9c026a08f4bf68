"""Sources and sinks: images, artifact JSON, OCR word tables, text files, CSV and HTML exports.

Paths are whatever the session's Hadoop file systems know (file:, gs:, s3a:, hdfs:).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.functions.text import format_bilingual, parse_bilingual

ARTIFACT_SCHEMA = (
    "tables array<struct<id:string,rows:int,cols:int,cells:array<struct<row:int,col:int,text:string,translation:string,row_span:int,col_span:int>>>>, "
    "charts array<struct<id:string,spec:string>>, diagram_renderings array<struct<diagram_id:string,mode:string,annotations:array<struct<x:int,y:int,w:int,h:int,original:string,text:string>>>>"
)
#: Columns of a word table (fixed values, the format of the OCR tool's tab-separated output).
TSV_SCHEMA = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (path, modificationTime, length, content); only the columns used are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,tif,tiff}").option("recursiveFileLookup", "true").load(path)


def artifact_key(project: str = "project_id", number: str = "page_number"):
    """Storage key of a page's artifacts."""
    return F.format_string("projects/%d/outputs/page_%d_artifacts.json", F.col(project), F.col(number))


def under_prefix(keys: DataFrame, project_id: int, key: str = "storage_key") -> DataFrame:
    """Objects of one project (those a prefix delete removes)."""
    return keys.filter(F.col(key).startswith(f"projects/{project_id}/"))


def write_artifacts(df: DataFrame, path: str) -> None:
    """Rows (project_id, ..., artifacts) as JSON lines, by project."""
    df.write.mode("overwrite").partitionBy("project_id").json(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifact documents of the usual shape; other shapes need ``operators.nested``."""
    return spark.read.schema("page_id long, " + ARTIFACT_SCHEMA).json(path)


def read_word_table(spark: SparkSession, path: str, least: float = 10.0) -> DataFrame:
    """A tab-separated word table: words of some confidence with text; bad rows are dropped."""
    rows = spark.read.schema(TSV_SCHEMA).option("sep", "\t").option("header", "true").option("mode", "DROPMALFORMED").option("quote", "").csv(path)
    return rows.filter((F.col("conf") >= least) & (F.trim("text") != "")).select(F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("conf").alias("confidence"), "text")


def parse_word_lines(lines: DataFrame, line: str = "value", least: float = 10.0) -> DataFrame:
    """The same of lines of text already read."""
    p = F.split(line, "\t")
    at = lambda i: F.try_element_at(p, F.lit(i + 1))
    num = lambda i, t: at(i).try_cast(t)
    ok = (F.size(p) >= 12) & num(6, "int").isNotNull() & (num(10, "double") >= least) & (F.trim(at(11)) != "")
    return lines.filter(ok).select(*[c for c in lines.columns if c != line], num(6, "int").alias("x"), num(7, "int").alias("y"), num(8, "int").alias("w"), num(9, "int").alias("h"), num(10, "double").alias("confidence"), at(11).alias("text"))


def write_bilingual(pages: DataFrame, path: str) -> None:
    """One text record per page with both languages under their markers."""
    pages.select(format_bilingual(F.col("ocr_text"), F.col("translated_text")).alias("value")).write.mode("overwrite").option("lineSep", "\n\f\n").text(path)


def read_bilingual(spark: SparkSession, path: str) -> DataFrame:
    """The translations of such records."""
    return spark.read.option("lineSep", "\n\f\n").text(path).select(parse_bilingual(F.col("value")).alias("translation"))


# Order of the parts of a book; other roles are left out.
ROLES = {"cover": 0, "page": 1, "back": 2}


def book_order(parts: DataFrame) -> DataFrame:
    """Position of each part (project_id, role, seq) in its book: cover, pages, back; stable within a role."""
    from pyspark.sql import Window

    m = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    r = parts.withColumn("rank", F.try_element_at(m, F.col("role"))).filter("rank is not null")
    return r.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy("rank", "seq"))).drop("rank")
