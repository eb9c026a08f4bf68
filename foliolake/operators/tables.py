"""Table grids, their CSV and HTML forms, and charts inferred from tables.

Cells have (page_id, table_id, row_idx, col_idx, cell_id, text, translation, row_span, col_span).
A grid that is written out has at most ``MAX_PLACES`` places, so one dirty cell far outside can't
blow it up; everything is grouped by table with a map-side combine or ordered arrays of one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_cells(table_cells: DataFrame) -> DataFrame:
    """Cells counted once; of several at one place the last id wins. Partitioned by table."""
    c = table_cells.repartition("table_id").dropDuplicates(["table_id", "cell_id"])
    last = F.row_number().over(Window.partitionBy("table_id", "row_idx", "col_idx").orderBy(F.desc("cell_id")))
    return c.withColumn("last", last).filter("last = 1").drop("last")


def grid_cells(cells: DataFrame) -> DataFrame:
    """Size of each table's grid (rows, cols), and the cells it has and lacks."""
    g = cells.groupBy("table_id").agg((F.max("row_idx") + 1).alias("rows"), (F.max("col_idx") + 1).alias("cols"), F.count("*").alias("cells"))
    return g.withColumn("missing", F.col("rows") * F.col("cols") - F.col("cells"))


def rows_to_cells(rows: DataFrame, key: str, grid: str) -> DataFrame:
    """An array of rows (arrays of values, ragged) as cells; text and translation are the value as text."""
    r = rows.select(key, F.posexplode(grid).alias("row_idx", "values"))
    return r.select(key, "row_idx", F.posexplode("values").alias("col_idx", "v")).select(key, "row_idx", "col_idx", F.col("v").cast("string").alias("text"), F.col("v").cast("string").alias("translation"))


def shown(cells: DataFrame) -> Column:
    """What is shown of a cell: the translation, else the text, else ''."""
    return F.coalesce(F.nullif("translation", F.lit("")), F.col("text"), F.lit(""))


#: Places up to which a grid is written out. One cell far outside would make a table of few cells unboundedly large.
MAX_PLACES = 1_000_000


def full_grid(cells: DataFrame) -> DataFrame:
    """Every place of every grid of at most ``MAX_PLACES`` places with what is shown there ('' where there is no cell)."""
    size = cells.groupBy("table_id").agg(F.max("row_idx").alias("mr"), F.max("col_idx").alias("mc")).filter((F.col("mr").cast("long") + 1) * (F.col("mc").cast("long") + 1) <= MAX_PLACES)
    places = size.select("table_id", F.explode(F.sequence(F.lit(0), "mr")).alias("row_idx"), "mc").select("table_id", "row_idx", F.explode(F.sequence(F.lit(0), "mc")).alias("col_idx"))
    have = cells.select("table_id", "row_idx", "col_idx", shown(cells).alias("shown"), "row_span", "col_span", F.lit(True).alias("there"))
    return places.join(have, ["table_id", "row_idx", "col_idx"], "left")


def oversized(cells: DataFrame, column: str) -> DataFrame:
    """Tables whose grid has more places than are written out, with a null ``column``."""
    big = grid_cells(cells).filter(F.col("rows").cast("long") * F.col("cols").cast("long") > MAX_PLACES)
    return big.select("table_id", F.lit(None).cast("string").alias(column))


def csv_lines(cells: DataFrame, sep: str = ",") -> DataFrame:
    """Each table as unquoted CSV: newlines are spaces, missing cells '', trailing white space off. Null for grids of over ``MAX_PLACES`` places."""
    g = full_grid(cells).withColumn("v", F.replace(F.coalesce("shown", F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = g.groupBy("table_id", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "v"))), lambda s: s["v"]), sep).alias("line"))
    lines = rows.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda s: s["line"]), "\n").alias("csv"))
    return lines.select("table_id", F.regexp_replace("csv", r"\s+$", "").alias("csv")).unionByName(oversized(cells, "csv"))


def html_tables(cells: DataFrame) -> DataFrame:
    """Each table as HTML with spans; a place covered by an earlier span gives no cell. Null for grids of over ``MAX_PLACES`` places.

    Whether a cell's span counts depends on whether the cell itself is covered, so the spans that
    count come from a fold over the table's spanning cells in reading order; they are few. Rows are
    made of their own cells and the gaps between, so nothing but the table's key moves the data.
    """
    rs, cs = F.greatest(F.lit(1), F.coalesce("row_span", F.lit(1))), F.greatest(F.lit(1), F.coalesce("col_span", F.lit(1)))
    td = F.lit("<td></td>")

    def covers(s: Column, r: Column, c: Column) -> Column:
        return (r >= s["r"]) & (r < s["r"] + s["rs"]) & (c >= s["c"]) & (c < s["c"] + s["cs"]) & ((r != s["r"]) | (c != s["c"]))

    def covered(kept: Column, r: Column, c: Column) -> Column:
        return F.exists(kept, lambda s: covers(s, r, c))

    def gap(kept: Column, r: Column, lo: Column, hi: Column) -> Column:
        """The places of row r from lo to before hi, which have no cell."""
        free = F.filter(F.sequence(lo, hi - 1), lambda c: ~covered(kept, r, c))
        return F.when(hi <= lo, "").when(F.size(kept) == 0, F.repeat(td, hi - lo)).otherwise(F.repeat(td, F.size(free)))

    own = F.struct(F.col("row_idx").alias("r"), F.col("col_idx").alias("c"), rs.alias("rs"), cs.alias("cs"))
    none = F.array().cast("array<struct<r:int,c:int,rs:int,cs:int>>")
    kept = F.aggregate(F.array_sort("ss"), none, lambda acc, s: F.when(F.exists(acc, lambda o: covers(o, s["r"], s["c"])), acc).otherwise(F.concat(acc, F.array(s))))
    whole = cells.groupBy("table_id").agg(F.max("row_idx").alias("mr"), F.max("col_idx").alias("mc"), F.collect_list(F.when((rs > 1) | (cs > 1), own)).alias("ss"))
    whole = whole.filter((F.col("mr").cast("long") + 1) * (F.col("mc").cast("long") + 1) <= MAX_PLACES).select("table_id", "mr", "mc", kept.alias("kept"))
    attrs = F.concat(F.when(rs > 1, F.concat(F.lit(" rowspan='"), rs.cast("string"), F.lit("'"))).otherwise(""), F.when(cs > 1, F.concat(F.lit(" colspan='"), cs.cast("string"), F.lit("'"))).otherwise(""))
    cell = F.struct(F.col("col_idx").alias("c"), F.concat(F.lit("<td"), attrs, F.lit(">"), shown(cells), F.lit("</td>")).alias("h"))
    rows = cells.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(cell)).alias("cells")).join(whole, "table_id")
    r = F.col("row_idx")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("hs"))
    step = lambda acc, x: F.struct((x["c"] + 1).alias("at"), F.concat(acc["hs"], F.array(F.concat(gap(F.col("kept"), r, acc["at"], x["c"]), F.when(covered(F.col("kept"), r, x["c"]), "").otherwise(x["h"])))).alias("hs"))
    line = F.aggregate("cells", start, step, lambda acc: F.concat(F.array_join(acc["hs"], ""), gap(F.col("kept"), r, acc["at"], F.col("mc") + 1)))
    rows = rows.select("table_id", F.struct(r.alias("r"), line.alias("h")).alias("row"), "mr", "mc", "kept")
    g = rows.groupBy("table_id").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.first("mr").alias("mr"), F.first("mc").alias("mc"), F.first("kept").alias("kept"))

    def missing(lo: Column, hi: Column) -> Column:
        """Rows from lo to before hi, which have no cell."""
        return F.when(hi <= lo, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(lo, hi - 1), lambda i: gap(F.col("kept"), i, F.lit(0), F.col("mc") + 1)))

    stack = lambda acc, x: F.struct((x["r"] + 1).alias("at"), F.concat(acc["hs"], missing(acc["at"], x["r"]), F.array(x["h"])).alias("hs"))
    out = g.select("table_id", F.array_join(F.aggregate("rows", start, stack)["hs"], "</tr><tr>").alias("h"))
    return out.select("table_id", F.concat(F.lit("<table><tr>"), "h", F.lit("</tr></table>")).alias("html")).unionByName(oversized(cells, "html"))


def in_grid(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells of a fixed matrix; a span is kept only where it fits."""
    fits = (F.col("row_idx") + F.col("row_span") <= rows) & (F.col("col_idx") + F.col("col_span") <= cols)
    return cells.filter((F.col("row_idx") < rows) & (F.col("col_idx") < cols)).select("table_id", "row_idx", "col_idx", F.when(fits, F.col("row_span")).otherwise(1).alias("row_span"), F.when(fits, F.col("col_span")).otherwise(1).alias("col_span"))


# -- charts -----------------------------------------------------------------------------------------

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Shapes of dates (fixed values): year first, year last, month and year, year.
DATE_SHAPES = r"(?i)^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}|\d{4})$"


def parse_number(c: Column) -> Column:
    """Commas and one trailing % dropped, then a plain decimal; anything else (also nan, inf, 1_000) is null."""
    s = F.regexp_replace(F.trim(F.replace(c, F.lit(","), F.lit(""))), "%$", "")
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def looks_like_date(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(DATE_SHAPES), F.lit(False))


def normalize_date(c: Column) -> Column:
    """struct(day, granularity): the first format that parses, day before month; null if none."""
    s = F.trim(c)
    day = F.coalesce(
        *[F.when(s.rlike(p), F.try_to_date(s, f)) for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"))]
    )
    name = F.initcap(F.lower(s))
    month = F.coalesce(F.when(s.rlike(r"(?i)^[a-z]{3}\s+\d{4}$"), F.try_to_date(name, "MMM yyyy")), F.when(s.rlike(r"(?i)^[a-z]{3,9}\s+\d{4}$"), F.try_to_date(name, "MMMM yyyy")))
    year = F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01")))
    return F.struct(
        F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.date_format(month, "yyyy-MM-01"), year).alias("day"),
        F.when(day.isNotNull(), "date").when(month.isNotNull(), "yearmonth").when(year.isNotNull(), "year").alias("granularity"),
    )


def unit_of(c: Column) -> Column:
    """What stands in the first parentheses."""
    return F.nullif(F.trim(F.regexp_extract(c, r"\(([^)]+)\)", 1)), F.lit(""))


def eligible(cells: DataFrame) -> DataFrame:
    """Tables with at least two rows and two columns."""
    return grid_cells(cells).filter("rows >= 2 and cols >= 2").select("table_id", "rows", "cols")


def chart_rows(cells: DataFrame) -> DataFrame:
    """Cells of eligible tables, with number and date tests made once."""
    t = F.trim(shown(cells))
    c = cells.join(eligible(cells), "table_id").withColumn("v", t)
    return c.select("table_id", "rows", "cols", "row_idx", "col_idx", "v", parse_number(t).alias("num"), looks_like_date(t).alias("date_like"))


def two_column_charts(cells: DataFrame) -> DataFrame:
    """Two-column tables: header, share of numbers in the second column, whether the first is dates, mark and titles.

    The shares are over all rows, the header among them.
    """
    c = chart_rows(cells).filter("cols = 2")
    at = lambda r, k, what: F.max(F.when((F.col("row_idx") == r) & (F.col("col_idx") == k), F.col(what)))
    g = c.groupBy("table_id", "rows").agg(
        (at(0, 0, "num").isNull() & at(0, 1, "num").isNull()).alias("header"), at(0, 0, "v").alias("x_title"), at(0, 1, "v").alias("y_title"),
        F.count_if((F.col("col_idx") == 1) & F.col("num").isNotNull()).alias("numbers"), F.count_if((F.col("col_idx") == 0) & F.col("date_like")).alias("dates"),
    )
    ratio, temporal = F.col("numbers") / F.col("rows"), F.col("dates") / F.col("rows") >= 0.7
    return g.select(
        "table_id", "header", F.round(ratio, 6).alias("numeric_ratio"), temporal.alias("temporal"),
        F.when(temporal, "line").when(ratio >= 0.7, "bar").otherwise("line").alias("mark"), F.when(ratio >= 0.7, "quantitative").otherwise("nominal").alias("y_type"),
        F.when(F.col("header"), F.concat(F.col("y_title"), F.coalesce(F.concat(F.lit(" ["), unit_of(F.col("y_title")), F.lit("]")), F.lit("")))).alias("title"),
    )


def chart_points(cells: DataFrame) -> DataFrame:
    """x and y of two-column tables without the header; a y that is no number stays text."""
    c = chart_rows(cells).filter("cols = 2")
    head = two_column_charts(cells).select("table_id", "header")
    x, y = (c.filter(F.col("col_idx") == k).select("table_id", "row_idx", F.col("v").alias(n), F.col("num").alias(f"{n}_num")) for k, n in ((0, "x"), (1, "y")))
    return x.join(y, ["table_id", "row_idx"]).join(head, "table_id").filter((F.col("row_idx") > 0) | ~F.col("header")).select("table_id", "row_idx", "x", F.col("y_num").alias("y"), F.when(F.col("y_num").isNull(), F.col("y")).alias("y_text"))


def _multi(cells: DataFrame) -> DataFrame:
    c = chart_rows(cells).filter("cols >= 3")
    head = c.groupBy("table_id").agg((F.count_if((F.col("row_idx") == 0) & (F.col("col_idx") >= 1) & F.col("num").isNull()) >= F.greatest(F.lit(1), F.expr("(max(cols) - 1) div 2"))).alias("header"))
    return c.join(head, "table_id")


def multi_series(cells: DataFrame) -> DataFrame:
    """Tables of three or more columns as (x, series, y) rows; series are named by the header or 'Series k'."""
    c = _multi(cells)
    body = c.filter((F.col("row_idx") > 0) | ~F.col("header"))
    x = body.filter("col_idx = 0").select("table_id", "row_idx", F.col("v").alias("x"))
    names = c.filter("row_idx = 0 and header").select("table_id", "col_idx", F.col("v").alias("name"))
    y = body.filter("col_idx >= 1").join(names, ["table_id", "col_idx"], "left")
    series = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Series "), F.col("col_idx").cast("string")))
    return y.join(x, ["table_id", "row_idx"], "left").select("table_id", "row_idx", F.coalesce("x", F.lit("")).alias("x"), series.alias("series"), F.col("num").alias("y"), F.when(F.col("num").isNull(), F.col("v")).alias("y_text"))


def stacking(cells: DataFrame) -> DataFrame:
    """Temporal by the first six data rows; stacked bars for categories of numbers, normalised where most are percentages."""
    c = _multi(cells)
    body = c.filter((F.col("row_idx") > 0) | ~F.col("header")).withColumn("start", F.col("header").cast("int"))
    early = (F.col("col_idx") == 0) & (F.col("row_idx") < F.col("start") + 6)
    value = F.col("col_idx") >= 1
    g = body.groupBy("table_id").agg(
        F.avg(F.when(early, F.col("date_like").cast("int"))).alias("dates"), F.avg(F.when(value, F.col("num").isNotNull().cast("int"))).alias("numbers"), F.avg(F.when(value, F.col("v").endswith("%").cast("int"))).alias("percent")
    )
    temporal = F.coalesce(F.col("dates") >= 0.7, F.lit(False))
    stacked = ~temporal & (F.col("numbers") >= 0.7)
    return g.select("table_id", temporal.alias("temporal"), F.when(stacked, "bar").otherwise("line").alias("mark"), F.when(stacked & (F.col("percent") >= 0.7), "normalize").when(stacked, "zero").otherwise("none").alias("stack"))


def override_stack(stack: Column, choice: str) -> Column:
    """A user's choice of stacking; auto keeps what was inferred."""
    return stack if choice == "auto" else F.lit(choice)


def dominant_granularity(cells: DataFrame) -> DataFrame:
    """The commonest date granularity of each table's first column, ties to the first seen; unparsable ones count as ''."""
    c = cells.filter("col_idx = 0").select("table_id", "row_idx", F.coalesce(normalize_date(shown(cells))["granularity"], F.lit("")).alias("granularity"))
    n = c.groupBy("table_id", "granularity").agg(F.count("*").alias("n"), F.min("row_idx").alias("first"))
    return n.groupBy("table_id").agg(F.max_by("granularity", F.struct("n", -F.col("first"))).alias("granularity"))
