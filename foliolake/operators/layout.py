"""Boxes of a page: spatial predicates, joins to regions, and grouping into lines, paragraphs and sections.

Boxes have (page_id, seq, box_id, text, translation, x, y, w, h, confidence), regions (page_id,
region_seq, region_type, rx, ry, rw, rh, reading_order). Every spatial join is an equi join on the
page with a residual predicate. Gaps-and-islands run as windows by page; groupings whose decisions
depend on earlier ones are folds over the page's ordered boxes (``aggregate``), still in the JVM.
A page's boxes are one group by nature; nothing gathers more than a page. Null texts are ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_W, PAGE_H = 1000, 1700


def unique_boxes(text_boxes: DataFrame) -> DataFrame:
    """Boxes counted once. Partitioned by page, so the windows that follow need no further exchange."""
    b = text_boxes.select("page_id", "seq", "box_id", F.coalesce("text", F.lit("")).alias("text"), "translation", "x", "y", "w", "h", "confidence")
    return b.repartition("page_id").dropDuplicates(["page_id", "box_id"])


def by_position(*extra: str) -> Window:
    return Window.partitionBy("page_id").orderBy("y", "x", "seq", "box_id", *extra)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# -- filters ----------------------------------------------------------------------------------------


def confident(boxes: DataFrame, least: int = 30, inclusive: bool = False, within: tuple[int, int] | None = None, smallest: int = 3) -> DataFrame:
    """Boxes with more than ``least`` confidence (at least so much if ``inclusive``; null is none) and some text; with ``within`` those larger than ``smallest`` and smaller than it both ways."""
    c = F.col("confidence")
    some = boxes.filter((c >= least if inclusive else c > least) & (strip(F.col("text")) != ""))
    if within is not None:
        some = some.filter((F.col("w") > smallest) & (F.col("w") < within[0]) & (F.col("h") > smallest) & (F.col("h") < within[1]))
    return some


def denormalize(boxes: DataFrame, w: int, h: int) -> DataFrame:
    """0-1000 coordinates to pixels, each truncated."""
    return boxes.select("page_id", "box_id", *[F.expr(f"cast({c} * {n} / 1000.0D as int)").alias(c) for c, n in (("x", w), ("y", h), ("w", w), ("h", h))])


def pad_and_clamp(boxes: DataFrame, pad: int, w: int = PAGE_W, h: int = PAGE_H) -> DataFrame:
    """Boxes grown by ``pad`` within the page; those without area are dropped."""
    x1, y1 = F.greatest(F.lit(0), F.col("x") - pad), F.greatest(F.lit(0), F.col("y") - pad)
    x2, y2 = F.least(F.lit(w), F.col("x") + F.col("w") + pad), F.least(F.lit(h), F.col("y") + F.col("h") + pad)
    return boxes.select("page_id", "box_id", x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")).filter("w > 0 and h > 0")


def scale_back(boxes: DataFrame, factor: float = 0.5) -> DataFrame:
    return boxes.select("page_id", "box_id", *[F.expr(f"cast({c} * {factor}D as int)").alias(c) for c in "xywh"])


def vertical_text(boxes: DataFrame) -> DataFrame:
    """Whether a box holds vertical text, and its font size."""
    size = F.expr("greatest(10, least(cast(h * 0.8D as int), cast(w * 1.2D as int)))")
    return boxes.select("page_id", "box_id", (F.col("h") > F.col("w") * 1.6).alias("vertical"), size.alias("font_size"))


def label_font(h: Column, scale: float, chart: bool) -> Column:
    """Font size of a label on a diagram or chart: a part of its height, within bounds (fixed values)."""
    part, least = (0.7, 4) if chart else (0.6, 6)
    return F.greatest(F.lit(least), F.least((h * F.lit(part) * F.lit(scale)).cast("int"), F.lit(10)))


def sized_regions(boxes: DataFrame, w: int = PAGE_W, h: int = PAGE_H) -> DataFrame:
    return boxes.filter(f"w > 30 and h > 20 and w < {w} * 0.95D and h < {h} * 0.95D")


def leaked_labels(boxes: DataFrame, h: int = PAGE_H) -> DataFrame:
    """Labels that lie on the region's edge or under it and are too long for a label."""
    n = F.length("text")
    edge = ((F.col("y") < 5) | (F.col("y") + F.col("h") > h - 5)) & (n > 10)
    low = ((F.col("y") + F.col("h") / 2) > 0.9 * h) & (n > 20)
    return boxes.filter(edge | low)


def vertices_to_bbox(words: DataFrame) -> DataFrame:
    """Words with symbols and corner points as boxes: joined symbols, smallest and largest corner, confidence x 100."""
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    return words.select(
        "page_id", "box_id", F.array_join("symbols", "").alias("text"), F.array_min(xs).alias("x"), F.array_min(ys).alias("y"),
        (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"), F.round(F.col("score") * 100, 6).alias("confidence"),
    )


# -- joins with regions -----------------------------------------------------------------------------


def prose_boxes(boxes: DataFrame, regions: DataFrame, kinds: tuple[str, ...] = ("technical_diagram", "chart"), slack: int = 5) -> DataFrame:
    """Boxes inside no region of the given kinds (anti join)."""
    r = regions.filter(F.col("region_type").isin(*kinds)).withColumnRenamed("page_id", "rp")
    inside = (
        (F.col("page_id") == F.col("rp")) & (F.col("x") >= F.col("rx") - slack) & (F.col("y") >= F.col("ry") - slack)
        & (F.col("x") + F.col("w") <= F.col("rx") + F.col("rw") + slack) & (F.col("y") + F.col("h") <= F.col("ry") + F.col("rh") + slack)
    )
    return boxes.join(r, inside, "left_anti")


def joined_text(boxes: DataFrame, text: str = "text", sep: str = "\n") -> DataFrame:
    """Non-empty texts of each page in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "box_id", F.col(text).alias("t"))))
    some = boxes.filter(f"{text} is not null and {text} <> ''")
    return some.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), sep).alias("text"), F.count("*").alias("n"))


def assign_regions(boxes: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """The region that covers most of each box, if over half of it; ties go to the first region from the top."""
    ranked = regions.withColumn("region_rank", F.row_number().over(Window.partitionBy("page_id").orderBy("ry", "reading_order", "region_seq")))
    r = ranked.select(F.col("page_id").alias("rp"), "region_seq", "region_type", "region_rank", "rx", "ry", "rw", "rh")
    ix = F.least(F.col("x") + F.col("w"), F.col("rx") + F.col("rw")) - F.greatest("x", "rx")
    iy = F.least(F.col("y") + F.col("h"), F.col("ry") + F.col("rh")) - F.greatest("y", "ry")
    hit = boxes.join(r, (F.col("page_id") == F.col("rp")) & (ix > 0) & (iy > 0)).withColumn("area", ix * iy).filter(F.col("area") > least * F.col("w") * F.col("h"))
    best = hit.groupBy("page_id", "box_id").agg(F.max_by(F.struct("region_seq", "region_type"), F.struct("area", -F.col("region_rank"))).alias("r"), F.max("area").alias("area"))
    return best.select("page_id", "box_id", F.col("r.region_seq").alias("region_seq"), F.col("r.region_type").alias("region_type"), "area")


def paragraph_boxes(boxes: DataFrame, w: int = PAGE_W) -> DataFrame:
    """Boxes of running text: wide ones, and those with a near neighbour above or below that lines up with them."""
    n = boxes.select(F.col("page_id").alias("np"), F.col("box_id").alias("nb"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("w").alias("nw"))
    dy, dx = F.abs(F.col("ny") - F.col("y")), F.abs(F.col("nx") - F.col("x"))
    overlap = F.least(F.col("x") + F.col("w"), F.col("nx") + F.col("nw")) - F.greatest("x", "nx")
    reach = F.col("h") * F.when(F.col("w") < 0.2 * w, 1.5).otherwise(3.0)
    near = (F.col("page_id") == F.col("np")) & (F.col("box_id") != F.col("nb")) & (dy > 0) & (dy < reach) & ((overlap > 0.3 * F.least("w", "nw")) | (dx < 30))
    wide = boxes.filter(F.col("w") > 0.25 * w)
    rest = boxes.filter(F.col("w") <= 0.25 * w).join(n, near, "left_semi")
    return wide.unionByName(rest)


def page_number_boxes(boxes: DataFrame, w: int = PAGE_W, h: int = PAGE_H, first: int = 20) -> DataFrame:
    """The first number between dashes among the page's first boxes, at an outer side near the top."""
    top = boxes.withColumn("rank", F.row_number().over(by_position())).filter(F.col("rank") <= first)
    number = F.regexp_extract("text", "[-—]\\s*(\\d{1,3})\\s*[-—]", 1)
    side = ((F.col("x") < 0.3 * w) | (F.col("x") > 0.7 * w)) & (F.col("y") < 0.15 * h)
    return top.filter(side & (number != "")).groupBy("page_id").agg(F.min_by(number, F.col("rank")).cast("int").alias("number"))


def table_strategy(regions: DataFrame, w: int = PAGE_W, h: int = PAGE_H) -> DataFrame:
    """'full_page' where a region covers over 70 % of the page."""
    return regions.groupBy("page_id").agg(F.when(F.bool_or(F.col("rw") * F.col("rh") > 0.7 * w * h), "full_page").otherwise("crops").alias("strategy"))


def match_intervals(sections: DataFrame, marks: DataFrame) -> DataFrame:
    """For each section (page_id, section, y_start, y_end) the first mark (mark_seq, m_start, m_end) that overlaps it."""
    m = marks.withColumnRenamed("page_id", "mp")
    hit = sections.join(m, (F.col("page_id") == F.col("mp")) & (F.col("m_start") < F.col("y_end")) & (F.col("m_end") > F.col("y_start")))
    return hit.groupBy("page_id", "section").agg(F.min("mark_seq").alias("mark_seq"))


# -- windows ----------------------------------------------------------------------------------------


def paragraph_groups(boxes: DataFrame, gap: int = 50) -> DataFrame:
    """A new group where y differs from the box before by more than ``gap``."""
    w = by_position()
    jump = F.abs(F.col("y") - F.lag("y").over(w)) > gap
    return boxes.withColumn("brk", F.coalesce(jump.cast("int"), F.lit(0))).select("page_id", "seq", "box_id", F.sum("brk").over(w).cast("int").alias("group_no"), "text", "translation", "x", "y", "w", "h")


def line_groups(boxes: DataFrame) -> DataFrame:
    """Lines: a box stays on the line if its y is within 1.5 heights of the box before. Texts from left to right, united box, mean confidence."""
    w = by_position()
    jump = F.abs(F.col("y") - F.lag("y").over(w)) > 1.5 * F.lag("h").over(w)
    g = boxes.withColumn("brk", F.coalesce(jump.cast("int"), F.lit(0))).withColumn("line", F.sum("brk").over(w).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("x", "y", "seq", "box_id", "text")))
    return g.groupBy("page_id", "line").agg(
        F.array_join(F.transform(parts, lambda s: s["text"]), " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.round(F.avg("confidence"), 6).alias("confidence"),
    )


def reading_text(boxes: DataFrame) -> DataFrame:
    """Translations of a page from top to bottom as one text."""
    some = boxes.withColumn("t", strip(F.col("translation"))).filter("t is not null and t <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "seq", "box_id", "t")))
    return some.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"))


def band_merge(boxes: DataFrame, bands: int = 10, h: int = PAGE_H) -> DataFrame:
    """The horizontal bands that boxes start in, neighbours united."""
    height = h // bands
    kept = boxes.select("page_id", F.least(F.floor(F.col("y") / height), F.lit(bands - 1)).cast("int").alias("band")).distinct()
    island = F.col("band") - F.row_number().over(Window.partitionBy("page_id").orderBy("band"))
    g = kept.withColumn("island", island).groupBy("page_id", "island").agg(F.min("band").alias("a"), F.max("band").alias("b"))
    return g.select("page_id", (F.col("a") * height).alias("y_start"), ((F.col("b") + 1) * height).alias("y_end"))


def layout_sections(boxes: DataFrame, gap: int = 120) -> DataFrame:
    """Text sections and the gaps between them: page_id, n, section_type, y_start, y_end.

    A break stands where y passes the running bottom by more than ``gap``. The gap is a diagram,
    unless eight or more boxes lie strictly in it that read like prose.
    """
    w = by_position()
    before = F.max(F.col("y") + F.col("h")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = boxes.withColumn("before", before).withColumn("brk", F.coalesce((F.col("y") - F.col("before") > gap).cast("int"), F.lit(0)))
    g = g.withColumn("sec", F.sum("brk").over(w).cast("int"))
    text = g.groupBy("page_id", "sec").agg(F.min("y").alias("y_start"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.max("before").alias("before"))
    text = text.withColumn("y_end", F.greatest("bottom", F.coalesce("before", F.lit(0))))
    gaps = g.filter("brk = 1").select("page_id", "sec", F.col("before").alias("g_start"), F.col("y").alias("g_end"))
    inside = gaps.join(boxes.select(F.col("page_id").alias("bp"), F.col("y").alias("by"), F.col("h").alias("bh"), F.length("text").alias("n")), (F.col("page_id") == F.col("bp")) & (F.col("by") > F.col("g_start")) & (F.col("by") + F.col("bh") < F.col("g_end")), "left")
    stats = inside.groupBy("page_id", "sec", "g_start", "g_end").agg(F.count("n").alias("k"), F.avg((F.col("n") > 15).cast("int")).alias("long"), F.avg("n").alias("mean"))
    kind = F.when((F.col("k") >= 8) & ((F.col("long") > 0.3) | (F.col("mean") > 20)), "text").otherwise("diagram")
    return text.select("page_id", (F.col("sec") * 2 + 1).alias("n"), F.lit("text").alias("section_type"), "y_start", "y_end").unionByName(
        stats.select("page_id", (F.col("sec") * 2).alias("n"), kind.alias("section_type"), F.col("g_start").alias("y_start"), F.col("g_end").alias("y_end"))
    )


def reading_order(regions: DataFrame) -> DataFrame:
    """Order of regions by y; the reading order, where all of the page have one, breaks ties."""
    w = Window.partitionBy("page_id")
    order = F.when(F.count("reading_order").over(w) == F.count("*").over(w), F.col("reading_order"))
    return regions.withColumn("o", order).select("page_id", "region_seq", F.row_number().over(w.orderBy("ry", F.asc_nulls_first("o"), "region_seq")).alias("position"))


def dispatch_sections(regions: DataFrame, assigned: DataFrame) -> DataFrame:
    """Sections of regions by type: diagrams padded by 30, charts by 50, text only with boxes, tables without."""
    n = assigned.groupBy("page_id", "region_seq").agg(F.count("*").alias("boxes"))
    pad = F.when(F.col("region_type") == "technical_diagram", 30).when(F.col("region_type") == "chart", 50).otherwise(0)
    kind = F.when(F.col("region_type") == "technical_diagram", "diagram").when(F.col("region_type") == "chart", "chart").when(F.col("region_type") == "table", "table").otherwise("text")
    s = regions.join(n, ["page_id", "region_seq"], "left").withColumn("section_type", kind).withColumn("boxes", F.when(F.col("section_type") == "table", 0).otherwise(F.coalesce("boxes", F.lit(0))))
    return s.filter("section_type <> 'text' or boxes > 0").select(
        "page_id", "region_seq", "section_type", F.greatest(F.lit(0), F.col("ry") - pad).alias("y_start"), F.least(F.lit(PAGE_H), F.col("ry") + F.col("rh") + pad).alias("y_end"), "boxes"
    )


def region_lists(sections: DataFrame) -> DataFrame:
    """Paragraph, diagram and chart lists of sections; charts are in both of the last two."""
    pick = lambda name, kinds: sections.filter(F.col("section_type").isin(*kinds)).select("page_id", "region_seq", F.lit(name).alias("list"))
    return pick("paragraphs", ["text"]).unionByName(pick("diagram_regions", ["diagram", "chart"])).unionByName(pick("chart_regions", ["chart"]))


def positional_zip(sections: DataFrame, counted: str, artifacts: DataFrame) -> DataFrame:
    """The k-th table section with the k-th table artifact, and each section's offset into the running list of paragraphs."""
    w = Window.partitionBy("page_id").orderBy("y_start", "region_seq")
    s = sections.withColumn("offset", F.coalesce(F.sum(counted).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    t = s.filter("section_type = 'table'").withColumn("k", F.row_number().over(w))
    a = artifacts.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("artifact_seq"))).select("page_id", "k", "artifact_seq")
    return s.join(t.join(a, ["page_id", "k"], "left").select("page_id", "region_seq", "artifact_seq"), ["page_id", "region_seq"], "left").select("page_id", "region_seq", "section_type", "offset", "artifact_seq")


# -- folds ------------------------------------------------------------------------------------------


def _ordered(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy("page_id", *keys).agg(F.array_sort(F.collect_list(F.struct("y", "x", "seq", "box_id", "w", "h", "text", "translation"))).alias("bs"))


def paragraph_text(groups: DataFrame, tolerance: int = 20) -> DataFrame:
    """Text of each paragraph group. A line is anchored at its first box, so this is a fold and no window."""
    some = groups.filter("translation is not null and translation <> ''")

    def step(acc: Column, b: Column) -> Column:
        same = acc["anchor"].isNull() | (F.abs(b["y"] - acc["anchor"]) <= tolerance)
        line = acc["line"] + F.when(same, 0).otherwise(1)
        item = F.struct(line.alias("line"), b["x"].alias("x"), F.size(acc["out"]).alias("i"), strip(b["translation"]).alias("t"))
        return F.struct(F.when(same & acc["anchor"].isNotNull(), acc["anchor"]).otherwise(b["y"]).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(item)).alias("out"))

    start = F.struct(F.lit(None).cast("int").alias("anchor"), F.lit(0).alias("line"), F.array().cast("array<struct<line:int,x:int,i:int,t:string>>").alias("out"))
    folded = _ordered(some, "group_no").select("page_id", "group_no", F.aggregate("bs", start, step)["out"].alias("out"))
    ts = F.filter(F.transform(F.array_sort("out"), lambda s: s["t"]), lambda t: t != "")
    return folded.select("page_id", "group_no", F.array_join(ts, " ").alias("text"))


def label_clusters(boxes: DataFrame, gap_tolerance: int = 10, line_tolerance: int = 8) -> DataFrame:
    """Boxes side by side on a line as one label: texts joined, the first box's y, the running right edge."""
    cluster = "struct<x:int,y:int,w:int,h:int,text:string>"

    def step(acc: Column, b: Column) -> Column:
        cur = acc["cur"]
        gap = b["x"] - (cur["x"] + cur["w"])
        joins = cur.isNotNull() & (F.abs(b["y"] - cur["y"]) <= line_tolerance) & (gap >= 0) & (gap <= gap_tolerance)
        own = F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"), b["text"].alias("text"))
        grown = F.struct(
            cur["x"].alias("x"), cur["y"].alias("y"), (F.greatest(cur["x"] + cur["w"], b["x"] + b["w"]) - cur["x"]).alias("w"), F.greatest(cur["h"], b["h"]).alias("h"), strip(F.concat(cur["text"], b["text"])).alias("text")
        )
        return F.struct(F.when(joins, grown).otherwise(own).alias("cur"), F.when(joins | cur.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(cur))).alias("out"))

    start = F.struct(F.lit(None).cast(cluster).alias("cur"), F.array().cast(f"array<{cluster}>").alias("out"))
    all_ = F.aggregate("bs", start, step, lambda acc: F.concat(acc["out"], F.array(acc["cur"])))
    return _ordered(boxes).select("page_id", F.posexplode(all_).alias("cluster", "c")).select("page_id", "cluster", "c.*")


def merge_overlaps(boxes: DataFrame) -> DataFrame:
    """Greedy union in the given order: each box goes into the first box so far that it overlaps or touches."""
    box = "struct<x:int,y:int,w:int,h:int>"

    def step(acc: Column, b: Column) -> Column:
        touches = lambda o: ~((b["x"] > o["x"] + o["w"]) | (o["x"] > b["x"] + b["w"]) | (b["y"] > o["y"] + o["h"]) | (o["y"] > b["y"] + b["h"]))
        first = F.array_position(F.transform(acc, touches), True)

        def grow(o: Column, i: Column) -> Column:
            nx, ny = F.least(o["x"], b["x"]), F.least(o["y"], b["y"])
            new = F.struct(nx.alias("x"), ny.alias("y"), (F.greatest(o["x"] + o["w"], b["x"] + b["w"]) - nx).alias("w"), (F.greatest(o["y"] + o["h"], b["y"] + b["h"]) - ny).alias("h"))
            return F.when(i + 1 == first, new).otherwise(o)

        own = F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))
        return F.when(first == 0, F.concat(acc, F.array(own))).otherwise(F.transform(acc, grow))

    ordered = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "box_id", "x", "y", "w", "h"))).alias("bs"))
    return ordered.select("page_id", F.posexplode(F.aggregate("bs", F.array().cast(f"array<{box}>"), step)).alias("merged", "m")).select("page_id", "merged", "m.*")


def merge_sections(sections: DataFrame, gap: int = 300, short: int | None = 80) -> DataFrame:
    """Left fold over a page's sections: near diagrams become one, a diagram takes in a short text after it (unless ``short`` is None)."""
    sec = "struct<section_type:string,y_start:int,y_end:int>"

    def step(acc: Column, s: Column) -> Column:
        last = acc["last"]
        diagrams = (last["section_type"] == "diagram") & (s["section_type"] == "diagram") & (s["y_start"] - last["y_end"] < gap)
        absorbs = F.lit(False) if short is None else (last["section_type"] == "diagram") & (s["section_type"] == "text") & (s["y_end"] - s["y_start"] < short)
        own = F.struct(s["section_type"].alias("section_type"), s["y_start"].alias("y_start"), s["y_end"].alias("y_end"))
        end = F.when(diagrams, F.greatest(last["y_end"], s["y_end"])).otherwise(s["y_end"])
        grown = F.struct(last["section_type"].alias("section_type"), last["y_start"].alias("y_start"), end.alias("y_end"))
        joins = F.coalesce(diagrams | absorbs, F.lit(False))
        closed = F.when(joins | last.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(last)))
        return F.struct(closed.alias("out"), F.when(joins, grown).otherwise(own).alias("last"))

    start = F.struct(F.array().cast(f"array<{sec}>").alias("out"), F.lit(None).cast(sec).alias("last"))
    merged = F.aggregate("ss", start, step, lambda acc: F.concat(acc["out"], F.array(acc["last"])))
    ordered = sections.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", "section_type", "y_start", "y_end"))).alias("ss"))
    return ordered.select("page_id", F.posexplode(merged).alias("n", "s")).select("page_id", "n", "s.*")
