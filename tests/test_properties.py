"""Invariants of the core's operators on random boxes and cells, and their behaviour on odd input."""

import random

from pyspark.sql import functions as F

from foliolake.operators import layout, quality, relational, tables

BOX = "page_id long, seq int, box_id long, text string, translation string, x int, y int, w int, h int, confidence int, rank int, area int, brk int"


def frame(spark, n=60, pages=4, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.randint(1, pages), i, i, rnd.choice(["a", "bc d", "", None, "x" * 50]), rnd.choice([None, "", "t"]), rnd.randint(0, 900), rnd.randint(0, 1600), rnd.randint(1, 800), rnd.randint(1, 60), rnd.choice([None, 10, 90]), 1, 2, 3) for i in range(n)]
    return spark.createDataFrame(rows + rows[:5], BOX)


def regions(spark, pages=4):
    rows = [(p, i, t, x, y, 500, 300, i) for p in range(1, pages + 1) for i, (t, x, y) in enumerate([("chart", 0, 0), ("text_block", 400, 100), ("table", 0, 800), ("technical_diagram", 300, 1000)])]
    return spark.createDataFrame(rows, "page_id long, region_seq int, region_type string, rx int, ry int, rw int, rh int, reading_order int")


def test_every_box_is_in_one_group_and_at_most_one_region(spark):
    raw = frame(spark)
    b = layout.unique_boxes(raw)
    assert b.count() == 60
    assert layout.paragraph_groups(b).select("box_id").distinct().count() == 60
    assert layout.line_groups(b).agg(F.sum(F.lit(1))).first()[0] <= 60
    a = layout.assign_regions(b, regions(spark))
    assert a.groupBy("box_id").count().filter("count > 1").count() == 0
    assert layout.merge_overlaps(b).count() <= 60
    secs = layout.layout_sections(b)
    assert secs.filter("y_end < y_start").count() == 0


def test_empty_frames(spark):
    b = layout.unique_boxes(frame(spark)).limit(0)
    r = regions(spark).limit(0)
    for df in (layout.paragraph_boxes(b), layout.assign_regions(b, r), layout.prose_boxes(b, r), layout.layout_sections(b), layout.merge_sections(layout.layout_sections(b)), layout.label_clusters(b), layout.merge_overlaps(b), layout.band_merge(b), layout.line_groups(b), layout.dispatch_sections(r, layout.assign_regions(b, r))):
        assert df.count() == 0
    c = spark.createDataFrame([], "table_id long, page_id long, cell_id long, row_idx int, col_idx int, text string, translation string, row_span int, col_span int")
    for df in (tables.csv_lines(c), tables.html_tables(c), tables.two_column_charts(c), tables.multi_series(c), tables.stacking(c), quality.table_issues(c)):
        assert df.count() == 0


def test_scores_stay_in_range_whatever_the_issues(spark):
    rnd = random.Random(2)
    sev = ["critical", "error", "warning", "info", None, "odd"]
    rows = [(rnd.randint(1, 9), rnd.choice(sev)) for _ in range(200)]
    got = quality.scores(spark.createDataFrame([(i,) for i in range(1, 11)], "page_id long"), spark.createDataFrame(rows, "page_id long, severity string"))
    assert got.filter("score < 0 or score > 100").count() == 0 and got.count() == 10


def test_ranks_over_buckets_are_those_of_a_window(spark):
    rnd = random.Random(3)
    rows = [(None if i % 9 == 0 else i % 3, rnd.randint(0, 40), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, v int, i int")
    got = {(r.g, r.i): r.position for r in relational.rank_within(df, "g", F.floor(F.col("v") / 7), [F.col("v"), F.col("i")]).collect()}
    for g in {r[0] for r in rows}:
        for k, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            assert got[g, i] == k


def test_updates_and_conflicts(spark):
    pages = spark.createDataFrame([(1, 5, 1, "COMPLETED"), (2, 5, 1, "FAILED"), (3, None, None, None)], "page_id long, project_id long, page_number int, status string")
    patches = spark.createDataFrame([(1, "FAILED"), (2, None), (9, "X")], "page_id long, status string")
    assert {r.page_id: r.status for r in relational.patch(pages, patches, "page_id", ["status"]).collect()} == {1: "FAILED", 2: "FAILED", 3: None}
    assert [tuple(r) for r in relational.upload_conflicts(pages).collect()] == [(5, 1, 2, 1)]
    asked = spark.createDataFrame([(1,), (1,), (7,)], "page_id long")
    assert sorted(tuple(r) for r in relational.missing_requests(asked, pages).collect()) == [(1, "repeated"), (7, "missing")]
    assert relational.list_pages(pages, 5, 0, 20, "bogus").count() == 2  # no valid status: no filter
    assert relational.list_pages(pages, 5, 1, 20, "completed,failed").first().total == 2
