"""Small fixtures with results worked out by hand, and folds against plain loops."""

import random

from pyspark.sql import functions as F

from foliolake.functions import text as t
from foliolake.operators import layout, quality, relational, tables, textstats
from foliolake.sources import files
from foliolake.streaming import status

BOX = "page_id long, seq int, box_id long, text string, translation string, x int, y int, w int, h int, confidence int"


def boxes(spark, rows):
    return spark.createDataFrame([(p, i, p * 1000 + i, txt, tr, x, y, w, h, 90) for p, i, x, y, w, h, txt, tr in rows], BOX)


PAGE = [(50, 100, 800, 20, "a"), (50, 125, 800, 20, "b"), (50, 150, 600, 20, "c"), (400, 300, 100, 20, "Label"), (50, 500, 800, 20, "d"), (50, 525, 800, 20, "e"), (50, 550, 700, 20, "f")]


def test_paragraph_filter_and_sections(spark):
    b = boxes(spark, [(1, i, *p[:4], p[4], None) for i, p in enumerate(PAGE)])
    kept = layout.paragraph_boxes(b)
    assert sorted(r.text for r in kept.collect()) == list("abcdef")
    merged = layout.merge_sections(layout.layout_sections(kept)).filter("section_type = 'diagram'").collect()
    assert [(r.y_start, r.y_end) for r in merged] == [(170, 570)]


def random_boxes(seed, pages=3, n=25):
    rnd = random.Random(seed)
    return [(p, i, rnd.randint(0, 300), rnd.randint(0, 60), rnd.randint(1, 40), rnd.randint(5, 12), rnd.choice("abc "), rnd.choice(["x", "", None, " y "])) for p in range(pages) for i in range(n)]


def test_merge_overlaps_and_clusters(spark):
    rows = random_boxes(3)
    b = boxes(spark, rows)
    got = {}
    for r in layout.merge_overlaps(b).orderBy("page_id", "merged").collect():
        got.setdefault(r.page_id, []).append((r.x, r.y, r.w, r.h))
    got2 = {}
    for r in layout.label_clusters(b, 10).orderBy("page_id", "cluster").collect():
        got2.setdefault(r.page_id, []).append((r.x, r.y, r.w, r.text))
    for page in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == page]
        out = []
        for _, _, x, y, w, h, *_ in mine:
            for k, (a, b_, c, d) in enumerate(out):
                if x <= a + c and a <= x + w and y <= b_ + d and b_ <= y + h:
                    nx, ny = min(x, a), min(y, b_)
                    out[k] = (nx, ny, max(x + w, a + c) - nx, max(y + h, b_ + d) - ny)
                    break
            else:
                out.append((x, y, w, h))
        assert got[page] == out
        cl = []
        for _, i, x, y, w, h, txt, _tr in sorted(mine, key=lambda r: (r[3], r[2], r[1])):
            if cl and abs(y - cl[-1][1]) <= 8 and 0 <= x - (cl[-1][0] + cl[-1][2]) <= 10:
                a = cl[-1]
                cl[-1] = (a[0], a[1], max(a[0] + a[2], x + w) - a[0], (a[3] + txt).strip())
            else:
                cl.append((x, y, w, txt))
        assert got2[page] == cl


def test_paragraph_text_is_anchored(spark):
    # 0, 15, 30: the third starts a new line, though it is near the second
    b = boxes(spark, [(1, 0, 100, 0, 10, 10, "", "b"), (1, 1, 0, 15, 10, 10, "", "a"), (1, 2, 0, 30, 10, 10, "", "c")])
    assert layout.paragraph_text(layout.paragraph_groups(b)).first().text == "a b c"
    assert layout.paragraph_groups(boxes(spark, [])).count() == 0


def test_page_numbers_are_allocated_in_order(spark):
    ups = [(1, i, n) for i, n in enumerate(["page_2.jpg", "scan-7.png", "x.jpg", "p7.jpg", "page 9_7.jpg"])] + [(2, 0, None)]
    df = spark.createDataFrame(ups, "project_id long, seq int, name string")
    taken = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (3, None)], "project_id long, page_number int")
    got = {(r.project_id, r.seq): r.page_number for r in relational.allocate_page_numbers(df, taken).collect()}
    assert got == {(1, 0): 3, (1, 1): 7, (1, 2): 8, (1, 3): 9, (1, 4): 10, (2, 0): 1}
    # a hot project goes through in many batches
    many = spark.range(25_000).selectExpr("1L as project_id", "cast(id as int) as seq", "concat('page_', id % 1000, '.jpg') as name")
    out = relational.allocate_page_numbers(many, taken.limit(0)).collect()
    assert len({r.page_number for r in out}) == len(out) == 25_000


def test_deletes_uploads_and_selection(spark):
    pages = spark.createDataFrame([(1, 5, 1, "COMPLETED"), (2, 5, 2, "FAILED"), (3, 6, 1, None), (4, None, None, "COMPLETED")], "page_id long, project_id long, page_number int, status string")
    projects = spark.createDataFrame([(5, 2, 0), (6, None, None), (7, 3, 1)], "project_id long, total_pages int, completed_pages int")
    kept, counters = relational.without_pages(pages, projects, spark.createDataFrame([(1,), (1,), (3,), (9,)], "page_id long"))
    assert {r.page_id for r in kept.collect()} == {2, 4}
    assert {r.project_id: (r.total_pages, r.completed_pages) for r in counters.collect()} == {5: (1, 0), 6: (0, 0), 7: (3, 1)}
    incoming = spark.createDataFrame([(5, 2, 1), (5, 3, 2), (5, 3, 3), (None, 1, 4)], "project_id long, page_number int, seq int")
    assert {r.seq: r.accepted for r in relational.accepted_uploads(incoming, pages).collect()} == {1: False, 2: True, 3: False, 4: True}
    users = spark.createDataFrame([("a@x",), (None,)], "email string")
    mails = spark.createDataFrame([("a@x", 1), ("b@x", 2), ("b@x", 3), ("B@x", 4), (None, 5)], "email string, seq int")
    assert {r.seq: r.accepted for r in relational.unique_emails(mails, users).collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}
    s = {r.project_id: (r.selectable, r.selected, r.action) for r in relational.selection(pages, spark.createDataFrame([(1,), (2,), (2,), (77,)], "page_id long")).collect()}
    assert s == {5: (2, 2, "deselect"), 6: (0, 0, "select"), None: (1, 0, "select")}


def test_a_cell_far_outside(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a", None, 2, 1), (1, 1, 1, "b", None, None, None), (2, 1_000_000, 1_000_000, "x", None, 1, 1)], "table_id long, row_idx int, col_idx int, text string, translation string, row_span int, col_span int")
    assert {r.table_id: r.csv for r in tables.csv_lines(cells).collect()} == {1: "a,\n,b", 2: None}
    assert {r.table_id: r.html for r in tables.html_tables(cells).collect()} == {1: "<table><tr><td rowspan='2'>a</td><td></td></tr><tr><td>b</td></tr></table>", 2: None}


def test_translate_values_and_once(spark):
    from foliolake.operators import textstats

    df = spark.createDataFrame([(1, {"a": "x", "b": None, "c": "x"}), (2, None), (3, {})], "id long, labels map<string,string>")
    got = {r.id: r.labels for r in textstats.translate_values(df, "id", "labels").collect()}
    assert got == {1: {"a": "[EN]x", "b": None, "c": "[EN]x"}, 2: None, 3: {}}
    texts = spark.createDataFrame([(1, "x", "q"), (2, "x", "q"), (3, " ", "q"), (4, None, "q")], "id long, t string, _a string")
    assert {r.id: r.translated for r in textstats.translate_once(texts.drop("_a"), "t").collect()} == {1: "[EN]x", 2: "[EN]x", 3: "", 4: ""}


def test_file_rules_and_fonts(spark):
    pages = spark.createDataFrame([(1, "COMPLETED", "a", "b"), (2, "COMPLETED", "c", None), (3, "FAILED", None, None)], "page_id long, status string, original_image_path string, output_pdf_path string")
    files = spark.createDataFrame([("a", 0), ("b", 999), ("c", 5), (None, 7)], "path string, length long")
    assert sorted((r.page_id, r.issue_type) for r in quality.file_issues(pages, files).collect()) == [(1, "empty_input"), (1, "small_output"), (2, "missing_output")]
    h = spark.createDataFrame([(5,), (20,), (100,)], "h int")
    assert [tuple(r) for r in h.select(layout.label_font(F.col("h"), 0.5, True), layout.label_font(F.col("h"), 0.5, False)).collect()] == [(4, 6), (7, 6), (10, 10)]


def test_quality_of_hand_worked_pages(spark):
    issues = spark.createDataFrame(
        [(1, "files", "critical"), (1, "pdf_generation", "critical"), (2, "x", None), (2, "x", "odd"), *[(3, "table_agent", "error")] * 9], "page_id long, component string, severity string"
    ).withColumn("issue_type", F.lit("t"))
    pages = spark.createDataFrame([(1,), (2,), (3,), (4,)], "page_id long")
    got = {r.page_id: (r.score, r.level, r.passed) for r in quality.scores(pages, issues).collect()}
    assert got == {1: (50, "Poor", False), 2: (95, "Excellent", True), 3: (0, "Failed", False), 4: (100, "Excellent", True)}
    gate = spark.createDataFrame([(1, None, None), (2, 69, "Poor"), (3, 70, "Good")], "page_id long, quality_score int, quality_level string")
    assert [r.status for r in quality.review_gate(gate).orderBy("page_id").collect()] == ["COMPLETED", "NEEDS_REVIEW", "COMPLETED"]


def test_html_spans(spark):
    cells = [(1, 1, 0, 0, 0, "a", None, 2, 2), (1, 1, 1, 0, 2, "b", "B", 1, 1), (1, 1, 2, 1, 1, "hidden", None, 3, 3), (1, 1, 3, 2, 2, None, "", 1, 1)]
    df = spark.createDataFrame([(t_, p, i, r, c, x, y, rs, cs) for t_, p, i, r, c, x, y, rs, cs in cells], "table_id long, page_id long, cell_id long, row_idx int, col_idx int, text string, translation string, row_span int, col_span int")
    got = tables.html_tables(df).first().html
    assert got == "<table><tr><td rowspan='2' colspan='2'>a</td><td>B</td></tr><tr><td></td></tr><tr><td></td><td></td><td></td></tr></table>"
    assert tables.csv_lines(df).first().csv == "a,,B\n,hidden,\n,,".rstrip()


def test_numbers_and_dates(spark):
    rows = ["1,234.5", "12%", "1d", "nan", "1_000", "", None, ".5", "-3e2", "5%%"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(tables.parse_number(F.col("s"))).collect()]
    assert got == [1234.5, 12.0, None, None, None, None, None, 0.5, -300.0, None]
    dates = ["2020-1-2", "2.1.2020", "Jan 2020", "january 2020", "2020", "13/13/2020", "x", None, "31-12-1999"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(x,) for x in dates], "s string").select(tables.normalize_date(F.col("s"))).collect()]
    assert got == [("2020-01-02", "date"), ("2020-01-02", "date"), ("2020-01-01", "yearmonth"), ("2020-01-01", "yearmonth"), ("2020-01-01", "year"), (None, None), (None, None), (None, None), ("1999-12-31", "date")]


def test_text_functions(spark):
    one = lambda c, v, typ="string": spark.createDataFrame([(v,)], f"s {typ}").select(c(F.col("s"))).first()[0]
    assert one(lambda c: t.word_wrap(c, 60.0, 10.0), "aa bb ccccccccccccc dd e") == ["aa bb", "ccccccccccccc", "dd e"]
    assert one(lambda c: t.fixed_chunks(c, 3), "abcdefgh") == ["abc", "def", "gh"]
    assert one(lambda c: t.fixed_chunks(c, 3), "") == []
    assert one(t.paragraphs, "a\n\n \n\nb ") == ["a", "b"]
    assert one(lambda c: t.parse_bilingual(t.format_bilingual(c, F.lit(" tr "))), "orig") == "tr"
    assert [round(spark.range(1).select(t.expansion_scale(F.lit(500), F.lit(n))).first()[0], 6) for n in (700, 1000, 600, 0)] == [0.9, 0.8, 1.0, 1.0]
    assert one(lambda c: t.salvage_json(c)[0], 'x {"language": "de", "confidence": 7} y') == "de"
    assert one(lambda c: t.salvage_json(c)[1], 'x {"language": "de", "confidence": 7} y') == 1.0


def test_translator_failures_keep_the_text(spark):
    def broken(texts):
        if (texts == "bad").any():
            raise ValueError("bad")
        return "[EN]" + texts

    df = spark.createDataFrame([("good",), ("bad",), ("good",), (" ",), (None,)], "s string")
    got = sorted(r.translated for r in textstats.translate_once(df, "s", broken).collect())
    assert got == ["", "", "[EN]good", "[EN]good", "bad"]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t95.5\tHi\n5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t5\tlow\nbroken\n")
    assert [tuple(r) for r in files.read_word_table(spark, str(tmp_path / "w.tsv")).collect()] == [(10, 20, 30, 40, 95.5, "Hi")]
    pages = spark.createDataFrame([("a\nb", "c"), (None, "d\n\ne")], "ocr_text string, translated_text string")
    files.write_bilingual(pages, str(tmp_path / "bi"))
    assert sorted(r.translation for r in files.read_bilingual(spark, str(tmp_path / "bi")).collect()) == ["c", "d\n\ne"]
    (tmp_path / "p.png").write_bytes(b"12345")
    assert [r.length for r in files.images(spark, str(tmp_path)).select("length").collect()] == [5]
    art = spark.createDataFrame([(1, 7, [("t", 1, 1)])], "project_id long, page_id long, tables array<struct<id:string,rows:int,cols:int>>")
    files.write_artifacts(art, str(tmp_path / "art"))
    assert files.read_artifacts(spark, str(tmp_path / "art")).first().tables[0].id == "t"


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 4} 00:00:0{i % 4}", i % 2, "ab"[(i // 2) % 2]) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").withColumn("ts", F.col("t").cast("timestamp"))
    df.select("event_id", "ts", "user_id", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    s = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "events.parquet"))
    out = status.rolled_up(status.run_once(status.running_state(s), str(tmp_path / "c1")))
    assert {(r.key, r.status, r.changes) for r in out.collect()} == {(0, "b", 4), (1, "b", 4)}
    w = status.run_once(status.windowed_counts(s), str(tmp_path / "c2"), "complete")
    assert sum(r.n for r in w.collect()) == 8
    assert {(r.old, r.new, r.n) for r in status.transitions(df, "user_id", "event_type", "ts", "event_id").collect()} == {("a", "b", 4), ("b", "a", 2)}
