from pyspark.sql import functions as F

from marlstone.operators import layout as L

LINE = "spec string, page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, bold boolean, size double"


def lines(spark, rows):
    return spark.createDataFrame([("s", p, n, 0.0, y, 10.0, y + 10, t, b, z) for p, n, y, t, b, z in rows], LINE)


def test_noise_and_headings(spark):
    df = lines(spark, [(1, 1, 50.0, "Base Specification 2", False, 9.0), (1, 2, 200.0, "12", False, 9.0), (1, 3, 210.0, "Figure 3: x", True, 10.0), (1, 4, 220.0, "5.1 Scope", True, 11.0), (1, 5, 230.0, "body", False, 9.0), (1, 6, 240.0, None, False, 9.0)])
    assert [r.line_no for r in df.where(~L.is_noise()).collect()] == [5]
    assert [r.line_no for r in L.heading_candidates(df).collect()] == [4]


def test_boxes(spark):
    df = lines(spark, [(1, 1, 0.0, "in", False, 9.0), (1, 2, 100.0, "out", False, 9.0), (2, 1, 0.0, "other page", False, 9.0)])
    box = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0)], "page int, bx0 double, by0 double, bx1 double, by1 double")
    assert {r.text for r in L.outside_boxes(df, box).collect()} == {"out", "other page"}
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 10.0, 10.0, 50.0, 50.0), (1, 3, 20.0, 20.0, 30.0, 30.0), (1, 4, 20.0, 20.0, 30.0, 30.0), (2, 5, 0.0, 0.0, 1.0, 1.0)], "page int, box_id int, x0 double, y0 double, x1 double, y1 double")
    assert {r.box_id: r.parent for r in L.containment(b).collect()} == {1: None, 2: 1, 3: 2, 4: 2, 5: None}


def test_captions(spark):
    t = spark.createDataFrame([(1, 1, 100.0), (1, 2, 300.0), (2, 3, 100.0)], "page int, table_id int, top double")
    b = spark.createDataFrame([(1, 90.0, "Figure 7: near"), (1, 40.0, "Figure 6: far"), (1, 310.0, "Figure 9: below")], "page int, y1 double, text string")
    assert {r.table_id: r.figure_number for r in L.captions(t, b).collect()} == {1: 7, 2: None, 3: None}


def test_outline_and_deep_sections(spark):
    marks = spark.createDataFrame([(1, 1, "5 Scope", 9), (2, 2, "5.1.2 Deep One", 10), (3, 1, "Annex B. Extra", 50), (4, 1, "Contents", 2)], "toc_ord int, level int, title string, page int")
    assert [(r.section_number, r.title, r.target_page) for r in L.outline(marks, 2).orderBy("toc_ord").collect()] == [("5", "Scope", 7), ("5.1.2", "Deep One", 8), ("B", "Extra", 48)]
    df = lines(spark, [(1, 1, 0.0, "5.1.2.3", True, 10.0), (1, 2, 20.0, "The Title", True, 10.0), (1, 3, 40.0, "5.1.2.4 Other", True, 10.0), (1, 4, 60.0, "5.1.2.5 plain", False, 10.0)])
    assert [(r.section_number, r.title) for r in L.deep_sections(df).orderBy("line_no").collect()] == [("5.1.2.3", "The Title"), ("5.1.2.4", "Other")]


def test_heading_match(spark):
    toc = spark.createDataFrame([("s", 1, "5", "Scope", 3), ("s", 2, "5.1", "Scope of Queues", 3), ("s", 3, "6", "Missing", 4)], "spec string, toc_ord int, section_number string, title string, target_page int")
    body = lines(spark, [(2, 1, 0.0, "Scope", True, 10.0), (3, 1, 0.0, "5.1 Scope", True, 10.0), (3, 2, 20.0, "of Queues", True, 10.0), (9, 1, 0.0, "Missing", True, 10.0)])
    found = L.find_headings(toc, body)
    assert [(r.toc_ord, r.page, r.line_no) for r in found.orderBy("toc_ord").collect()] == [(1, 2, 1), (2, 3, 1), (3, None, None)]
    assert [r.end_page for r in L.section_ends(found, 20).orderBy("toc_ord").collect()] == [3, 20, None]


def test_cards(spark):
    toc = spark.createDataFrame([("5", "Five", 1), ("5.2", "b", 2), ("5.10", "a", 2), ("7.1", "orphan", 2)], "section_number string, title string, level int")
    out = {r.section_number: r for r in L.cards(toc, spark.createDataFrame([("5", "3")], "section_number string, figure_number string"), spark.createDataFrame([("5.2",), ("5.2",)], "section_number string"), spark.createDataFrame([("section:5", 1), ("section:5", 1)], "node string, edge_ord long"), spark.createDataFrame([("5", "sum")], "section_number string, summary string")).collect()}
    assert out["5"].child_sections == ["5.2", "5.10"] and out["5"].tables == ["3"] and out["5"].edges == [1, 1] and out["5.2"].normative_count == 2 and out["5.2"].parent_section == "5" and out["7.1"].parent_section is None
    assert spark.range(1).select(L.card_prefix(F.lit("5"), F.lit("T"), F.lit("s")).alias("a"), L.card_prefix(F.lit("5"), F.lit("T"), F.lit(" ")).alias("b")).first() == ("[5 — T] s", "")


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "", "queues are near depth"), (2, "", "queue far far far far depth"), (3, "queue depth", ""), (4, "", "queue only")], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(1, "queue depths"), (2, "the")], "qid long, query string")
    assert [r.doc_id for r in L.full_text(docs, asked).orderBy("rank").collect()] == [3, 1, 2]
