"""Operators on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import analytics as A
from marlstone.operators import answers as N
from marlstone.operators import graph as G
from marlstone.operators import retrieval as R
from marlstone.operators import structure as S
from marlstone.sources import sinks
from marlstone.streaming import windows as T


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_bm25_filter_keeps_statistics(spark):
    docs = spark.createDataFrame([(1, "red fox", "a"), (2, "red red hen", "b"), (3, "blue hen", "b"), (4, "", "a"), (5, None, "a")], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(1, "red hen"), (2, "!!!"), (3, "fox fox")], "qid long, query string")
    every = {(r.qid, r.doc_id): r.score for r in R.bm25(docs, asked).collect()}
    some = {(r.qid, r.doc_id): r.score for r in R.bm25(docs, asked, keep=F.col("source") == "b").collect()}
    assert some and all(every[k] == v for k, v in some.items())
    assert {q for q, _ in every} == {1, 3}
    single = {(r.qid, r.doc_id): r.score for r in R.bm25(docs, asked.withColumn("query", F.regexp_replace("query", "fox fox", "fox"))).collect()}
    assert every[3, 1] == pytest.approx(2 * single[3, 1])


def test_title_only_hits(spark):
    docs = spark.createDataFrame([(1, "body words here", "fox"), (2, "other", "hen"), (3, "more", "x")], "doc_id long, text string, title string")
    asked = spark.createDataFrame([(1, "fox")], "qid long, query string")
    assert rows(R.bm25(docs, asked, title=F.col("title"))) == [(1, 1, 1.0)]


@pytest.mark.parametrize("given", [{}, {"keep": True}, {"title": True}, {"title": True, "keep": True}])
def test_best_of_blocks_is_the_best_of_all(spark, given):
    import random

    rng = random.Random(2)
    words = [*"fox hen Owl CAT dog ant2 the bee".split(), "\u00fcber", "x-ray", "\u212aelvin"]
    docs = spark.createDataFrame([(f"d{i}", None if i % 11 == 0 else " ".join(rng.choice(words) for _ in range(i % 9)), rng.choice("ab")) for i in range(300)], "doc_id string, text string, source string")
    asked = spark.createDataFrame([(1, "fox fox Ray"), (2, "the"), (3, None), (4, "zebra"), (5, "hen owl cat dog ant2 bee elvin ber")], "qid long, query string")
    given = {"keep": F.col("source") == "b"} | ({} if "keep" in given else {"keep": None}) | ({"title": F.col("source")} if "title" in given else {})
    want = R.top_k(R.bm25(docs, asked.unionByName(asked.selectExpr("qid + 10 AS qid", "concat(query, ' b') AS query")), **given), 7)
    got = R.bm25_top(docs, asked.unionByName(asked.selectExpr("qid + 10 AS qid", "concat(query, ' b') AS query")), 7, **given)
    order = ("qid", "rank", "doc_id", "score")
    assert rows(got.select(*order), "qid", "rank") == rows(want.select(*order), "qid", "rank") != []
    assert "Join" not in got._jdf.queryExecution().toString()


def test_best_of_blocks_without_documents_or_tokens(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some, asked = spark.createDataFrame([(1, "red"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "red")], "qid long, query string")
    assert R.bm25_top(none, asked, 3).count() == 0 and R.bm25_top(some, asked.limit(0), 3).count() == 0
    assert [r.doc_id for r in R.bm25_top(some, asked, 3).collect()] == [r.doc_id for r in R.top_k(R.bm25(some, asked), 3).collect()]
    heads = R.bm25_top(some, asked, 3, title=F.col("text"), head_list=True)
    assert {(r.method, r.doc_id, r["rank"]) for r in heads.collect()} >= {("head", 1, 1)}


def test_best_keeps_ties_by_id():
    import numpy as np
    import pyarrow as pa

    best = R._Best(2, 2)
    for ids, block in (([5, 4], [[1.0, -np.inf], [1.0, 0.5]]), ([3, 9], [[1.0, 2.0], [7.0, 0.5]])):
        best.add(np.array(block), pa.array(ids))
        best.cut()
    q, score, ids = best.cut()
    assert list(zip(q.tolist(), score.tolist(), ids.to_pylist(), strict=True)) == [(0, 7.0, 9), (0, 1.0, 3), (1, 2.0, 3), (1, 0.5, 4)]


def test_fusion_counts_first_rank_and_names_missing_methods(spark):
    hits = spark.createDataFrame([(1, "a", "bm25", 7, 1), (1, "a", "bm25", 7, 3), (1, "b", None, 7, 2), (1, "b", None, 8, 1)], "qid long, list_id string, method string, doc_id long, rank int")
    out = {r.doc_id: r for r in R.fuse(hits).collect()}
    assert out[7].rrf_score == pytest.approx(1 / 61 + 1 / 62) and out[7].methods == ["bm25", "missing_method"] and out[7].best_rank == 1
    assert R.fuse(hits.limit(0)).count() == 0


def test_promotion(spark):
    pool = spark.createDataFrame([(1, "x", "rrf", 0.2, 1), (1, "x", "fetch_figure", 0.9, 2), (1, "y", "structured_lookup", 0.1, 3), (1, "y", "rrf", 0.8, 4)], "qid long, doc_id string, method string, score double, ord int")
    assert rows(R.promote(pool), "doc_id") == [(1, "x", 1, "fetch_figure", 0.9), (1, "y", 3, "structured_lookup", 0.1)]


def test_pins_exceed_the_budget(spark):
    pool = spark.createDataFrame([(1, 1, "rrf"), (1, 2, "fetch_section"), (1, 3, "structured_lookup"), (1, 4, "rrf")], "qid long, ord int, method string")
    assert [(r.ord, r.place) for r in R.pin(pool, 1).orderBy("place").collect()] == [(3, 1), (2, 2)]
    assert [r.ord for r in R.pin(pool, 3).orderBy("place").collect()] == [3, 2, 1]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "fox hen", 1, "nothing", "a"), (1, "fox hen", 2, "fox and hen", "b"), (1, "fox hen", 3, " ", "c"), (2, " ", 1, "t", "d")], "qid long, query string, ord int, text string, method string")
    out = R.rerank_lexical(hits).orderBy("qid", "place").collect()
    assert [r.ord for r in out] == [2, 1, 3, 1] and out[0].rerank_score == 1.0 and out[2].rerank_score is None and out[3].rerank_score is None and out[0].prior_method == "b"


def test_greedy_budget_skips_and_goes_on(spark):
    chunks = spark.createDataFrame([(1, 1, 90), (1, 2, 50), (1, 3, 10), (2, 1, 200)], "qid long, place int, tok int")
    assert rows(R.greedy_budget(chunks, 100).select("qid", "place"), "qid", "place") == [(1, 1), (1, 3)]


def test_section_fetch(spark):
    c = spark.createDataFrame([("5.1", 1), ("5.10", 0), ("5.1.2", 0), ("5.1", 0)], "section_id string, chunk_index int")
    assert [(r.section_id, r.chunk_index) for r in R.section_fetch(c, "5.1.").collect()] == [("5.1", 0), ("5.1", 1), ("5.1.2", 0)]
    assert R.section_fetch(c, " ").count() == 0
    assert c.where(R.filters(section_prefix="5.1", chunk_index=None)).count() == 4


def test_cosine_without_norm(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "qid long, q array<float>")
    assert {r.vec_id: round(r.score, 6) for r in R.cosine_scores(v, q).collect()} == {1: 1.0, 3: 0.707107}


def test_chunks_cover_every_word(spark):
    text = "\n".join(" ".join(f"w{p}_{i}" for i in range(n)) for p, n in enumerate([100, 200, 80, 400, 5, 0, 30]))
    out = S.prose_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert [(r.first_word, r.n_words) for r in out] == [(0, 300), (263, 117), (343, 437), (743, 72)]
    words, seen = text.split(), []
    for r in out:
        seen += r.text.split()[len(seen) - r.first_word :]
    assert seen == words


def test_line_paragraphs(spark):
    line = [("s", "1", 1, 1, 0.0, 10.0, 1, "a"), ("s", "1", 1, 2, 12.0, 22.0, 1, "b"), ("s", "1", 1, 3, 40.0, 50.0, 1, "c"), ("s", "1", 2, 1, 0.0, 10.0, 1, "d")]
    df = spark.createDataFrame(line, "spec string, section_number string, page int, line_no int, y0 double, y1 double, block_no int, text string")
    assert [(r.text, r.pdf_page) for r in S.line_paragraphs(df).orderBy("para_idx").collect()] == [("a b", 1), ("c", 1), ("d", 2)]


def test_normative(spark):
    docs = spark.createDataFrame([(1, "It shall and may be so. Too short may. The marshall was not here."), (2, None)], "doc_id long, text string")
    assert rows(S.normative(docs).select("sent_idx", "strength")) == [(0, "shall")]


def test_normative_sorts_texts_out_first(spark):
    texts = ["He SHALL go  home now.\tYou may, or not, do it! a\u0001b shall c d\u0001 x", "nothing here at all", None, "", "  Marshalls may-be four words. shall be\t\nthree", "x shall y should z. it may\x0bbe so\x0cnow"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = S.normative(docs)
    assert rows(found, "doc_id", "sent_idx") == [
        (0, 0, "He SHALL go  home now.", "shall"), (0, 1, "You may, or not, do it!", "may"), (0, 3, "b shall c d", "shall"), (4, 0, "Marshalls may-be four words.", "may"), (5, 0, "x shall y should z.", "shall"), (5, 1, "it may\x0bbe so\x0cnow", "may")
    ]
    plan = found._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    assert plan.rfind("Contains(lower(text") > plan.find("Generate") > 0


def test_asof_ties_and_early_pages(spark):
    toc = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 9, "c")], "toc_ord int, target_page int, section_number string")
    pages = spark.createDataFrame([(1, 4), (2, 5), (3, 8), (4, 30), (5, None)], "id int, page int")
    assert rows(S.asof_page(pages, toc, "page").select("id", "section"), "id") == [(1, None), (2, "b"), (3, "b"), (4, "c"), (5, None)]


def test_intervals(spark):
    spans = spark.createDataFrame([("wide", 1, 0, 300), ("slim", 2, 90, 110), ("slim2", 3, 95, 115)], "span_id string, ord int, lo int, hi int")
    points = spark.createDataFrame([(1, 100), (2, 115), (3, 400)], "id int, p int")
    assert rows(S.interval_join(points, spans, "p").select("id", "span_id"), "id") == [(1, "slim"), (2, "slim2")]
    assert rows(S.interval_join(points, spans, "p", "last", True).select("id", "span_id"), "id") == [(1, "slim2"), (2, "wide")]


def test_intervals_leave_points_where_they_are(spark):
    spans = spark.createDataFrame([(f"s{i:02d}", i, i % 5 * 40, i % 5 * 40 + i * 7) for i in range(40)] + [("empty", 40, 5, 4)], "span_id string, ord int, lo int, hi int")
    given = spans.collect()
    points = spark.range(0, 420, 3).selectExpr("CAST(id / 2 AS int) AS p", "'same' AS x")
    for pick, half_open in (("narrowest", False), ("narrowest", True), ("last", False), ("last", True)):
        out = S.interval_join(points, spans, "p", pick, half_open)
        want = []
        for (p,) in points.select("p").collect():
            held = [s for s in given if s.lo <= p and (p < s.hi if half_open else p <= s.hi)]
            if held:
                want.append((p, "same", (min(held, key=lambda s: (s.hi - s.lo, s.ord)) if pick == "narrowest" else max(held, key=lambda s: s.ord)).span_id))
        assert sorted(rows(out)) == sorted(want)
        assert "__row" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("cells,n,out", [(["u", "v"], 4, ["u", "v", "", ""]), (list("uvxyz"), 3, ["u", "v", "x y z"]), (None, 3, ["", "", ""]), (["a"], 0, ["a"])])
def test_row_fitting(spark, cells, n, out):
    assert spark.createDataFrame([(cells, n)], "c array<string>, n int").select(S.fit_row(F.col("c"), F.col("n"))).first()[0] == out


def test_table_chunks(spark):
    t = spark.createDataFrame([(1, "cap", ["a", "b"], [[str(i), "x"] for i in range(60)]), (2, None, ["a"], []), (3, "c", ["a"], [["r"]] * 30)], "id int, caption string, headers array<string>, rows array<array<string>>")
    out = S.table_chunks(t).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.row_start, r.row_end) for r in out] == [(1, 0, 25), (1, 25, 50), (1, 50, 60), (2, 0, 0), (3, 0, 30)]
    assert out[1].text.startswith("cap\na | b\n---\n25 | x\n") and out[3].text == "a\n---"


def test_grid_building():
    head, body = S.build_grid([["Bits", "Type", "Description"], ["", "(R/W)", "more text"], ["7:4", "x", "y"], ["3", "z"], ["tail"], ["Band header line"], ["a", "b", "c"], ["d", "e", "f"]])
    assert head == ["Bits", "Type (R/W)", "Description more text"]
    assert body == [["7:4", "x", "y"], ["3", "", "z\ntail"], ["Band header line"], ["a", "b", "c"], ["d", "e", "f"]]
    assert S.build_grid([["Value", "Size"], ["(in bytes value)"], ["1h", "x"], ["2h", "y"]])[1] == [["1h", "x"], ["2h", "y"]]  # a piece of the header is no row
    assert S.build_grid([]) == ([], [])


def test_continuations(spark):
    s = spark.createDataFrame([("s", 1, None, "o", ["h"], [["0"]], "r0"), ("s", 2, "5", "cap", ["h"], [["1"]], "r1"), ("s", 3, None, None, ["h"], [["2"]], "r2"), ("s", 4, None, None, ["k"], [["3"]], "r3"), ("s", 5, "6", "d", ["h"], [], "r4")], "spec string, slice_ord int, figure_number string, caption string, headers array<string>, rows array<array<string>>, raw_text string")
    out = {r.figure_number: r for r in S.merge_continuations(s).collect()}
    assert out["5"].rows == [["1"], ["2"], ["k"], ["3"]] and out["5"].raw_text == "r1\nr2\nr3" and out["5"].orphan_attached and out[None].rows == [["0"]] and not out["6"].orphan_attached


def test_enum_merging(spark):
    t = spark.createDataFrame([(1, "fid", "198", "5.1", [["22h", "Power State"], ["broken"]]), (2, "fid", "403", "5.1", [["0x22", "power state"]]), (3, "lid", "7", "6", [["22h", "Log: pages"]])], "table_ord int, concept string, figure_number string, section string, rows array<array<string>>")
    out = {(r.concept, r.value): r for r in S.enum_entries(t).collect()}
    assert out["fid", 34].figures == ["198", "403"] and out["fid", 34].sections == ["5.1"] and out["fid", 34].name == "Power State" and out["lid", 34].name == "Log" and len(out) == 2


def test_fields_and_classes(spark):
    t = spark.createDataFrame([("3", ["Bits", "Description"], [["7:4", "Queue Size (MQES): the most."], ["3", "no name"]])], "figure_number string, headers array<string>, rows array<array<string>>")
    r = S.fields(t).first()
    assert (r.field_name, r.full_name, r.offset_type, r.off_lo, r.off_hi, r.description) == ("MQES", "Queue Size", "bits", 4, 7, "the most.")
    cases = [(["Bits", "Type", "Description"], "register"), (["Bits", "Description"], "command_format"), (["Bytes", "Admin", "Description"], "data_structure"), (["Value", "Meaning"], "other")]
    for headers, kind in cases:
        assert spark.createDataFrame([(headers,)], "h array<string>").select(S.table_class(F.col("h"))).first()[0] == kind


def test_numbering_and_parents(spark):
    new = spark.createDataFrame([("5", 1), ("5", 2), ("6", 1)], "parent string, ord int")
    taken = spark.createDataFrame([("5", 1), ("5", 3)], "parent string, n int")
    assert rows(S.numbered_children(new, taken).select("parent", "ord", "number"), "parent", "ord") == [("5", 1, "5.2"), ("5", 2, "5.4"), ("6", 1, "6.1")]
    toc = spark.createDataFrame([(1, "5.1.2", 7), (2, "5.1.3", 9), (3, "5", 1)], "toc_ord int, section_number string, target_page int")
    assert rows(S.with_missing_parents(toc)) == [("5.1", 7)]


def test_references_and_strength(spark):
    t = spark.createDataFrame([("section:1.1", "as defined in section 5.1.2, and Figure 12 or figure 3351; see Figure 4. Section 1.1")], "source string, text string")
    assert {(r.target, r.strength) for r in G.references(t).collect()} == {("section:5.1.2", "strong"), ("figure:12", "mention"), ("figure:4", "strong")}


def test_edges(spark):
    e = spark.createDataFrame([("a", "b", "t", "e1", None, 1), ("a", "b", "t", "e2", "strong", 2), ("a", "b", "t", "e3", "strong", 3)], "source string, target string, type string, evidence string, strength string, edge_ord int")
    assert rows(G.dedup_strength(e)) == [("a", "b", "t", "e2", "strong", 1)]
    nodes = spark.createDataFrame([("command", "The Read command", 1), ("command", "read", 2), ("command", "Read", 3)], "kind string, name string, ord int")
    assert rows(G.canonical_names(nodes)) == [("command", "read", "Read")]
    assert rows(G.aliases(nodes)) == [("command", "Read", ["The Read command", "read"])]
    raw = spark.createDataFrame([("command:read command", "section:5.1"), ("x", "section:9"), ("command:", "section:5.1")], "source string, target string")
    known = spark.createDataFrame([("5.1",)], "name string")
    assert rows(G.canonical_edges(raw, G.canonical_names(nodes), known)) == [("command:Read", "section:5.1")]


def test_eval_rules(spark):
    df = spark.createDataFrame([("x" * 30, ["5.1.2"], ["5.1"]), ("No information is here at all", ["5.10"], ["5.1"]), (None, [], [])], "a string, c array<string>, e array<string>")
    out = df.select(A.answer_present(F.col("a")), A.citation_hit(F.col("c"), F.col("e"))).collect()
    assert [tuple(r) for r in out] == [(True, True), (False, False), (False, False)]


def test_citations():
    known = [("5.1", "Scope"), ("5.2.1", "Queue, Depth"), ("5.2.3", "Z"), ("A.1", "Annex"), ("7", "Seven")]
    ids = lambda t: N.cited(t, known)
    assert ids("[5.1.] and [5.1]") == [("5.1", None, False)]
    assert ids("[5.1.9]") == [("5.1", "5.1.9", False)]
    assert ids("[5.2]") == [("5.2.1", "5.2", False)]
    assert ids("[5.1, Figure 3, A.1]") == [("5.1", None, False), ("A.1", None, False)]
    assert ids("[§Queue, Depth]") == [("5.2.1", "Queue, Depth", False)]
    assert ids("[9.9] but 9.8 and [A]") == [("9.9", None, True)]
    assert ids("Section 5.1 says") == [("5.1", None, False)]


def test_lookup_ranges(spark):
    fields = spark.createDataFrame([("CAP", 1, "3", "7:4", "d1", "bits"), ("CAP", 2, "4", "3:0", "d2", "bits"), ("CAP", 3, "5", "99", "d3", "bytes")], "field_name string, field_ord int, figure_number string, offset string, description string, offset_type string")
    asked = spark.createDataFrame([(1, "bits 5:6 of CAP", ["cap"]), (2, "what is CAP", ["CAP"]), (3, "none", ["ZZZ"])], "qid long, query string, names array<string>")
    out = N.structured_lookup(asked, fields)
    assert rows(out.where("qid = 1").select("figure_number"), "figure_number") == [("3",), ("5",)]
    assert out.where("qid = 2").count() == 3 and out.where("qid = 3").count() == 0


def test_fuzzy_names(spark):
    q = spark.createDataFrame([(1, "what is the controler memory bufer size"), (2, "unrelated words entirely")], "qid long, query string")
    n = spark.createDataFrame([("Controller Memory Buffer",), ("Memory",), ("Host Buffer Size",)], "name string")
    assert [(r.qid, r.name) for r in N.fuzzy_names(q, n).collect()] == [(1, "Controller Memory Buffer")]


def test_fuzzy_names_that_keep_no_piece(spark):
    q = spark.createDataFrame([(1, "a cd"), (2, "A cd!"), (3, "of abdeg hijklm too")], "qid long, query string")
    n = spark.createDataFrame([("a bcd",), ("abcdeg hijklm",), ("host buffer",)], "name string")
    assert rows(N.fuzzy_names(q, n), "qid") == [(1, "a bcd", 0.888889), (2, "a bcd", 0.888889), (3, "abcdeg hijklm", 0.96)]


def test_page_back_fill(spark):
    chunks = spark.createDataFrame([("5", 2, "s", [9]), ("5", 1, "s", [3, 4]), ("6", 1, "s", [1]), ("6", 1, "t", [2])], "section_id string, chunk_index int, spec string, pdf_pages array<int>")
    cites = spark.createDataFrame([(1, "5", []), (2, "5", [7]), (3, "6", []), (4, "9", None)], "qid long, section_id string, pdf_pages array<int>")
    assert {r.qid: r.pdf_pages for r in N.back_fill_pages(cites, chunks).collect()} == {1: [3, 4], 2: [7], 3: [], 4: None}


def test_refinement(spark):
    state = spark.createDataFrame([(1, "a", True, "", ["c"]), (2, "a", False, "Figure 3", ["c"]), (3, "a", False, "Figure 99", ["c"])], "qid long, answer string, answered boolean, missing string, context array<string>")
    fetch = lambda w: w.select("qid", F.expr("CASE WHEN array_contains(wanted, 'figure:3') THEN array('t3') ELSE array() END").cast("array<string>").alias("found"))
    regenerate = lambda c: c.select("qid", F.lit("b").alias("answer"), F.lit(True).alias("answered"), F.lit("").alias("missing"))
    out = {r.qid: (r.answer, r.outcome, r.passes) for r in N.refine(state, fetch, regenerate).collect()}
    assert out == {1: ("a", "converged", 0), 2: ("b", "converged", 1), 3: ("a", "stalled", 0)}


def test_sinks(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(sinks.replaced(old, spark.createDataFrame([("b", 9)], "k string, v int"), "k"), "k") == [("a", 1), ("b", 9)]
    assert sinks.first_filled([old.limit(0), None, old]).count() == 2
    ids = spark.createDataFrame([("x", "base"), ("x", "two"), ("two:x", "two"), ("y", None)], "id string, spec string")
    assert [r.id for r in sinks.scoped_ids(ids).collect()] == ["x", "two:x", "two:x", "y"]
    up = A.upserted(old, spark.createDataFrame([("b", 5), ("b", 7), ("c", 1)], "k string, v int"), ["k"], "v")
    assert rows(up, "k") == [("a", 1), ("b", 7), ("c", 1)]


def test_throttle(spark):
    assert [T.delay(n) for n in range(9)] == [0, 0, 1, 2, 5, 10, 30, 60, 60]
    f = spark.createDataFrame([(1, 1, 0), (1, 2, 10), (1, 3, 20), (1, 4, 330), (2, 5, 20)], "address long, id long, t long")
    assert [r.delay_s for r in T.throttle_batch(f).orderBy("id").collect()] == [0.0, 0.0, 1.0, 0.0, 0.0]


def test_trace_pages(spark):
    t = spark.createDataFrame([(1, 1, "generation"), (1, 2, "agentic.gap_analysis.iter0"), (1, 3, "agentic.followup_q0.iter1.hybrid"), (1, 4, "agentic.verdict_converged.iter2"), (1, 5, "agentic.cap_reached")], "request_id long, seq int, stage string")
    assert [(r.page, r.stage) for r in A.trace_pages(t).orderBy("seq").collect()] == [(0, "generation"), (0, "agentic.gap_analysis"), (1, "agentic.followup_q0.hybrid"), (1, "agentic.verdict_converged"), (1, "agentic.cap_reached")]


def test_table_chunks_of_rows(spark):
    given = [(k, i, [str(i), "x"] if i % 3 else [str(i), None, "y", "z"]) for k, n in (("long", 60), ("whole", 30), ("just", 31), ("one", 1)) for i in range(n)]
    rows_ = spark.createDataFrame(given, "k string, i int, cells array<string>")
    cap, heads = F.concat(F.lit("of "), "k"), F.array(F.lit("a"), F.lit("b"))
    tables = rows_.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "cells"))).alias("r")).select("k", cap.alias("caption"), heads.alias("headers"), F.transform("r", lambda x: x["cells"]).alias("rows"))
    got = S.table_row_chunks(rows_, "k", "i", cap, heads)
    assert rows(got.select("k", "chunk_index", "row_start", "row_end", "text"), "k", "chunk_index") == rows(S.table_chunks(tables).select("k", "chunk_index", "row_start", "row_end", "text"), "k", "chunk_index")
    assert [(r.k, r.row_end) for r in got.orderBy("k", "chunk_index").collect()] == [("just", 25), ("just", 31), ("long", 25), ("long", 50), ("long", 60), ("one", 1), ("whole", 30)]


def test_long_tables_are_cut_without_copies(spark):
    t = spark.range(1).select(F.lit("c").alias("caption"), F.array(F.lit("a")).alias("headers"), F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.array(F.concat(i.cast("string"), F.lit("x" * 50)))).alias("rows"))
    out = S.table_chunks(t)
    assert out.agg(F.count(F.lit(1)), F.max("row_end")).first()[:] == (2400, 60_000)


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_against_brute_force(spark, block):
    import random
    from math import sqrt

    rng = random.Random(1)
    given = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0, None, 0.0, 0.0]), (63, [1.0, 2.0])]
    vectors = spark.createDataFrame(given, "vec_id long, embedding array<float>")
    out = {(r.qid, r["rank"]): (r.vec_id, r.score) for r in R.nearest(vectors, vectors.selectExpr("vec_id AS qid", "embedding AS q"), 3, block).collect()}
    norm = lambda v: sqrt(sum(x * x for x in v))
    usable = [(i, v) for i, v in given if v and None not in v and norm(v)]
    want = {}
    for i, v in usable:
        scored = sorted((-round(sum(x * y for x, y in zip(v, w, strict=True)) / (norm(v) * norm(w)), 6), j) for j, w in usable if len(w) == len(v))
        want |= {(i, n): (j, -s) for n, (s, j) in enumerate(scored[:3], 1)}
    assert out == want


def test_nearest_shuffles_neither_pairs_nor_vectors(spark):
    v = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") % 7, F.col("id") % 3).cast("array<float>").alias("embedding"))
    many = R.nearest(v, v.selectExpr("concat('q', vec_id) AS qid", "embedding AS q"), 5, 16)
    plan = many._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Window" not in plan and plan.partition("== Physical Plan ==")[2].count("Exchange") == 1  # that of the queries
    best = {r.qid: r.vec_id for r in many.where("rank = 1").collect()}
    assert len(best) == 400 and all(best[f"q{i}"] == i % 21 for i in range(400))
    assert many.where("rank <= 5").count() == 2000


@pytest.mark.parametrize("name,keep", [("vector_topk", "true"), ("vector_topk_filtered", "label = 3")])
def test_every_vector_is_a_query(spark, sf_dir, name, keep):
    from marlstone.plans import catalogue
    from marlstone.session import table

    queries, v = catalogue.queries(), table(spark, sf_dir, "embeddings")
    whole = queries[f"{name}_all"](spark, sf_dir)
    assert whole.select("qid").distinct().count() == v.count() and whole.count() == v.count() * min(10, v.where(keep).count())
    assert rows(whole.where("qid < 10").select("qid", "vec_id", "score", "rank"), "qid", "rank") == rows(queries[name](spark, sf_dir).select("qid", "vec_id", "score", "rank"), "qid", "rank")


def test_structure_queries_take_whole_documents(spark, tmp_path):
    from marlstone.plans import catalogue

    texts = [(1, "abc one\nabc two\nabc three\nxyz four", "en"), (2, "Er sagt that so etwas hier.", "de")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {n: catalogue.queries()[n](spark, str(tmp_path)).collect() for n in ("definition_map_all", "normative_sentences_all", "normative_summary_all")}
    terms = {r.term: r.text for r in found["definition_map_all"]}
    assert terms["abc"] == "abc one abc two abc three" and terms["xyz"] == "xyz four"
    assert [(r.doc_id, r.strength) for r in found["normative_sentences_all"]] == [(2, "that")] and [(r.strength, r.n) for r in found["normative_summary_all"]] == [("that", 1)]
