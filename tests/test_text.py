import pytest
from pyspark.sql import functions as F

from marlstone.functions import queries as Q
from marlstone.functions import text as X


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_tokens_drop_stop_words_and_case(spark):
    assert one(spark, "The Read-Command IS set, of 12h", X.tokens(F.col("x"))) == ["read", "command", "set", "12h"]
    assert one(spark, None, X.tokens(F.col("x"))) == []
    assert len(X.STOP_WORDS) == 125


@pytest.mark.parametrize("text,value", [("22", 34), ("22h", 34), ("0x22", 34), ("0X0d", 13), ("c0", 192), ("each", 0xEAC), ("teach", None), ("", None), (None, None)])
def test_hex_values(spark, text, value):
    assert one(spark, text, X.hex_value(F.col("x"))) == value


@pytest.mark.parametrize("cell,value", [("17h", 23), ("0x17", 23), ("1.4.2", None), ("words", None), ("17", None), (None, None)])
def test_cell_values(spark, cell, value):
    assert one(spark, cell, X.cell_value(F.col("x"))) == value


@pytest.mark.parametrize("value,text", [(2, "02h"), (192, "C0h"), (4096, "1000h")])
def test_value_hex(spark, value, text):
    assert one(spark, value, X.value_hex(F.col("x")), "long") == text


@pytest.mark.parametrize("offset,bounds", [("3", (3, 3)), ("7:4", (4, 7)), ("15 to 08", (8, 15)), ("03h:00h", (0, 3)), ("reserved", (None, None)), ("variable", (None, None)), ("", (None, None)), (None, (None, None)), ("Bits", (None, None))])
def test_offset_bounds(spark, offset, bounds):
    assert tuple(one(spark, offset, X.offset_bounds(F.col("x")))) == bounds


def test_word_counts(spark):
    assert one(spark, "  a b\n c ", X.word_count(F.col("x"))) == 3
    assert one(spark, "   ", X.word_count(F.col("x"))) == 0
    assert one(spark, "abcdefgh", X.context_tokens(F.col("x"))) == 2


def test_dotted_ids(spark):
    assert one(spark, "A.1.12", X.ancestors(F.col("x"))) == ["A", "A.1", "A.1.12"]
    assert one(spark, "5.1", X.parent(F.col("x"))) == "5"
    assert one(spark, "5", X.parent(F.col("x"))) is None
    rows = spark.createDataFrame([("5.10",), ("5.9",), ("A.1",), ("5",)], "x string").orderBy(X.natural_key(F.col("x"))).collect()
    assert [r.x for r in rows] == ["5", "5.9", "5.10", "A.1"]


def test_truncation_keeps_words(spark):
    assert one(spark, "aaa  bbb ccc", X.truncated(F.col("x"), 8)) == "aaa bbb…" or one(spark, "aaa  bbb ccc", X.truncated(F.col("x"), 8)) == "aaa…"
    assert one(spark, "short", X.truncated(F.col("x"))) == "short"


def kinds(spark, query, known=("MQES", "CAP")):
    return [(e["kind"], e["text"]) for e in one(spark, query, Q.entities(F.col("x"), F.array(*map(F.lit, known))))]


def test_entities(spark):
    assert kinds(spark, "FID 17h and FID 0x0D") == [("fid", "17h"), ("fid", "0x0D")]
    assert kinds(spark, "FID c0") == [("fid", "c0")] and kinds(spark, "FID2") == [("fid", "2")]
    assert kinds(spark, "status be careful, each beach") == []
    assert kinds(spark, "CAP.MQES of fig. 12 in section 5.1.2") == [("figure", "12"), ("section", "5.1.2"), ("field", "CAP"), ("field", "MQES")]
    assert kinds(spark, "Fig 3 and figure 3") == [("figure", "3")]
    assert kinds(spark, None) == []


@pytest.mark.parametrize("query,kind", [("what does CAP hold", "lookup"), ("FID 1 and LID 2", "relational"), ("steps to begin", "procedural"), ("describe it", "structural"), ("hm", "structural")])
def test_types(spark, query, kind):
    found = Q.entities(F.col("x"), F.array(F.lit("CAP")))
    assert one(spark, query, Q.question_type(F.col("x"), found)) == kind


def test_subqueries(spark):
    df = spark.createDataFrame([("q", ["A  b", "a b", "x", "ccc", "ddd", "eee"])], "q string, s array<string>")
    out = df.select(Q.clean_subqueries(F.col("q"), F.col("s"), F.lit("relational")), Q.clean_subqueries(F.col("q"), F.col("s"), F.lit("lookup"))).first()
    assert out[0] == ["A b", "ccc", "ddd"] and out[1] == ["q"]


def test_resources(spark):
    r = one(spark, "Figures 630/031, 632 and 7; (8.1.6.4) and B.2.1", Q.resources(F.col("x")))
    assert r["figures"] == ["630", "31", "632", "7"] and r["sections"] == ["8.1.6.4", "B.2.1"]
    empty = one(spark, None, Q.resources(F.col("x")))
    assert empty["figures"] == [] and empty["sections"] == []


def test_verdicts(spark):
    cut = lambda t: one(spark, t, Q.split_verdict(F.col("x")))
    good = cut('Yes.\n@@VERDICT@@{"answered": true}')
    assert good["answer"] == "Yes." and tuple(good["verdict"]) == (True, True, "")
    assert cut("Yes.")["answer"] == "Yes." and cut("Yes.")["verdict"] is None
    bad = cut("Yes. @@VERDICT@@{oops")
    assert bad["answer"] == "Yes." and bad["verdict"] is None
    assert cut(None)["answer"] is None


def test_hallucinated(spark):
    df = spark.createDataFrame([([("5.1", True), ("A.2", True), ("fig 3", True), ("6.1", False), ("5.1", True)],)], "c array<struct<section_id string, hallucinated boolean>>")
    assert df.select(Q.hallucinated_ids(F.col("c"))).first()[0] == ["5.1", "A.2"]
