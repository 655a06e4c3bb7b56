"""Queries of question analysis, lookup, citations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import queries as Q
from marlstone.operators import answers as A
from marlstone.session import table
from marlstone.streaming import windows as S


def _questions(spark, sf_dir):
    """Questions that name parts of the star schema in the ways that people write them."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("How do FID 0x"), size, F.lit(" and fid "), size, F.lit("h interact with Figure "), key, F.lit("?")))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("Steps to set opcode "), size, F.lit("h in section "), size, F.lit(".2.1 each")))
        .when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("describe the layout of "), "p_name"))
        .when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("Status code 0x"), size, F.lit(" meaning, see fig. 7 and MQES")))
        .otherwise(F.concat(F.lit("value 1"), size, F.lit("h")))
    )
    return p.select(F.col("p_partkey").alias("qid"), text.alias("query"))


def entity_extract(spark, sf_dir):
    found = _questions(spark, sf_dir).select("qid", F.posexplode(Q.entities(F.col("query"), F.array(F.lit("MQES"), F.lit("CAP")))).alias("pos", "e"))
    return found.select("qid", "pos", "e.kind", "e.text")


def classify_heuristic(spark, sf_dir):
    each = _questions(spark, sf_dir).withColumn("es", Q.entities(F.col("query"), F.array(F.lit("MQES"), F.lit("CAP"))))
    return each.select("qid", Q.question_type(F.col("query"), F.col("es")).alias("kind"), Q.looks_up(F.col("es")).alias("looks_up"))


def subquery_clean(spark, sf_dir):
    """Lines of user turns as sub-queries."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", Q.clean_subqueries(F.col("text"), F.split("text", r"\n|\. "), F.lit("relational")).alias("subs"))


def missing_resources(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Figures 0"), F.col("o_custkey").cast("string"), F.lit("/12, 13 and 7 layouts ("), F.col("o_orderstatus"), F.lit(".2.1) and "), F.col("o_orderkey").cast("string"), F.lit(".5"))
    r = Q.resources(F.when(F.col("o_orderstatus") != "P", text))
    return o.select("o_orderkey", r["figures"].alias("figures"), r["sections"].alias("sections"))


def verdict_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 4 == 0, F.lit('\n@@VERDICT@@{"answered": true, "missing": ""}')).when(F.col("doc_id") % 4 == 1, F.lit(' @@VERDICT@@{"answered": false, "context_has_answer": true, "missing": "Figure 3"}')).when(F.col("doc_id") % 4 == 2, F.lit("@@VERDICT@@{broken")).otherwise(F.lit(""))
    v = Q.split_verdict(F.concat(F.col("source"), tail))
    return docs.select("doc_id", v["answer"].alias("answer"), v["verdict"]["answered"].alias("answered"), v["verdict"]["context_has_answer"].alias("has"), v["verdict"]["missing"].alias("missing"))


def fuzzy_name_match(spark, sf_dir):
    """Part names that users' questions, names with letters lost, resemble."""
    part = table(spark, sf_dir, "part")
    asked = part.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("what is "), F.regexp_replace("p_name", "o", ""), F.lit(" for")).alias("query"))
    return A.fuzzy_names(asked, part.select(F.col("p_type").alias("name")).union(part.select(F.col("p_name").alias("name"))))


def structured_lookup(spark, sf_dir):
    """Lookups of brands among parts, with bit ranges in the question."""
    p = table(spark, sf_dir, "part")
    fields = p.select(F.upper("p_type").alias("field_name"), F.col("p_partkey").alias("field_ord"), F.col("p_size").cast("string").alias("figure_number"), F.concat_ws(":", F.col("p_size").cast("string"), (F.col("p_size") - 3).cast("string")).alias("offset"), F.col("p_brand").alias("description"), F.lit("bits").alias("offset_type"))
    asked = p.groupBy("p_type").agg(F.min("p_partkey").alias("qid")).select("qid", F.concat(F.lit("bits 9:7 of "), "p_type").alias("query"), F.array("p_type").alias("names"))
    return A.structured_lookup(asked, fields)


def citation_resolve(spark, sf_dir):
    """Page titles cited in brackets and ids in prose, resolved among the page's sections."""
    pages = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))
    sections = F.array(F.struct(F.lit("5.1").alias("id"), F.lit("Scope").alias("title")), F.struct(F.concat(F.lit("7."), F.col("page_id").cast("string")).alias("id"), F.col("title").alias("title")))
    answer = F.concat(F.lit("See [5.1.2] and Section 7."), F.col("page_id").cast("string"), F.lit(", also [§9.9]."))
    return A.citations(pages.select(F.col("page_id").alias("qid"), answer.alias("answer"), sections.alias("sections")))


def page_back_fill(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    chunks = li.select(F.col("l_suppkey").cast("string").alias("section_id"), F.struct("l_orderkey", "l_linenumber").alias("chunk_index"), F.col("l_returnflag").alias("spec"), F.when(F.col("l_linenumber") > 1, F.array("l_linenumber")).otherwise(F.array().cast("array<int>")).alias("pdf_pages"))
    only = chunks.where("spec = 'N'")
    cites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_suppkey").cast("string").alias("section_id"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("pdf_pages"))
    return A.back_fill_pages(cites, only)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, sf_dir):
    """A stream of the events table, which is one file, or a folder of them."""
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    is_file = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if is_file else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling(spark, sf_dir):
    return S.run_once(S.tumbling(_stream(spark, sf_dir)))


def stream_session(spark, sf_dir):
    return S.run_once(S.sessions(_stream(spark, sf_dir)))


def stream_dedup(spark, sf_dir):
    return S.run_once(S.without_duplicates(_stream(spark, sf_dir), ["event_id"]).select("event_id", "user_id"), "append")


def throttle_delay(spark, sf_dir):
    """Waits of users, every event a failure, timed a hundred times as fast."""
    ev = _stream(spark, sf_dir).select(F.col("user_id").alias("address"), F.col("event_id").alias("id"), F.floor(F.unix_seconds("ts") / 100).cast("long").alias("t"))
    return S.run_once(S.throttle_stream(ev), "append")


QUERIES = {f.__name__: f for f in (entity_extract, classify_heuristic, subquery_clean, missing_resources, verdict_split, fuzzy_name_match, structured_lookup, citation_resolve, page_back_fill, stream_tumbling, stream_session, stream_dedup, throttle_delay)}
_Q = """q AS (SELECT p_partkey AS qid, p_partkey % 5 AS m, p_size::VARCHAR AS s, p_partkey::VARCHAR AS k FROM part)"""
_E = f"""{_Q},
e AS (
  SELECT qid, 0 AS pos, 'fid' AS kind, '0x' || s AS text FROM q WHERE m = 0
  UNION ALL SELECT qid, 1, 'fid', s || 'h' FROM q WHERE m = 0
  UNION ALL SELECT qid, 2, 'figure', k FROM q WHERE m = 0 AND length(k) <= 4
  UNION ALL SELECT qid, 0, 'opcode', s || 'h' FROM q WHERE m = 1
  UNION ALL SELECT qid, 1, 'section', s || '.2.1' FROM q WHERE m = 1
  UNION ALL SELECT qid, 0, 'status', '0x' || s FROM q WHERE m = 3
  UNION ALL SELECT qid, 1, 'figure', '7' FROM q WHERE m = 3
  UNION ALL SELECT qid, 2, 'field', 'MQES' FROM q WHERE m = 3
  UNION ALL SELECT qid, 0, 'hex', '1' || s || 'h' FROM q WHERE m = 4)"""
ORACLE = {
    "entity_extract": f"WITH {_E} SELECT qid, pos::INTEGER AS pos, kind, text FROM e",
    "classify_heuristic": f"WITH {_Q} SELECT qid, ['relational', 'procedural', 'structural', 'relational', 'lookup'][m + 1] AS kind, m <> 2 AS looks_up FROM q",
    "subquery_clean": r"WITH a AS (SELECT conv_id, turn, text, list_filter(list_transform(regexp_split_to_array(text, '\n|\. '), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: length(s) BETWEEN 3 AND 400) AS s FROM conversations WHERE role = 'user'), b AS (SELECT *, list_filter(s, lambda x, i: list_position(list_transform(s, lambda y: lower(y)), lower(x)) = i)[1:3] AS o FROM a) SELECT conv_id, turn, CASE WHEN len(o) = 0 THEN [text] ELSE o END AS subs FROM b",
    "missing_resources": "WITH f AS (SELECT *, CASE WHEN length(o_custkey::VARCHAR) <= 3 THEN [o_custkey::VARCHAR, '12', '13', '7'] ELSE [substr(o_custkey::VARCHAR, 1, 3)] END AS f FROM orders) SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN []::VARCHAR[] ELSE list_filter(f, lambda x, i: list_position(f, x) = i) END AS figures, CASE WHEN o_orderstatus = 'P' THEN []::VARCHAR[] ELSE [o_orderstatus || '.2.1', o_orderkey || '.5'] END AS sections FROM f",
    "verdict_split": "SELECT doc_id, source AS answer, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS answered, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true END AS has, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Figure 3' END AS missing FROM documents",
    "page_back_fill": "WITH p AS (SELECT l_suppkey, arg_min([l_linenumber], l_orderkey * 10 + l_linenumber) AS p FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber > 1 GROUP BY 1) SELECT s_suppkey AS qid, s_suppkey::VARCHAR AS section_id, CASE WHEN s_suppkey % 2 = 0 THEN [0] ELSE coalesce(p, []::INTEGER[]) END AS pdf_pages FROM supplier LEFT JOIN p ON l_suppkey = s_suppkey",
    "stream_tumbling": "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_session": "WITH a AS (SELECT user_id, epoch_us(ts) AS us FROM events), b AS (SELECT *, CASE WHEN us - lag(us) OVER w > 21600000000 THEN 1 ELSE 0 END AS f FROM a WINDOW w AS (PARTITION BY user_id ORDER BY us)), c AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM b) SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n FROM c GROUP BY user_id, s",
    "stream_dedup": "SELECT event_id, user_id FROM events",
    "throttle_delay": "WITH f AS (SELECT user_id AS address, event_id AS id, floor(epoch(ts) / 100)::BIGINT AS t FROM events), c AS (SELECT a.address, a.id, a.t, count(b.id) AS n FROM f a LEFT JOIN f b ON a.address = b.address AND b.t < a.t AND b.t >= a.t - 300 GROUP BY ALL) SELECT address, id, t, [0, 0, 1, 2, 5, 10, 30, 60][least(n, 7) + 1]::DOUBLE AS delay_s FROM c",
}
