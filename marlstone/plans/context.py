"""Queries of context helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import context as C
from marlstone.operators import structure as S
from marlstone.plans import structure as P
from marlstone.session import table


def table_trim(spark, sf_dir):
    """Tables of brands within 200 tokens."""
    return P.table_serialize(spark, sf_dir).select("p_brand", C.trimmed_table(F.col("text"), 200).alias("text"))


def cited_figures(spark, sf_dir):
    """Suppliers' first lines as figures that a text names."""
    li = table(spark, sf_dir, "lineitem")
    answers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.lit("see Figures 01, 3 and fig. 5").alias("answer"))
    sources = li.select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").cast("string").alias("figure_number"), F.when(F.col("l_returnflag") != "A", F.col("l_suppkey")).alias("pdf_page"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    return C.cited_figures(answers, sources)


def seeded_sample(spark, sf_dir):
    return C.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 25, 7)


def allocation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("weight"))
    return C.allocation(d, 60)


def keyword_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.keyword_score(F.col("text"), ["the", "und", "que", "licen"]).alias("score"))


def embedding_cost(spark, sf_dir):
    return C.embedding_cost(table(spark, sf_dir, "documents"))


def corpus_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.audit(S.paragraphs(docs).join(docs.select("doc_id", "lang"), "doc_id"), "lang")


QUERIES = {f.__name__: f for f in (table_trim, cited_figures, seeded_sample, allocation, keyword_scores, embedding_cost, corpus_audit)}
_WC = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
ORACLE = {
    "table_trim": f"WITH {P._GRIDS}, h AS (SELECT p_brand, lines, array_to_string(['Parts of ' || p_brand, 'Name | Type | Size', '---'], chr(10)) AS head FROM g), u AS (SELECT *, list_reduce(list_transform(lines, lambda x: greatest(1, length(x) // 4)::INTEGER), lambda s, x: CASE WHEN s.used + x <= 200 AND s.open = 1 THEN {{'used': (s.used + x)::INTEGER, 'n': (s.n + 1)::INTEGER, 'open': 1}} ELSE {{'used': s.used::INTEGER, 'n': s.n::INTEGER, 'open': 0}} END, {{'used': greatest(1, length(head) // 4)::INTEGER, 'n': 0::INTEGER, 'open': 1}}).n AS k FROM h) SELECT p_brand, CASE WHEN greatest(1, length(head || chr(10) || array_to_string(lines, chr(10))) // 4) <= 200 OR k >= len(lines) THEN head || chr(10) || array_to_string(lines, chr(10)) ELSE array_to_string([head] || lines[1:k] || ['[more rows]'], chr(10)) END AS text FROM u",
    "cited_figures": "SELECT l_orderkey AS qid, l_linenumber::VARCHAR AS figure, arg_min(l_suppkey, (l_partkey, l_suppkey)) AS pdf_page FROM lineitem WHERE l_linenumber IN (1, 3, 5) AND l_returnflag <> 'A' GROUP BY ALL",
    "seeded_sample": "SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 25",
    "allocation": "WITH d AS (SELECT lang AS kind, count(*) AS weight FROM documents GROUP BY 1) SELECT kind, weight, greatest(1, round_even(weight * 60 / sum(weight) OVER ()::DOUBLE, 0)::INTEGER) AS n FROM d",
    "keyword_scores": "SELECT doc_id, (contains(lower(text), 'the')::INTEGER + contains(lower(text), 'und')::INTEGER + contains(lower(text), 'que')::INTEGER + contains(lower(text), 'licen')::INTEGER) AS score FROM documents",
    "embedding_cost": f"SELECT sum(w)::BIGINT AS words, floor(sum(w) / 0.75::DOUBLE)::BIGINT AS tokens, round(sum(w) / 0.75::DOUBLE / 1e6 * 0.02, 9) AS cost FROM (SELECT {_WC} AS w FROM documents)",
    "corpus_audit": f"WITH p AS (SELECT lang, unnest({P._PARAS}) AS text FROM documents), q AS (SELECT *, {_WC} AS w FROM p) SELECT lang, count(*) AS n, count_if(w = 0)::BIGINT AS \"empty\", count_if(w > 0 AND w < 4)::BIGINT AS short, count_if(regexp_matches(lower(text), '(^|[^a-z])not($|[^a-z])'))::BIGINT AS negated, round(avg(w), 6) AS mean_words FROM q GROUP BY lang",
}
