"""Queries of ranked retrieval over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import retrieval as R
from marlstone.session import materialize, table

_TOK = X.tokens_sql("text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def bm25_topk(spark, sf_dir):
    return R.bm25_top(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 10)


def bm25_filtered_global_stats(spark, sf_dir):
    return R.bm25_top(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 10, keep=F.col("source") == "src3")


def bm25_title_bonus(spark, sf_dir):
    return R.bm25_top(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 10, title=F.substring_index("text", "\n", 1))


def _bm25_sql(title: bool = False, keep: str = "true") -> str:
    extra = f"""
, h AS (SELECT doc_id, unnest(list_distinct({X.tokens_sql("split_part(text, chr(10), 1)")})) AS t FROM documents),
e AS (SELECT qid, doc_id, count(*)::DOUBLE AS score FROM h JOIN a USING (t) GROUP BY ALL),
r AS (SELECT qid, doc_id, sum(score) AS score FROM (SELECT * FROM r0 UNION ALL SELECT * FROM e) GROUP BY ALL)""" if title else ", r AS (SELECT * FROM r0)"
    return f"""
WITH d AS (SELECT doc_id, source, {_TOK} AS ts FROM documents),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
p AS (SELECT doc_id, dl, t, count(*) AS f FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
i AS (SELECT t, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM w) ELSE raw END AS idf FROM w),
a AS (SELECT qid, t, count(*) AS times FROM (SELECT item_id AS qid, unnest({_TOK}) AS t FROM benchmark) GROUP BY ALL),
r0 AS (SELECT qid, doc_id, sum(times * idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
       FROM p JOIN a USING (t) JOIN i USING (t), s GROUP BY ALL){extra},
k AS (SELECT qid, r.doc_id, round(score, 6) AS score FROM r JOIN d ON d.doc_id = r.doc_id WHERE abs(score) > 1e-9 AND {keep})
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank
FROM k QUALIFY rank <= 10
"""


def token_stats(spark, sf_dir):
    """Document and collection frequency of every token."""
    return R.postings(table(spark, sf_dir, "documents")).groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.sum("f").alias("cf"))


def doc_length_stats(spark, sf_dir):
    """Token counts of documents by language: mean, median, extremes."""
    each = table(spark, sf_dir, "documents").select("lang", F.size(X.tokens(F.col("text"))).alias("dl"))
    return each.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("mean"), F.median("dl").alias("median"), F.min("dl").alias("least"), F.max("dl").alias("most"))


def _vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id < 10").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def vector_topk(spark, sf_dir):
    """Ten nearest vectors of each of ten query vectors."""
    return R.top_k(R.cosine_scores(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir)), 10, tie="vec_id")


def vector_topk_filtered(spark, sf_dir):
    return R.top_k(R.cosine_scores(table(spark, sf_dir, "embeddings").where(R.filters(label=3)), _vector_queries(spark, sf_dir)), 10, tie="vec_id")


def _every_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def vector_topk_all(spark, sf_dir):
    """Ten nearest vectors of every vector."""
    return R.nearest(table(spark, sf_dir, "embeddings"), _every_vector(spark, sf_dir), 10)


def vector_topk_filtered_all(spark, sf_dir):
    """Ten nearest vectors of label 3 of every vector."""
    return R.nearest(table(spark, sf_dir, "embeddings").where(R.filters(label=3)), _every_vector(spark, sf_dir), 10)


def _vector_sql(keep: str) -> str:
    dot = "list_reduce(list_transform(list_zip(v, q), lambda p: p[1] * p[2]), lambda a, b: a + b)"
    norm = lambda c: f"sqrt(list_reduce(list_transform({c}, lambda x: x * x), lambda a, b: a + b))"
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {keep}),
q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 10),
s AS (SELECT qid, vec_id, round({dot} / ({norm("v")} * {norm("q")}), 6) AS score FROM v, q)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10
"""


def _overlap_lists(spark, sf_dir):
    """Two ranked lists per query: BM25, and the share of the query's tokens that a document's first line holds."""
    lists = R.bm25_top(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 20, title=F.substring_index("text", "\n", 1), head_list=True)
    return materialize(lists, "ranked")


_LISTS = f"""
l1 AS (SELECT qid, doc_id, score, rank, 'bm25' AS method FROM ({_bm25_sql().replace("rank <= 10", "rank <= 20")})),
h2 AS (SELECT doc_id, unnest(list_distinct({X.tokens_sql("split_part(text, chr(10), 1)")})) AS t FROM documents),
w2 AS (SELECT item_id AS qid, unnest(list_distinct({_TOK})) AS t FROM benchmark),
s2 AS (SELECT qid, doc_id, count(*)::DOUBLE AS score FROM h2 JOIN w2 USING (t) GROUP BY ALL),
l2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank, 'head' AS method FROM s2 QUALIFY rank <= 20),
l AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""


def rrf_fuse(spark, sf_dir):
    fused = R.fuse(_overlap_lists(spark, sf_dir).withColumn("list_id", F.col("method")))
    return R.top_k(fused.withColumnRenamed("rrf_score", "score"), 20, digits=9)


def hybrid_multi_query(spark, sf_dir):
    """Sub-queries are the lines of a query, the whole one first; each gives its own list, all fused in one job."""
    docs, asked = table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    parts = asked.select("qid", F.posexplode(F.array_distinct(F.concat(F.array(F.trim("query")), F.transform(F.split("query", "\n"), lambda x: F.trim(x))))).alias("no", "query"))
    keyed = parts.where(R.has_letters(F.col("query"))).select(F.concat_ws("/", "qid", "no").alias("qid"), "query")
    lists = R.bm25_top(docs, keyed, 5)
    hits = lists.select(F.substring_index("qid", "/", 1).cast("long").alias("qid"), F.col("qid").alias("list_id"), F.lit("bm25").alias("method"), "doc_id", "rank")
    return R.top_k(R.fuse(hits).withColumnRenamed("rrf_score", "score"), 10, digits=9)


def _pool(spark, sf_dir):
    """A pool in arrival order with repeated documents and pinnable methods among them."""
    lists = _overlap_lists(spark, sf_dir)
    w = W.partitionBy("qid").orderBy("method", "rank")
    pinned = F.when((F.col("method") == "head") & (F.col("rank") % 5 == 1), F.lit("structured_lookup")).when((F.col("method") == "head") & (F.col("rank") % 5 == 2), F.lit("fetch_section")).otherwise(F.col("method"))
    return lists.select("qid", "doc_id", "score", pinned.alias("method"), F.row_number().over(w).alias("ord"))


_POOL = f"""{_LISTS},
pool AS (SELECT qid, doc_id, score, CASE WHEN method = 'head' AND rank % 5 = 1 THEN 'structured_lookup' WHEN method = 'head' AND rank % 5 = 2 THEN 'fetch_section' ELSE method END AS method,
         row_number() OVER (PARTITION BY qid ORDER BY method, rank)::INTEGER AS ord FROM l)"""
_PINS = "('structured_lookup', 'fetch_figure', 'fetch_field', 'fetch_section')"
_PROMOTED = f"""{_POOL},
g AS (SELECT qid, doc_id, min(ord) AS ord, arg_min(method, ord) AS m, arg_min(score, ord) AS s, arg_min(method, ord) FILTER (method IN {_PINS}) AS pm, max(score) AS top FROM pool GROUP BY ALL),
promoted AS (SELECT qid, doc_id, ord, coalesce(pm, m) AS method, CASE WHEN pm IS NOT NULL AND m NOT IN {_PINS} THEN top ELSE s END AS score FROM g)"""


def pool_first_wins(spark, sf_dir):
    return R.first_wins(_pool(spark, sf_dir), ["qid", "doc_id"])


def pool_promote(spark, sf_dir):
    return R.promote(_pool(spark, sf_dir))


def pinned_rank(spark, sf_dir):
    return R.pin(R.promote(_pool(spark, sf_dir)), 6)


def _candidates(spark, sf_dir):
    """The pool's hits, 40 a query at most, with texts: they go to the documents, which aren't shuffled."""
    hits = R.first_wins(_pool(spark, sf_dir), ["qid", "doc_id"])
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return materialize(texts.join(F.broadcast(hits), "doc_id"), "candidates").join(_asked(spark, sf_dir), "qid")


def rerank_lexical(spark, sf_dir):
    return R.rerank_lexical(_candidates(spark, sf_dir)).select("qid", "doc_id", "rerank_score", "prior_method", "place")


def context_budget(spark, sf_dir):
    ranked = R.rerank_lexical(_candidates(spark, sf_dir)).withColumn("tok", X.context_tokens(F.col("text")))
    return R.greedy_budget(ranked.select("qid", "place", "doc_id", "tok"), 4000)


_RERANK = f"""{_POOL},
fw AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY ord) = 1),
c AS (SELECT fw.*, d.text, b.text AS query FROM fw JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = fw.qid),
rr AS (SELECT *, CASE WHEN trim(coalesce(query, '')) <> '' AND trim(coalesce(text, '')) <> '' THEN
  round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, h)) / len(w)::DOUBLE ELSE 0 END, 6) END AS rerank_score
  FROM (SELECT *, list_distinct({X.tokens_sql("query")}) AS w, {_TOK} AS h FROM c)),
ranked AS (SELECT *, method AS prior_method, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC NULLS LAST, ord)::INTEGER AS place FROM rr)"""


def ref_frequency_expand(spark, sf_dir):
    """Link targets that pages of a host mention and that no page of it is, the six most frequent."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("qid"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("ref"), "html")
    return R.reference_counts(pages, pages.select("qid", "ref").distinct(), F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))


def section_prefix_fetch(spark, sf_dir):
    """Pages under a path: exact or below, in order, three of them."""
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), "/", ".")
    pages = table(spark, sf_dir, "pages").select(path.alias("section_id"), F.col("page_id").alias("chunk_index"))
    return R.section_fetch(pages, "en.", 3).unionByName(R.section_fetch(pages, "fr", 3)).unionByName(R.section_fetch(pages, " . ", 3))


def _fetch_sql(at: str) -> str:
    return f"(SELECT section_id, chunk_index, 1.0::DOUBLE AS score, 'section_fetch' AS method FROM p WHERE section_id = '{at}' OR starts_with(section_id, '{at}.') ORDER BY section_id, chunk_index LIMIT 3)"


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_filtered_global_stats, bm25_title_bonus, token_stats, doc_length_stats, vector_topk, vector_topk_filtered, vector_topk_all, vector_topk_filtered_all, rrf_fuse, hybrid_multi_query, pool_first_wins, pool_promote, pinned_rank, rerank_lexical, context_budget, ref_frequency_expand, section_prefix_fetch)}
_FUSED = "sum(1.0::DOUBLE / (60 + rank)) AS s, list_sort(list_distinct(list(method))) AS methods, min(rank) AS best_rank"
ORACLE = {
    "bm25_topk": _bm25_sql(),
    "bm25_filtered_global_stats": _bm25_sql(keep="source = 'src3'"),
    "bm25_title_bonus": _bm25_sql(title=True),
    "token_stats": f"SELECT t, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOK}) AS t FROM documents) GROUP BY t",
    "doc_length_stats": f"SELECT lang, count(*) AS n, round(avg(dl), 6) AS mean, median(dl)::DOUBLE AS median, min(dl) AS least, max(dl) AS most FROM (SELECT lang, len({_TOK})::INTEGER AS dl FROM documents) GROUP BY lang",
    "vector_topk": _vector_sql("true"),
    "vector_topk_filtered": _vector_sql("label = 3"),
    "rrf_fuse": f"WITH {_LISTS}, f AS (SELECT qid, doc_id, {_FUSED} FROM l GROUP BY ALL) SELECT qid, doc_id, round(s, 9) AS score, methods, best_rank, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, doc_id)::INTEGER AS rank FROM f QUALIFY rank <= 20",
    "hybrid_multi_query": "WITH b0 AS (SELECT item_id, list_transform([text] || string_split(text, chr(10)), lambda x: trim(x)) AS q FROM benchmark), b1 AS (SELECT item_id, list_filter(q, lambda x, i: list_position(q, x) = i) AS q FROM b0), benchmark2 AS (SELECT item_id || '/' || (i - 1) AS item_id, q[i] AS text FROM b1, unnest(generate_series(1, len(q))) AS g(i) WHERE regexp_matches(q[i], '[A-Za-z0-9]')), "
    + f"k AS ({_bm25_sql().replace('FROM benchmark', 'FROM benchmark2').replace('rank <= 10', 'rank <= 5')}), f AS (SELECT split_part(qid, '/', 1)::BIGINT AS qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s, ['bm25'] AS methods, min(rank) AS best_rank FROM k GROUP BY ALL) SELECT qid, doc_id, round(s, 9) AS score, methods, best_rank, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, doc_id)::INTEGER AS rank FROM f QUALIFY rank <= 10",
    "pool_first_wins": f"WITH {_POOL} SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY ord) = 1",
    "pool_promote": f"WITH {_PROMOTED} SELECT * FROM promoted",
    "pinned_rank": f"WITH {_PROMOTED}, t AS (SELECT *, CASE WHEN method = 'structured_lookup' THEN 0 WHEN method IN {_PINS} THEN 1 ELSE 2 END AS tier FROM promoted) SELECT qid, doc_id, ord, method, score, row_number() OVER (PARTITION BY qid ORDER BY tier, ord)::INTEGER AS place FROM t QUALIFY place <= greatest(6, count(*) FILTER (tier < 2) OVER (PARTITION BY qid))",
    "rerank_lexical": f"WITH {_RERANK} SELECT qid, doc_id, rerank_score, prior_method, place FROM ranked",
    "context_budget": f"""WITH {_RERANK},
x AS (SELECT qid, list({{'o': place, 't': greatest(1, length(text) // 4)}} ORDER BY place) AS items FROM ranked GROUP BY qid),
y AS (SELECT qid, list_reduce(items, lambda s, i: CASE WHEN s.used + i.t <= 4000 THEN {{'used': (s.used + i.t)::BIGINT, 'kept': s.kept || [i.o::BIGINT]}} ELSE {{'used': s.used::BIGINT, 'kept': s.kept}} END, {{'used': 0::BIGINT, 'kept': []::BIGINT[]}}) AS s FROM x)
SELECT r.qid, r.place, r.doc_id, greatest(1, length(r.text) // 4)::INTEGER AS tok FROM ranked r JOIN y USING (qid) WHERE list_contains(y.s.kept, r.place::BIGINT)""",
    "ref_frequency_expand": r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS qid, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS ref, html FROM pages),
s AS (SELECT qid, ref, count(*) AS n FROM (SELECT qid, unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1))) AS ref FROM p) GROUP BY ALL)
SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY n DESC, ref)::INTEGER AS rank FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.qid = s.qid AND p.ref = s.ref) QUALIFY rank <= 6""",
    "section_prefix_fetch": f"WITH p AS (SELECT replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/', '.') AS section_id, page_id AS chunk_index FROM pages) {_fetch_sql('en')} UNION ALL {_fetch_sql('fr')}",
}
