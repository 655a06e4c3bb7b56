"""Queries of graphs, evaluation, cost, logs and keyed sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import analytics as A
from marlstone.operators import graph as G
from marlstone.operators.retrieval import first_wins
from marlstone.session import table


def _geo(spark, sf_dir):
    region, nation, supplier, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("nation:"), "n_name").alias("src"), F.concat(F.lit("region:"), "r_name").alias("dst"))
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier:"), "s_name").alias("src"), F.concat(F.lit("nation:"), "n_name").alias("dst"))
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer:"), "c_name").alias("src"), F.concat(F.lit("nation:"), "n_name").alias("dst"))
    return n.union(s).union(c)


def hierarchy_edges(spark, sf_dir):
    return G.hierarchy(_geo(spark, sf_dir))


def _edges(spark, sf_dir):
    """Orders as edges from customer to status, several of each, with evidence and strength from priority."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("source"),
        F.concat(F.lit("status:"), "o_orderstatus").alias("target"),
        F.lit("has").alias("type"),
        F.col("o_orderpriority").alias("evidence"),
        F.when(F.col("o_orderpriority").startswith("1"), "strong").when(F.col("o_orderpriority").startswith("2"), "mention").alias("strength"),
        F.when(F.col("o_orderpriority").startswith("1"), "deterministic").otherwise("llm").alias("confidence"),
        F.substring("o_orderpriority", 1, 1).alias("found_by"),
        F.col("o_orderkey").alias("edge_ord"),
    )


_EDGES = "e AS (SELECT 'customer:' || o_custkey AS source, 'status:' || o_orderstatus AS target, 'has' AS type, o_orderpriority AS evidence, CASE WHEN o_orderpriority LIKE '1%' THEN 'strong' WHEN o_orderpriority LIKE '2%' THEN 'mention' END AS strength, CASE WHEN o_orderpriority LIKE '1%' THEN 'deterministic' ELSE 'llm' END AS confidence, substr(o_orderpriority, 1, 1) AS found_by, o_orderkey AS edge_ord FROM orders)"


def edge_dedup_strength(spark, sf_dir):
    return G.dedup_strength(_edges(spark, sf_dir))


def edge_merge_confidence(spark, sf_dir):
    return G.merge_confidence(_edges(spark, sf_dir))


def _nodes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.lit("command").alias("kind"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The "), "p_type", F.lit(" command"))).when(F.col("p_size") % 3 == 1, F.upper("p_type")).otherwise(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"), F.col("p_partkey").alias("ord"))


def alias_registry(spark, sf_dir):
    return G.aliases(_nodes(spark, sf_dir))


def graph_two_hop(spark, sf_dir):
    """What lies within two steps of the regions."""
    edges = G.hierarchy(_geo(spark, sf_dir))
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), "r_name").alias("seed"))
    return G.neighbours(edges, seeds)


def endpoint_degree(spark, sf_dir):
    return G.endpoints(_edges(spark, sf_dir)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def edge_statistics(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("type", "strength").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


def _eval(spark, sf_dir):
    """Labelled documents as answers: the source is cited, a first word is the field."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    each = docs.join(labels, "doc_id").select(
        F.when(F.col("lang") == "en", "lookup").otherwise(F.col("lang")).alias("type"),
        A.answer_present(F.col("text"), ("anan", "thth", "enst")).alias("answer_present"),
        A.citation_hit(F.array(F.concat("source", F.lit(".1"))), F.array(F.lit("src1"), F.lit("src2"), F.concat(F.lit("src"), F.col("quality").cast("string")))).alias("citation_hit"),
        A.field_mentioned(F.col("text"), F.array(F.lit("ERTH"), F.lit("stch"))).alias("field_mentioned"),
        F.col("n_chars").cast("double").alias("latency_ms"),
    )
    return each.withColumn("passed", A.passed(F.col("type"), F.col("answer_present"), F.col("citation_hit"), F.col("field_mentioned")))


def eval_report(spark, sf_dir):
    return A.eval_report(_eval(spark, sf_dir))


def _calls(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("user_id", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("prompt"), F.floor(F.abs("value")).cast("long").alias("completion"))


def cost_rollup(spark, sf_dir):
    prices = spark.createDataFrame([("purchase", 3.0, 15.0), ("view", 0.15, 0.6)], "model string, price_in double, price_out double")
    return A.cost_rollup(_calls(spark, sf_dir), prices, ["user_id"])


_CONFIGS = [
    ("fast", 7, 0, 0.15, 0.6, False, 3.0, 15.0, 7, 8000, 1, False, 1, 800, False),
    ("balanced", 10, 3000, 3.0, 15.0, False, 3.0, 15.0, 14, 16000, 1, False, 2, 1500, True),
    ("thorough", 10, 3000, 3.0, 15.0, True, 15.0, 75.0, 14, 16000, 4, True, 3, 2500, False),
]
_CONFIG_COLS = "name string, chunks int, reserve int, price_in double, price_out double, agentic boolean, ag_in double, ag_out double, ag_chunks int, ag_context int, iterations int, recursive boolean, followups int, ag_output int, auto_gap boolean"


def cost_estimate(spark, sf_dir):
    return A.cost_estimate(spark.createDataFrame(_CONFIGS, _CONFIG_COLS)).select("name", "typical", "worst")


def qa_log_latest(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"), "event_type")
    return A.latest(ev, 200)


def flag_list(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"), "value")
    return A.latest(ev, 9999)


def trace_iterations(spark, sf_dir):
    """Events of users as stages, some of a numbered iteration."""
    kind = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("agentic.regenerate.iter"), (F.col("event_id") % 3).cast("string"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("agentic.verdict_converged.iter"), (F.col("event_id") % 4).cast("string"))).when(F.col("event_id") % 5 == 2, F.lit("agentic.cap_reached")).otherwise(F.col("event_type"))
    trace = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), kind.alias("stage"))
    return A.trace_pages(trace).withColumn("label", A.stage_label(F.col("stage")))


def upsert_latest(spark, sf_dir):
    """Customers' last orders over a table of first ones."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    old = first_wins(o, ["o_custkey"], "o_orderkey")
    return A.upserted(old, o.where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderkey")


def replace_partition(spark, sf_dir):
    """The table after the rows of one partition are written anew."""
    from marlstone.sources.sinks import replaced

    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    return replaced(o, o.where("o_orderstatus = 'F'").withColumn("o_orderkey", -F.col("o_orderkey")), "o_orderstatus")


def field_first_wins(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit(" "), "event_type").alias("name"), "event_id")
    return A.first_fields(ev, "name", "event_id", ["user_id"])


def figure_survival(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("expected"), F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))).alias("used"))
    return A.survival(o).select("l_orderkey", F.round("survival", 6).alias("survival"))


def confidence_over_corpora(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("qid"), F.col("c_mktsegment").alias("spec"), F.col("c_custkey").cast("string").alias("id"), "c_acctbal")
    found = c.groupBy("qid", "spec").agg(F.when(F.max("c_acctbal") > 9500, "HIGH").when(F.max("c_acctbal") > 5000, "MEDIUM").otherwise("LOW").alias("confidence"), F.slice(F.array_sort(F.collect_list("id")), 1, 3).alias("ids"))
    return A.max_confidence(found)


QUERIES = {f.__name__: f for f in (hierarchy_edges, edge_dedup_strength, edge_merge_confidence, alias_registry, graph_two_hop, endpoint_degree, edge_statistics, eval_report, cost_rollup, cost_estimate, qa_log_latest, flag_list, trace_iterations, upsert_latest, replace_partition, field_first_wins, figure_survival, confidence_over_corpora)}
_GEO = "g AS (SELECT 'nation:' || n_name AS src, 'region:' || r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'supplier:' || s_name, 'nation:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'customer:' || c_name, 'nation:' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"
ORACLE = {
    "hierarchy_edges": f"WITH {_GEO} SELECT DISTINCT src AS source, dst AS target, 'child_of' AS type FROM g",
    "edge_dedup_strength": f"WITH {_EDGES}, r AS (SELECT *, CASE strength WHEN 'strong' THEN 2 WHEN 'mention' THEN 1 ELSE 0 END AS r FROM e) SELECT source, target, type, evidence, strength, min(edge_ord) OVER (PARTITION BY source, target, type) AS edge_ord FROM r QUALIFY row_number() OVER (PARTITION BY source, target, type ORDER BY r DESC, r.edge_ord) = 1",
    "edge_merge_confidence": f"WITH {_EDGES}, f AS (SELECT source, target, type, evidence, min(edge_ord) AS o FROM e GROUP BY ALL), l AS (SELECT source, target, type, list(evidence ORDER BY o) AS a FROM f GROUP BY ALL), m AS (SELECT source, target, type, CASE WHEN bool_or(confidence = 'deterministic') THEN 'deterministic' ELSE arg_min(confidence, edge_ord) END AS confidence, coalesce(arg_max(evidence, edge_ord) FILTER (confidence = 'deterministic'), arg_min(evidence, edge_ord)) AS evidence, list_sort(list_distinct(list(found_by))) AS confirmed_by FROM e GROUP BY ALL) SELECT m.*, CASE WHEN len(a) > 1 THEN a[1:5] END AS evidence_all FROM m JOIN l USING (source, target, type)",
    "alias_registry": r"WITH x AS (SELECT 'command' AS kind, CASE WHEN p_size % 3 = 0 THEN 'The ' || p_type || ' command' WHEN p_size % 3 = 1 THEN upper(p_type) ELSE p_type || ' (' || p_brand || ')' END AS raw, p_partkey AS ord FROM part), n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, ' *\([^()]*\)$', ''), '^(?i:the|an|a) ', ''), '(?i: command)$', '') AS norm FROM x), c AS (SELECT kind, lower(norm) AS k, norm, count(*) AS n, min(ord) AS f FROM n GROUP BY ALL), b AS (SELECT kind, k, arg_max(norm, n * 1000000000 - f) AS name FROM c GROUP BY ALL), r AS (SELECT kind, lower(norm) AS k, raw, count(*) AS n FROM n GROUP BY ALL) SELECT kind, name, list(raw ORDER BY n DESC, raw) AS aliases FROM r JOIN b USING (kind, k) WHERE raw <> name GROUP BY kind, name",
    "graph_two_hop": f"WITH {_GEO}, w AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), h1 AS (SELECT DISTINCT 'region:' || r_name AS seed, b AS node FROM region JOIN w ON a = 'region:' || r_name), h2 AS (SELECT DISTINCT seed, b AS node FROM h1 JOIN w ON a = node) SELECT seed, node, 1 AS hop FROM h1 UNION ALL SELECT seed, node, 2 FROM h2 WHERE node <> seed AND (seed, node) NOT IN (SELECT (seed, node) FROM h1)",
    "endpoint_degree": f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT unnest([source, target]) AS node FROM e) GROUP BY node",
    "edge_statistics": f"WITH {_EDGES} SELECT type, strength, count(*) AS n, count(DISTINCT source) AS sources FROM e GROUP BY ALL",
    "eval_report": """WITH a AS (SELECT CASE WHEN lang = 'en' THEN 'lookup' ELSE lang END AS type, length(trim(text)) >= 20 AND NOT regexp_matches(substr(lower(text), 1, 200), 'anan|thth|enst') AND NOT (length(trim(text)) < 400 AND regexp_matches(lower(text), 'anan|thth|enst')) AS ap,
source IN ('src1', 'src2', 'src' || quality) AS ch, contains(lower(text), 'erth') OR contains(lower(text), 'stch') AS fm, n_chars::DOUBLE AS ms FROM documents JOIN labels USING (doc_id)),
b AS (SELECT *, ap AND CASE WHEN type = 'lookup' THEN ch OR fm ELSE ch END AS p FROM a)
SELECT coalesce(type, 'OVERALL') AS type, count(*) AS n, count_if(ap)::BIGINT AS answer_present, count_if(ch)::BIGINT AS citation_hit, count_if(fm)::BIGINT AS field_mentioned, count_if(p)::BIGINT AS passed, round(avg(ms), 6) AS mean_ms, round(100.0::DOUBLE * count_if(p) / count(*), 6) AS pass_percent FROM b GROUP BY ROLLUP (type)""",
    "cost_rollup": "WITH c AS (SELECT user_id, event_type AS model, json_extract_string(props, '$.k')::BIGINT AS prompt, floor(abs(value))::BIGINT AS completion FROM events), p(model, pin, pout) AS (VALUES ('purchase', 3.0::DOUBLE, 15.0::DOUBLE), ('view', 0.15::DOUBLE, 0.6::DOUBLE)) SELECT user_id, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, round(sum((prompt * coalesce(pin, 0) + completion * coalesce(pout, 0)) / 1e6), 9) AS cost FROM c LEFT JOIN p USING (model) GROUP BY user_id",
    "cost_estimate": """WITH q(name, chunks, reserve, pi, po, ag, ai, ao, ac, ax, it, rec, fo, oo, gap) AS (VALUES """
    + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if not isinstance(v, bool) else str(v).lower() for v in c) + ")" for c in _CONFIGS)
    + """), a AS (SELECT *, least(675, reserve) AS fig, reserve - least(675, reserve) AS extra, CASE WHEN rec THEN greatest(1, it) ELSE 1 END AS most FROM q),
b AS (SELECT *, least(2, most) AS passes, (1000 * 0.15 + 130 * 0.6) / 1e6 AS g1, 2200 + least(ac * 450, ax) + fig AS ain FROM a),
c AS (SELECT *, (ain * ai + 330 * ao) / 1e6 AS regen, ((ain + extra) * ai + oo * ao) / 1e6 AS rw FROM b),
d AS (SELECT *, 550 / 1e6 * 0.02 + (550 * 0.15 + 70 * 0.6) / 1e6 + ((2200 + chunks * 450 + fig) * pi + 400 * po) / 1e6 + CASE WHEN gap AND NOT ag THEN g1 ELSE 0 END + CASE WHEN ag THEN (550 * 0.15 + 70 * 0.6) / 1e6 * least(2, greatest(1, fo)) + (g1 + regen) * passes ELSE 0 END AS t FROM c)
SELECT name, round(t::DOUBLE, 9) AS typical, round((t + greatest(0, extra * pi / 1e6 + CASE WHEN ag THEN (g1 + rw) * most - (g1 + regen) * passes ELSE 0 END))::DOUBLE, 9) AS worst FROM d""",
    "qa_log_latest": "SELECT event_id AS id, epoch_us(ts) AS created_at, event_type FROM events ORDER BY 2 DESC, 1 DESC LIMIT 200",
    "flag_list": "SELECT event_id AS id, epoch_us(ts) AS created_at, value FROM events WHERE event_type = 'purchase' ORDER BY 2 DESC, 1 DESC LIMIT 500",
    "trace_iterations": r"""WITH t AS (SELECT user_id AS request_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'agentic.regenerate.iter' || event_id % 3 WHEN 1 THEN 'agentic.verdict_converged.iter' || event_id % 4 WHEN 2 THEN 'agentic.cap_reached' ELSE event_type END AS s FROM events),
o AS (SELECT *, CASE seq % 5 WHEN 0 THEN (seq % 3)::INTEGER WHEN 1 THEN greatest(0, seq % 4 - 1)::INTEGER END AS own FROM t)
SELECT request_id, seq, regexp_replace(s, '\.iter[0-9]+$', '') AS stage, coalesce(own, CASE WHEN s = 'agentic.cap_reached' THEN coalesce(max(own) OVER (PARTITION BY request_id), 0) ELSE 0 END) AS page, CASE WHEN s LIKE 'agentic.regenerate%' THEN 'Regenerate (agentic)' ELSE regexp_replace(s, '\.iter[0-9]+$', '') END AS label FROM o""",
    "upsert_latest": "WITH f AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1), n AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT * FROM n UNION ALL SELECT * FROM f WHERE o_custkey NOT IN (SELECT o_custkey FROM n)",
    "replace_partition": "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN -o_orderkey ELSE o_orderkey END AS o_orderkey FROM orders",
    "field_first_wins": "SELECT user_id, upper(event_type) AS name, min(event_id) AS event_id FROM events GROUP BY ALL",
    "figure_survival": "SELECT l_orderkey, round(count(DISTINCT l_suppkey) FILTER (l_returnflag = 'N') / count(DISTINCT l_suppkey)::DOUBLE, 6) AS survival FROM lineitem GROUP BY l_orderkey",
    "confidence_over_corpora": "WITH f AS (SELECT c_nationkey AS qid, c_mktsegment AS spec, CASE WHEN max(c_acctbal) > 9500 THEN 2 WHEN max(c_acctbal) > 5000 THEN 1 ELSE 0 END AS r, list_sort(list(c_custkey::VARCHAR))[1:3] AS ids FROM customer GROUP BY ALL) SELECT qid, ['LOW', 'MEDIUM', 'HIGH'][max(r) + 1] AS confidence, flatten(list(list_transform(ids, lambda i: spec || ':' || i) ORDER BY spec))[1:8] AS ids FROM f GROUP BY qid",
}
