"""Operational analytics: evaluation, cost, logs, traces, keyed sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators.retrieval import first_wins

#: What answers without a source say.
REFUSALS = ("no information", "cannot find", "information is not available", "not in the context", "does not contain the answer", "not provided in the context", "context does not contain")
#: Assumed sizes of calls: prompt and completion tokens, prices a million tokens.
COSTS = {"qp": (550, 70), "decomp": (550, 70), "gap": (1000, 130), "base": 2200, "chunk": 450, "gen_out": 400, "regen_out": 330, "passes": 2, "figures": 1.5, "embed": 0.02, "support": (0.15, 0.60)}


def answer_present(answer: Column, refusals: tuple[str, ...] = REFUSALS) -> Column:
    """At least 20 characters, no refusal in the first 200, and none at all below 400."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    pattern = "|".join(refusals)
    size = F.length(F.trim(low))
    return (size >= 20) & ~F.substring(low, 1, 200).rlike(pattern) & ~((size < 400) & low.rlike(pattern))


def citation_hit(cited: Column, expected: Column) -> Column:
    """Whether a cited id is an expected one or below it."""
    return F.exists(expected, lambda e: F.exists(cited, lambda c: (c == e) | c.startswith(F.concat(e, F.lit(".")))))


def field_mentioned(answer: Column, fields: Column) -> Column:
    """Whether the answer holds one of the field names, in any case."""
    return F.exists(fields, lambda f: F.contains(F.lower(answer), F.lower(f)))


def passed(kind: Column, present: Column, hit: Column, field: Column) -> Column:
    """Lookups pass by a citation or a field, others by a citation, all only with an answer."""
    return present & F.when(kind == "lookup", hit | field).otherwise(hit)


def eval_report(results: DataFrame) -> DataFrame:
    """Counts by type of results (type, answer_present, citation_hit, field_mentioned, passed, latency_ms), and OVERALL."""
    count = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(c)
    rolled = results.rollup("type").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *[count(c) for c in ("answer_present", "citation_hit", "field_mentioned", "passed")], F.round(F.avg("latency_ms"), 6).alias("mean_ms")
    )
    return rolled.withColumn("type", F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("type"))).withColumn("pass_percent", F.round(100.0 * F.col("passed") / F.col("n"), 6)).drop("g")


def stage_label(stage: Column) -> Column:
    """The name of a stage for people."""
    labels = {"query_processor": "Query processor", "generation": "Generation", "gap_hint": "Gap hint"}
    prefixes = {"agentic.gap_analysis": "Gap analysis", "agentic.regenerate": "Regenerate (agentic)", "agentic.followup_decomp": "Follow-up decompose"}
    out = F.when(F.lit(False), "")
    for k, v in labels.items():
        out = out.when(stage == k, v)
    for k, v in prefixes.items():
        out = out.when(stage.startswith(k), v)
    return out.otherwise(F.regexp_replace(stage, r"\.iter\d+$", ""))


def cost_rollup(calls: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens and cost of calls (keys…, model, prompt, completion) by keys; a model without a price costs nothing."""
    priced = calls.join(prices, "model", "left").withColumn("cost", (F.col("prompt") * F.coalesce("price_in", F.lit(0.0)) + F.col("completion") * F.coalesce("price_out", F.lit(0.0))) / 1e6)
    return priced.groupBy(*keys).agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.round(F.sum("cost"), 9).alias("cost"))


def cost_estimate(configs: DataFrame) -> DataFrame:
    """configs (chunks, reserve, price_in, price_out, agentic, ag_in, ag_out, ag_chunks, ag_context, iterations, recursive, followups, ag_output, auto_gap) with typical and worst cost of a query."""
    c = COSTS
    col = F.col
    call = lambda tin, tout, pin, pout: (tin * pin + tout * pout) / 1e6
    s_in, s_out = (F.lit(x) for x in c["support"])
    reserve = F.greatest(F.lit(0.0), F.coalesce(col("reserve"), F.lit(0)).cast("double"))
    figure = F.least(F.lit(c["figures"] * c["chunk"]), reserve)
    extra = reserve - figure
    each = lambda k: call(F.lit(c[k][0]), F.lit(c[k][1]), s_in, s_out)
    first = call(c["base"] + col("chunks") * c["chunk"] + figure, F.lit(c["gen_out"]), col("price_in"), col("price_out"))
    gap = F.when(col("auto_gap") & ~col("agentic"), each("gap")).otherwise(0.0)
    most = F.when(col("recursive"), F.greatest(F.lit(1), col("iterations"))).otherwise(1)
    passes = F.least(F.lit(c["passes"]), most)
    ag_in = c["base"] + F.least(col("ag_chunks") * c["chunk"], col("ag_context")) + figure
    regen = call(ag_in, F.lit(c["regen_out"]), col("ag_in"), col("ag_out"))
    regen_worst = call(ag_in + extra, col("ag_output"), col("ag_in"), col("ag_out"))
    loop = each("decomp") * F.least(F.lit(2), F.greatest(F.lit(1), col("followups"))) + (each("gap") + regen) * passes
    typical = F.lit(c["qp"][0] / 1e6 * c["embed"]) + each("qp") + first + gap + F.when(col("agentic"), loop).otherwise(0.0)
    worst = extra * col("price_in") / 1e6 + F.when(col("agentic"), (each("gap") + regen_worst) * most - (each("gap") + regen) * passes).otherwise(0.0)
    return configs.withColumn("typical", F.round(typical, 9)).withColumn("worst", F.round(typical + F.greatest(F.lit(0.0), worst), 9))


def trace_pages(trace: DataFrame) -> DataFrame:
    """trace (request_id, seq, stage) with `page`, the iteration it belongs to, and the stage without its .iterN.

    A convergence verdict belongs to the page before its number, what has no number to the first, and the mark of a reached cap to the last.
    """
    number = F.regexp_extract("stage", r"\.iter(\d+)(?:\.|$)", 1)
    own = F.when(number != "", F.when(F.col("stage").startswith("agentic.verdict_converged."), F.greatest(F.lit(0), number.cast("int") - 1)).otherwise(number.cast("int")))
    last = F.coalesce(F.max(own).over(W.partitionBy("request_id")), F.lit(0))
    page = F.coalesce(own, F.when(F.col("stage") == "agentic.cap_reached", last).otherwise(0))
    return trace.withColumn("page", page).withColumn("stage", F.regexp_replace("stage", r"\.iter\d+(\.|$)", "$1"))


def latest(log: DataFrame, limit: int) -> DataFrame:
    """The newest rows of a log (created_at, id), between 1 and 500 of them."""
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(500, limit)))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old with the rows of new in place of those with their keys; of several new rows with one key the last by `order` counts."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    last = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def first_fields(rows: DataFrame, name: str, order: str, keys: list[str]) -> DataFrame:
    """The first row of each key and name, the name trimmed and in upper case; empty names go."""
    cleaned = rows.withColumn(name, F.upper(F.trim(name))).where(F.coalesce(name, F.lit("")) != "")
    return first_wins(cleaned, [*keys, name], order)


def survival(items: DataFrame) -> DataFrame:
    """items (expected, used) with the share of expected figures that were used; 1 where none was expected."""
    want = F.array_distinct("expected")
    return items.withColumn("survival", F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, "used")) / F.size(want)))


def max_confidence(found: DataFrame, cap: int = 8) -> DataFrame:
    """(qid, confidence, ids) of lookups (qid, spec, confidence, ids) over all corpora: the highest confidence, and ids prefixed with their corpus, the first `cap`."""
    rank = F.when(F.col("confidence") == "HIGH", 2).when(F.col("confidence") == "MEDIUM", 1).otherwise(0)
    ids = F.transform("ids", lambda i: F.concat_ws(":", F.col("spec"), i))
    merged = found.groupBy("qid").agg(F.max_by("confidence", rank).alias("confidence"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("spec", ids.alias("ids")))), lambda x: x["ids"])).alias("ids"))
    return merged.withColumn("ids", F.slice("ids", 1, cap))
