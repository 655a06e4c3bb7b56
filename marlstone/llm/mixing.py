"""Mixing sources to target weights under a schedule that changes during training.

Training time t runs from 0 to 1 over a budget of T tokens. At each knot every source has
a share of the stream; between knots shares change linearly, so they always sum to 1.
The demand of source s up to t is T * D_s(t), where D_s is the integral of its share,
a quadratic on each segment. A document whose middle token is the c-th of its source is due
when T * D_s(t) = c: that t, by inverting the quadratic, is its position. When demand
exceeds what a source holds, the source starts over (epoch 1, 2, ...); what exceeds demand is
not drawn. Sorting by position yields the curriculum.

Running token counts come in two levels, so that no source has to fit one task: the order
within a source is the MD5 of (seed, id); its first three hex digits name one of 4,096 buckets,
whose totals give each bucket's offset, and a window runs only inside a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (t, exponent): at t the share of a source is its token count to that power, over the sum of all.
CURRICULUM = ((0.0, 1.0), (0.5, 0.7), (1.0, 0.4))


def token_count(text: Column) -> Column:
    """Tokens of a text, at four UTF-8 bytes each, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.octet_length(text) / F.lit(4)), F.lit(0)).cast("long")


def _source_plan(totals: DataFrame, budget_tokens: int | None, curriculum, weights: DataFrame | None) -> DataFrame:
    """Per source: share p0.. at the knots, demand c0.. up to them, tokens held, and the budget."""
    knots = [t for t, _ in curriculum]
    every = W.partitionBy(F.lit(1))
    plan = totals
    if weights is None:
        for k, (_, power) in enumerate(curriculum):
            plan = plan.withColumn(f"__w{k}", F.when(F.col("__held") > 0, F.pow(F.col("__held").cast("double"), F.lit(float(power)))).otherwise(F.lit(0.0)))
    else:
        given = weights.select(
            F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("__g"),
            *[F.col(f"w{k}").cast("double").alias(f"__w{k}") for k in range(len(knots))],
        )
        plan = plan.join(given, plan["__src"] == given["__g"], "left").drop("__g")
        for k in range(len(knots)):
            plan = plan.withColumn(f"__w{k}", F.when((F.col("__held") > 0) & (F.col(f"__w{k}") > 0), F.col(f"__w{k}")).otherwise(F.lit(0.0)))
    for k in range(len(knots)):
        total = F.sum(f"__w{k}").over(every)
        plan = plan.withColumn(f"__p{k}", F.when(total > 0, F.col(f"__w{k}") / total).otherwise(F.lit(0.0)))
    plan = plan.withColumn("__c0", F.lit(0.0))
    for k in range(1, len(knots)):
        step = knots[k] - knots[k - 1]
        plan = plan.withColumn(f"__c{k}", F.col(f"__c{k - 1}") + (F.col(f"__p{k - 1}") + F.col(f"__p{k}")) * F.lit(step / 2))
    held = F.sum("__held").over(every).cast("double")
    plan = plan.withColumn("__budget", held if budget_tokens is None else F.lit(float(budget_tokens)))
    return plan.select("__src", "__held", "__budget", *[f"__{x}{k}" for k in range(len(knots)) for x in "pc"])


def _invert(due: Column, curriculum) -> Column:
    """The t at which the integrated share reaches `due` (a share of the budget)."""
    knots = [t for t, _ in curriculum]
    found = None
    for k in reversed(range(len(knots) - 1)):
        width = knots[k + 1] - knots[k]
        slope = (F.col(f"__p{k + 1}") - F.col(f"__p{k}")) / F.lit(width)
        rest = F.greatest(due - F.col(f"__c{k}"), F.lit(0.0))
        root = F.sqrt(F.greatest(F.col(f"__p{k}") * F.col(f"__p{k}") + F.lit(2.0) * slope * rest, F.lit(0.0)))
        under = F.col(f"__p{k}") + root
        here = F.lit(knots[k]) + F.least(F.when(under > 0, F.lit(2.0) * rest / under).otherwise(F.lit(0.0)), F.lit(width))
        found = here if found is None else F.when(due < F.col(f"__c{k + 1}"), here).otherwise(found)
    return found


def _placed(docs: DataFrame, carry: bool, budget_tokens, curriculum, weights, seed) -> DataFrame:
    keyed = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")] if carry else []),
        F.col("doc_id").alias("__id"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("__src"),
        token_count(F.col("text")).alias("__tok"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("__key"),
    ).withColumn("__bucket", F.substring("__key", 1, 3))
    narrow = docs.select(
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("__src"),
        token_count(F.col("text")).alias("__tok"),
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 3).alias("__bucket"),
    )
    buckets = narrow.groupBy("__src", "__bucket").agg(F.sum("__tok").alias("__in"))
    before = W.partitionBy("__src").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.withColumn("__offset", F.coalesce(F.sum("__in").over(before), F.lit(0)))
    plan = _source_plan(buckets.groupBy("__src").agg(F.sum("__in").alias("__held")), budget_tokens, curriculum, weights)
    offsets = offsets.drop("__in").join(plan, "__src")
    inside = W.partitionBy("__src", "__bucket").orderBy("__key", "__id", "__tok").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        keyed.withColumn("__upto", F.sum("__tok").over(inside))
        .join(offsets, ["__src", "__bucket"])
        .withColumn("__mid", F.col("__offset") + F.col("__upto") - F.col("__tok") / F.lit(2.0))
        .withColumn("__demand", F.col("__budget") * F.col(f"__c{len(curriculum) - 1}"))
        .where((F.col("__held") > 0) & (F.col("__mid") <= F.col("__demand")))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("__demand") - F.col("__mid")) / F.col("__held")).cast("int"))))
    )
    due = (F.col("__mid") + F.col("epoch") * F.col("__held")) / F.col("__budget")
    return placed.withColumn("__at", _invert(due, curriculum))


def mix(docs: DataFrame, budget_tokens: int | None = None, curriculum=CURRICULUM, weights: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """The training order: (doc_id, source, n_tokens, epoch, position), sorted by position.

    Shares at the knots are token counts to the curriculum's exponents, or `weights`, a
    table (source, w0, w1, ...) with a weight at each knot; a source it lacks has none and is
    not drawn. budget_tokens is T, by default the tokens of all documents together.
    The order is by the exact position, ties by doc_id and epoch; the column position is rounded to six places.

    Null source: a source of its own. Null text: no tokens; it takes the place where it
    falls. Null id: ordered as the string "null". Repeated rows are documents of their own. Very
    long documents take one position, that of their middle. A source without tokens is not drawn;
    an empty table gives an empty result. Other columns are ignored whatever their names.
    """
    placed = _placed(docs.select("doc_id", "source", "text"), False, budget_tokens, curriculum, weights, seed)
    return placed.select(
        F.col("__id").alias("doc_id"),
        F.when(F.col("__src") != "n", F.expr("substring(__src, 2)")).alias("source"),
        F.col("__tok").alias("n_tokens"),
        "epoch",
        F.round("__at", 6).alias("position"),
        "__at",
    ).orderBy("__at", "doc_id", "epoch").drop("__at")


def mix_documents(docs: DataFrame, budget_tokens: int | None = None, curriculum=CURRICULUM, weights: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """Like mix(), but the result has the columns of docs, in training order; a document drawn twice is there twice.

    Null sources, texts and ids, repeated rows, very long documents and empty tables as in mix(); all columns are kept whatever their names.
    """
    placed = _placed(docs, True, budget_tokens, curriculum, weights, seed)
    return placed.orderBy("__at", "__id", "epoch").select("__doc.*")


def oracle(curriculum=CURRICULUM, seed: int = 17) -> str:
    """DuckDB SQL of mix() with its default budget and weights."""
    knots = [t for t, _ in curriculum]
    n = len(knots)
    shares = ", ".join(f"CASE WHEN held > 0 THEN pow(held::DOUBLE, {float(a)}) ELSE 0 END AS w{k}" for k, (_, a) in enumerate(curriculum))
    normal = ", ".join(f"w{k} / sum(w{k}) OVER () AS p{k}" for k in range(n))
    sums = ["0.0::DOUBLE"]
    for k in range(1, n):
        sums.append(f"({sums[-1]}) + (p{k - 1} + p{k}) * {(knots[k] - knots[k - 1]) / 2}::DOUBLE")
    cums = ", ".join(f"{s} AS c{k}" for k, s in enumerate(sums))

    def here(k: int) -> str:
        width = knots[k + 1] - knots[k]
        rest = f"greatest(due - c{k}, 0.0)"
        under = f"(p{k} + sqrt(greatest(p{k} * p{k} + 2.0::DOUBLE * ((p{k + 1} - p{k}) / {width}::DOUBLE) * {rest}, 0.0)))"
        return f"{knots[k]}::DOUBLE + least(CASE WHEN {under} > 0 THEN 2.0::DOUBLE * {rest} / {under} ELSE 0.0 END, {width}::DOUBLE)"

    inverse = reduce(lambda found, k: f"CASE WHEN due < c{k + 1} THEN {here(k)} ELSE {found} END", reversed(range(n - 2)), here(n - 2))
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(ceil(strlen(text) / 4.0), 0)::BIGINT AS n_tokens,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
r AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens / 2.0::DOUBLE AS mid
  FROM d),
s AS (SELECT source, sum(n_tokens) AS held FROM d GROUP BY source),
w AS (SELECT source, held, {shares} FROM s),
p AS (SELECT source, held, sum(held) OVER ()::DOUBLE AS budget, {normal} FROM w),
c AS (SELECT *, {cums} FROM p),
x AS (
  SELECT r.doc_id, r.source, r.n_tokens, r.mid, c.* EXCLUDE (source),
         unnest(generate_series(0, floor((budget * c{n - 1} - mid) / held)::BIGINT)) AS epoch
  FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source
  WHERE held > 0 AND mid <= budget * c{n - 1}),
y AS (SELECT *, (mid + epoch * held) / budget AS due FROM x)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, round({inverse}, 6) AS position FROM y
"""
