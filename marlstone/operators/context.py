"""Context and evaluation helpers: trimming tables, cited figures, sampling, allocation, audits, cost of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import queries as Q
from marlstone.functions import text as X
from marlstone.operators.retrieval import first_wins


def trimmed_table(text: Column, budget: int, mark: str = "[more rows]") -> Column:
    """A serialized table within a token budget: the lines up to its rule, then rows until one no longer fits, then a mark if any is left out."""
    lines = F.split(text, "\n")
    rule = F.array_position(lines, "---").cast("int")
    head = F.when(rule > 0, F.slice(lines, F.lit(1), rule)).otherwise(F.array().cast("array<string>"))
    body = F.when(rule > 0, F.slice(lines, rule + 1, F.size(lines))).otherwise(lines)
    start = F.struct(X.context_tokens(F.array_join(head, "\n")).cast("int").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    step = lambda s, x: F.struct((s["used"] + X.context_tokens(x)).cast("int").alias("used"), (s["n"] + F.when(s["open"] & (s["used"] + X.context_tokens(x) <= budget), 1).otherwise(0)).alias("n"), (s["open"] & (s["used"] + X.context_tokens(x) <= budget)).alias("open"))
    kept = F.aggregate(body, start, step)["n"]
    cut = F.array_join(F.concat(head, F.slice(body, F.lit(1), kept), F.array(F.lit(mark))), "\n")
    return F.when((X.context_tokens(text) <= budget) | (kept >= F.size(body)), text).otherwise(cut)


def cited_figures(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, figure, pdf_page) of sources (qid, figure_number, pdf_page, ord) with a page that the answer (qid, answer) names, the first of each number."""
    named = answers.select("qid", F.explode(Q.named_figures(F.col("answer"))).alias("figure"))
    own = sources.where("pdf_page IS NOT NULL").withColumn("figure", F.regexp_replace(F.trim("figure_number"), "^0+(?=.)", ""))
    return first_wins(own, ["qid", "figure"]).join(named, ["qid", "figure"], "left_semi").select("qid", "figure", "pdf_page")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of the MD5 of seed and key: the same ones wherever it runs."""
    return rows.withColumn("__k", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("__k", key).limit(n).drop("__k")


def allocation(kinds: DataFrame, total: int) -> DataFrame:
    """kinds (kind, weight) with `n`: its share of total, rounded half to even, 1 at least."""
    share = F.col("weight") * total / F.sum("weight").over(W.partitionBy(F.lit(1)))
    return kinds.withColumn("n", F.greatest(F.lit(1), F.bround(share).cast("int")))


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords a text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)))


def without_fences(text: Column) -> Column:
    """A reply without the fence that marks it as code."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def retry_delay(message: Column) -> Column:
    """Seconds to wait that an error names, and one more; null if it names none."""
    found = F.regexp_extract(message, r"(?i)retry in ([0-9]+(?:\.[0-9]+)?)\s*s", 1)
    return F.when(found != "", found.cast("double") + 1)


def embedding_cost(texts: DataFrame, column: str = "text", price: float = 0.02) -> DataFrame:
    """One row (words, tokens, cost): tokens at 0.75 words, price a million."""
    words = texts.agg(F.sum(X.word_count(F.col(column))).alias("words"))
    return words.select("words", (F.col("words") / 0.75).cast("long").alias("tokens"), F.round(F.col("words") / 0.75 / 1e6 * price, 9).alias("cost"))


def audit(paras: DataFrame, by: str, short: int = 4) -> DataFrame:
    """Counts by a column of paragraphs (…, text): all, empty, short, negated and plain obligations."""
    low = F.lower(F.coalesce("text", F.lit("")))
    count = lambda c: F.count_if(c)
    words = X.word_count(F.col("text"))
    return paras.groupBy(by).agg(F.count(F.lit(1)).alias("n"), count(words == 0).alias("empty"), count((words > 0) & (words < short)).alias("short"), count(low.rlike(r"(^|[^a-z])not($|[^a-z])")).alias("negated"), F.round(F.avg(words), 6).alias("mean_words"))
