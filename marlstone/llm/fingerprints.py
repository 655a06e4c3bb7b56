"""Document fingerprints: a sketch whose size follows the document.

Every shingle hash below a fixed fraction of the hash range is retained. Whether a hash is
kept depends on the hash alone, so the sketch of a union is the union of the sketches, and
|A n B| / |A| of the kept hashes estimates how much of A lies in B however unequal the two are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.session import materialize

WORDS = 5
#: 1 / 64 of the range: MD5 in hex below this.
LIMIT = "04"
#: Texts whose sketch has fewer hashes than this are compared by all their shingles.
EXACT_BELOW = 4


def _bound(value: Column, body) -> Column:
    """body(value), with the value computed once: a lambda's argument isn't inlined into what uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, words: int = WORDS) -> Column:
    """The runs of `words` words of the lower-cased text, one shorter run where it has fewer."""
    split = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(words - 1)), lambda i: F.array_join(F.slice(w, i, words), " "))
        return F.when(F.size(w) >= words, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return _bound(split, runs)


def sketch(text: Column, words: int = WORDS, limit: str = LIMIT) -> Column:
    """The distinct shingle hashes below the limit (16 hex digits each), sorted."""
    kept = F.filter(F.transform(shingles(text, words), lambda s: F.substring(F.md5(s), 1, 16)), lambda h: h < F.lit(limit))
    return F.array_sort(F.array_distinct(kept))


def fingerprints(docs: DataFrame, words: int = WORDS, limit: str = LIMIT) -> DataFrame:
    """(doc_id, sketch) for every row.

    Null and empty texts, and texts of white space, have an empty sketch. Texts of fewer than
    `words` words have one shingle, the whole text. Repeated shingles count once. Very long texts
    are sketched whole. Repeated rows and null ids give a row each. Other columns are ignored.
    """
    prepared = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return prepared.select("doc_id", sketch(F.col("text"), words, limit).alias("sketch"))


def merge(sketches: DataFrame, by: str) -> DataFrame:
    """Sketches of the unions of documents that share `by`: (by, sketch)."""
    each = sketches.select(by, F.explode_outer("sketch").alias("h")).distinct()
    return each.groupBy(by).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def containment(left: Column, right: Column) -> Column:
    """Estimated share of left's shingles that right has; null where left kept none."""
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, right)) / F.size(left))


def containment_pairs(left: DataFrame, right: DataFrame, at_least: float = 0.5) -> DataFrame:
    """(left_id, right_id, share) of all pairs whose estimated containment of left in right is at least that.

    Both tables are results of fingerprints(). The kept hashes are joined, so only pairs that
    share one are formed; rows with an empty sketch have no estimate and no pair.
    """
    a = left.select(F.col("doc_id").alias("left_id"), F.size("sketch").alias("n"), F.explode("sketch").alias("h"))
    b = right.select(F.col("doc_id").alias("right_id"), F.explode("sketch").alias("h"))
    shared = a.join(b, "h").groupBy("left_id", "right_id", "n").count()
    return shared.where(F.col("count") >= at_least * F.col("n")).select("left_id", "right_id", (F.col("count") / F.col("n")).alias("share"))


def hashed(texts: DataFrame, words: int = WORDS, limit: str = LIMIT) -> DataFrame:
    """texts with their sketch, a 64-bit hash of each distinct shingle (shingles) and a number for the row (doc_row) in place of the text."""
    runs = texts.withColumn("s", shingles(F.coalesce(F.col("text"), F.lit("")), words)).withColumn("doc_row", F.monotonically_increasing_id())
    kept = F.filter(F.transform("s", lambda x: F.substring(F.md5(x), 1, 16)), lambda h: h < F.lit(limit))
    each = runs.withColumn("shingles", F.array_distinct(F.transform("s", lambda x: F.xxhash64(x)))).withColumn("sketch", F.array_distinct(kept))
    return materialize(each.drop("s", "text"), "shingles")


def containments(left: DataFrame, right: DataFrame, at_least: float = 0.5, exact_below: int = EXACT_BELOW) -> DataFrame:
    """(left_id, right_id, share, exact): pairs of rows of hashed() of which at least that share of left's shingles lies in right; ids are doc_row.

    The share is estimated by the sketches, but where left's sketch has fewer than `exact_below` hashes, as that of a
    short text, it is counted over all shingles. Of those, left looks up its rarest only: a pair that shares enough shares one
    of any n - ceil(at_least * n) + 1. Texts without a word have no pair. A text under WORDS words is one shingle, which
    only an equal text has.
    """
    small = F.size("sketch") < exact_below
    sketches = lambda t: t.select(F.col("doc_row").alias("doc_id"), "sketch")
    estimated = containment_pairs(sketches(left.where(~small)), sketches(right), at_least).withColumn("exact", F.lit(False))

    short = left.where(small & (F.size("shingles") > 0)).select(F.col("doc_row").alias("left_id"), "shingles", F.size("shingles").alias("n"))
    asked = short.select("left_id", "n", F.explode("shingles").alias("h"))
    there = right.select(F.col("doc_row").alias("right_id"), F.explode("shingles").alias("h")).join(asked.select("h").distinct(), "h", "left_semi")
    there = materialize(there, "shared-shingles")
    known = asked.join(there.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = known.withColumn("place", F.row_number().over(W.partitionBy("left_id").orderBy("df", "h"))).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * at_least) + 1)
    pairs = rare.where("df > 0").join(there, "h").where("left_id != right_id").select("left_id", "right_id").distinct()
    held = there.groupBy("right_id").agg(F.collect_list("h").alias("held"))
    counted = pairs.join(short, "left_id").join(held, "right_id").withColumn("both", F.size(F.array_intersect("shingles", "held")))
    exact = counted.where(F.col("both") >= at_least * F.col("n")).select("left_id", "right_id", (F.col("both") / F.col("n")).alias("share"), F.lit(True).alias("exact"))
    return estimated.unionByName(exact)


def corpus_containments(docs: DataFrame, benchmark: DataFrame, at_least: float = 0.5) -> DataFrame:
    """(kind, left_id, right_id, share, exact): containments() of every document in the other documents, and of every benchmark text (item_id, text) in them.

    Repeated rows give rows of their own; rows with the same id aren't compared, null ids take no part.
    """
    own = docs.where("doc_id IS NOT NULL").select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), "text")
    texts = hashed(own.unionByName(benchmark.where("item_id IS NOT NULL").select(F.lit("benchmark").alias("kind"), F.col("item_id").cast("long").alias("id"), "text")))
    found = containments(texts, texts.where("kind = 'document'"), at_least)
    a = texts.select(F.col("doc_row").alias("left_id"), "kind", F.col("id").alias("l"))
    b = texts.select(F.col("doc_row").alias("right_id"), F.col("id").alias("r"))
    named = found.join(a, "left_id").join(b, "right_id").where("kind = 'benchmark' OR l != r")
    return named.select("kind", F.col("l").alias("left_id"), F.col("r").alias("right_id"), "share", "exact")


ORACLE_SQL = f"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE
    WHEN len(w) >= {WORDS} THEN list_transform(generate_series(1, len(w) - {WORDS - 1}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM t)
SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(s, lambda x: substr(md5(x), 1, 16)), lambda h: h < '{LIMIT}'))) AS sketch FROM s
"""
