"""Exact deduplication by skew-safe combining.

Three stages, each of which compares whole texts because the text is a grouping key:

1. local: the map side of the first aggregation combines equal texts of one task;
2. salted: rows meet by (digest, salt, text), where the salt comes from the task they
   were read in, so the copies of one hot text spread over `salts` reducers;
3. global: the at most `salts` winners of each text meet by (digest, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_dedup(docs: DataFrame, salts: int = 16, counts: bool = False) -> DataFrame:
    """The documents that stay, one row for each distinct text: (doc_id, digest).

    doc_id is the smallest id among the copies, digest the MD5 of the text in hex. With `counts` a
    column n_copies says how many rows held the text.

    Null text: there is no content to compare, so every such row is kept on its own,
    with a null digest. Empty texts are equal to each other. Repeated rows (the same id
    and text) are copies. A null id counts only where no copy has an id. Other columns are
    ignored whatever their names. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.col("text").alias("content"))
    full = rows.where(F.col("content").isNotNull()).select(
        "doc_id",
        "content",
        F.md5("content").alias("digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    )
    salted = full.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "content").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))
    kept = winners.select("doc_id", "digest", F.col("n").alias("n_copies"))
    blank = rows.where(F.col("content").isNull()).select("doc_id", F.lit(None).cast("string").alias("digest"), F.lit(1).cast("long").alias("n_copies"))
    found = kept.unionByName(blank)
    return found if counts else found.drop("n_copies")


ORACLE_SQL = """
SELECT min(doc_id) AS doc_id, md5(text) AS digest
FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL
SELECT doc_id, NULL AS digest FROM documents WHERE text IS NULL
"""

COPIES_SQL = """
SELECT min(doc_id) AS doc_id, md5(text) AS digest, count(*) AS n_copies
FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL
SELECT doc_id, NULL AS digest, 1 AS n_copies FROM documents WHERE text IS NULL
"""
