"""Connected components of a large graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that an edge (u, v) touches; label is the smallest node of its component.

    Each round every node points to the smallest node among itself and its neighbours, pointers are
    followed twice, and edges move to what their ends point to; edges within one node vanish. At
    least the larger end of every edge is gone after a round, and stars take one. Rounds are written
    tables, so lineage stays short and a lost executor costs no more than its tasks. Self-loops give
    their node itself as label; repeated edges count once; edges with a null end are left out.
    """
    both = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    left = materialize(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    steps: list[DataFrame] = []
    while True:
        ways = left.select("u", "v").union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        for _ in range(2):
            up = near.select(F.col("node").alias("to"), F.col("to").alias("above"))
            near = near.join(up, "to", "left").select("node", F.coalesce("above", "to").alias("to"))
        near = materialize(near, "pointers")
        steps.append(near)
        moved = (
            left.join(near.select(F.col("node").alias("u"), F.col("to").alias("a")), "u")
            .join(near.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
            .where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct()
        )
        left = materialize(moved, "edges")
        if left.isEmpty():
            break
    found = steps[0].select("node", F.col("to").alias("label"))
    for step in steps[1:]:
        up = step.select(F.col("node").alias("label"), F.col("to").alias("above"))
        found = found.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return found
