"""Reference edges and entities as tables: extraction, merging, canonical names, aliases, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.session import materialize

#: What stands right before a reference that is more than a mention.
STRONG = r"(?i)(see|refer(s|red|ring)? to|referenced (in|by)|according to|as (per|in)|(as )?(defined|described|specified|shown|indicated|listed) in)\s*$"


def hierarchy(child: DataFrame, kind: str = "child_of") -> DataFrame:
    """Edges from nodes (src, dst) whose parent exists as one: (source, target, type)."""
    return child.where("dst IS NOT NULL").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(kind).alias("type")).distinct()


def references(texts: DataFrame) -> DataFrame:
    """Edges (source, target, type, evidence, strength) of texts (source, text) that name sections (dotted numbers) or figures (up to 999).

    The text is cut at each reference, so what stands before one, which decides its strength, is the end of the piece before.
    """
    mark = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)\b(figures?\s+[0-9]+|(?:clause|section)s?\s+[0-9]+(?:[.][0-9]+)+[a-z]?)", "\u0001$1\u0002")
    pieces = texts.select("source", F.posexplode(F.split(mark, "\u0001")).alias("i", "piece"), F.split(mark, "\u0001").alias("all")).where("i > 0")
    ref = F.substring_index("piece", "\u0002", 1)
    number = F.regexp_extract(ref, r"([0-9]+(?:[.][0-9]+)*[a-z]?)$", 1)
    before = F.regexp_replace(F.element_at("all", F.col("i")), "\u0002", "")
    is_figure = F.lower(ref).startswith("figure")
    named = pieces.select(
        "source",
        F.when(is_figure, F.concat(F.lit("figure:"), number)).otherwise(F.concat(F.lit("section:"), number)).alias("target"),
        F.lit("references").alias("type"),
        F.concat(F.expr("right(replace(all[i - 1], '\u0002', ''), 40)"), ref).alias("evidence"),
        F.when(F.expr("right(replace(all[i - 1], '\u0002', ''), 30)").rlike(STRONG), "strong").otherwise("mention").alias("strength"),
        is_figure.alias("f"),
        number.alias("n"),
    )
    del before
    return named.where(F.when(F.col("f"), F.col("n").cast("long") <= 999).otherwise(F.size(F.split("n", r"\.")) <= 6)).where("source <> target").drop("f", "n")


def dedup_strength(edges: DataFrame) -> DataFrame:
    """One edge (source, target, type) each: the first evidence of the strongest, strong before mention before none."""
    rank = F.when(F.col("strength") == "strong", 2).when(F.col("strength") == "mention", 1).otherwise(0)
    best = F.struct(rank.alias("r"), (-F.col("edge_ord")).alias("o"))
    return edges.groupBy("source", "target", "type").agg(F.max_by("evidence", best).alias("evidence"), F.max_by("strength", best).alias("strength"), F.min("edge_ord").alias("edge_ord"))


def merge_confidence(edges: DataFrame) -> DataFrame:
    """One edge (source, target, type) each of several finders (found_by, confidence, evidence, edge_ord).

    Deterministic confidence prevails and the last such evidence with it; else the first evidence stays. The first five distinct evidences
    are listed where there is more than one, and the finders, sorted.
    """
    sure = F.col("confidence") == "deterministic"
    all_ = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", "evidence"))), lambda x: x["evidence"]))
    grouped = edges.groupBy("source", "target", "type").agg(
        F.when(F.max(sure), "deterministic").otherwise(F.min_by("confidence", "edge_ord")).alias("confidence"),
        F.coalesce(F.max_by(F.when(sure, F.col("evidence")), F.when(sure, F.col("edge_ord"))), F.min_by("evidence", "edge_ord")).alias("evidence"),
        all_.alias("all"),
        F.array_sort(F.collect_set("found_by")).alias("confirmed_by"),
    )
    return grouped.withColumn("evidence_all", F.when(F.size("all") > 1, F.slice("all", 1, 5))).drop("all")


def canonical_names(nodes: DataFrame) -> DataFrame:
    """(kind, key, name) of nodes (kind, name, ord): the most frequent normal spelling of each key, the first seen on ties."""
    norm = nodes.withColumn("norm", X.normal_node(F.col("kind"), F.col("name"))).where("norm <> ''").withColumn("key", F.lower("norm"))
    counts = norm.groupBy("kind", "key", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return counts.groupBy("kind", "key").agg(F.max_by("norm", F.struct("n", (-F.col("first")).alias("f"))).alias("name"))


def aliases(nodes: DataFrame) -> DataFrame:
    """(kind, name, aliases) of canonical names with other raw spellings, those by count, then spelling."""
    canon = canonical_names(nodes)
    raw = nodes.withColumn("key", F.lower(X.normal_node(F.col("kind"), F.col("name")))).groupBy("kind", "key", F.col("name").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    other = raw.join(canon, ["kind", "key"]).where("raw <> name")
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "raw"))), lambda x: x["raw"])
    return other.groupBy("kind", "name").agg(listed.alias("aliases"))


def canonical_edges(edges: DataFrame, canon: DataFrame, sections: DataFrame) -> DataFrame:
    """Edges with both ends (type:name) in their canonical spelling, without those that name no known section (name) or nothing."""

    def end(df: DataFrame, c: str) -> DataFrame:
        kind = F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1)).otherwise("entity")
        name = F.when(F.instr(c, ":") > 0, F.expr(f"substring({c}, instr({c}, ':') + 1)")).otherwise(F.col(c))
        keyed = df.withColumn("kind", kind).withColumn("__n", X.normal_node(kind, name)).withColumn("key", F.lower("__n"))
        out = keyed.join(canon, ["kind", "key"], "left").withColumn("__n", F.coalesce("name", "__n")).where("__n <> ''")
        known = sections.select(F.lit("section").alias("kind"), F.col("name").alias("__n"), F.lit(True).alias("__known")).distinct()
        out = out.join(known, ["kind", "__n"], "left").where("kind <> 'section' OR __known")
        return out.withColumn(c, F.concat_ws(":", "kind", "__n")).drop("kind", "key", "__n", "name", "__known")

    return end(end(edges, "source"), "target")


def endpoints(edges: DataFrame) -> DataFrame:
    """(node, edge_ord) for both ends of every edge; a self-edge is listed twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("node"), "edge_ord")


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, hop): nodes within so many steps of seeds (seed), edges (source, target) taken both ways, with the fewest steps."""
    ways = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    found = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    edge = found
    for k in range(1, hops + 1):
        step = edge.join(ways, edge["node"] == ways["a"]).select("seed", F.col("b").alias("node")).distinct()
        edge = materialize(step.join(found, ["seed", "node"], "left_anti").withColumn("hop", F.lit(k)), "hop")
        found = found.unionByName(edge)
    return found.where("hop > 0")
