"""Outlines: titles known nearby, title-only sections, merging into the outline, refreshed cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import structure as S

NEAR_PAGES = 3


def known_titles(headings: DataFrame, toc: DataFrame, near: int = NEAR_PAGES) -> DataFrame:
    """The headings (heading_id, text, page) that have, whatever case and punctuation, the title of an entry of toc (title, target_page) at most `near` pages away.

    Titles meet by an equi-join, and pages by bins of near + 1 pages, so a title that recurs on every page meets its neighbours only.
    """
    size = near + 1
    at = headings.withColumn("__t", X.normal_title(F.col("text"))).withColumn("__bin", F.floor(F.col("page") / size))
    entries = toc.select(X.normal_title(F.col("title")).alias("__t"), "target_page").distinct()
    spread = entries.withColumn("__bin", F.explode(F.array(*[F.floor(F.col("target_page") / size) + d for d in (-1, 0, 1)])))
    return at.join(spread, ["__t", "__bin"]).where(F.abs(F.col("page") - F.col("target_page")) <= near).select(*headings.columns).distinct()


def title_candidates(headings: DataFrame) -> DataFrame:
    """headings whose text may be a title without a number: 5 characters or more, no number or annex in front, no lone label, no case."""
    t = F.col("text")
    numbered = t.rlike(r"^[A-Z]?[0-9]+(\.[0-9]+)*\.?\s+[A-Z]") | t.rlike(r"^([A-Z]|[0-9]+)(\.[0-9]+){2,}\.?(\s|$)")
    label = t.endswith(":") & ~F.trim(F.regexp_replace(t, "^:+|:+$", "")).contains(" ")
    return headings.where((F.length(t) >= 5) & ~numbered & ~label & ~t.rlike("(?i)^annex\\s+[A-Z]") & ~t.rlike(r"^Case\s+[0-9]+"))


def title_only_sections(headings: DataFrame, toc: DataFrame) -> DataFrame:
    """(section_number, title, level, target_page) of bold titles that the outline lacks, numbered below the section they are in.

    headings are (heading_id, text, page), toc (toc_ord, section_number, title, level, target_page). The parent is the last third-level section whose
    pages, up to the next entry of that level or above, hold the heading, else the last second-level one that begins at or before it; headings
    without a parent are left out. Numbers of a parent follow in the order of page and heading_id and skip those that are taken.
    """
    new = title_candidates(headings).join(known_titles(headings, toc).select("heading_id"), "heading_id", "left_anti")
    upper = toc.where("level <= 3")
    w = W.partitionBy(F.lit(1)).orderBy("toc_ord")  # the outline of one document
    spans = upper.withColumn("hi", F.coalesce(F.lead("target_page").over(w), F.lit(9999))).where("level = 3")
    spans = spans.select(F.col("section_number").alias("span_id"), F.col("toc_ord").alias("ord"), F.col("target_page").alias("lo"), "hi")
    third = S.interval_join(new.select("heading_id", "page"), spans, "page", pick="last", half_open=True).where("span_id IS NOT NULL").select("heading_id", F.col("span_id").alias("third"))
    second = toc.where("level = 2").select("section_number", "target_page", "toc_ord")
    # of the second-level entries up to a page the last in order: a running maximum over the pages
    best = second.groupBy(F.col("target_page").alias("page")).agg(F.max(F.struct("toc_ord", "section_number")).alias("s"))
    events = best.select("page", F.lit(0).alias("kind"), "s", F.lit(None).cast(new.schema["heading_id"].dataType).alias("heading_id"))
    events = events.unionByName(new.select("page", F.lit(1).alias("kind"), F.lit(None).cast(best.schema["s"].dataType).alias("s"), "heading_id"))
    run = W.partitionBy(F.lit(1)).orderBy("page", "kind").rowsBetween(W.unboundedPreceding, 0)
    fallback = events.withColumn("s", F.max("s").over(run)).where("kind = 1").select("heading_id", F.col("s.section_number").alias("second"))
    placed = new.join(third, "heading_id", "left").join(fallback, "heading_id", "left").withColumn("parent", F.coalesce("third", "second")).where("parent IS NOT NULL")
    once = placed.withColumn("__t", X.normal_title(F.col("text"))).withColumn("__n", F.row_number().over(W.partitionBy("parent", "__t").orderBy("page", "heading_id"))).where("__n = 1")
    taken = toc.select(X.parent(F.col("section_number")).alias("parent"), F.regexp_extract("section_number", r"([0-9]+)$", 1).alias("n")).where("parent IS NOT NULL AND n <> ''").select("parent", F.col("n").cast("int").alias("n")).distinct()
    numbered = S.numbered_children(once.select("parent", F.struct("page", "heading_id").alias("ord"), "text", "page"), taken)
    return numbered.select(F.col("number").alias("section_number"), F.col("text").alias("title"), F.size(F.split("number", r"\.")).alias("level"), F.col("page").alias("target_page"))


def merged_outline(toc: DataFrame, new: DataFrame) -> DataFrame:
    """toc and those of new (both new_ord or toc_ord, section_number, title, level, target_page) whose number neither toc nor an earlier one has; toc_ord counts them by page and number."""
    first = new.withColumn("__n", F.row_number().over(W.partitionBy("section_number").orderBy("new_ord"))).where("__n = 1").join(toc.select("section_number"), "section_number", "left_anti")
    names = ["section_number", "title", "level", "target_page"]
    both = toc.select(*names, F.lit(0).alias("__of"), F.col("toc_ord").alias("__o")).unionByName(first.select(*names, F.lit(1).alias("__of"), F.col("new_ord").alias("__o")))
    w = W.partitionBy(F.lit(1)).orderBy("target_page", X.natural_key(F.col("section_number")), "__of", "__o")  # one outline
    return both.select(*names, F.row_number().over(w).alias("toc_ord"))


def refreshed_cards(toc: DataFrame, structural: DataFrame, prior: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """A card for each section of toc (section_number, title, level): structure computed anew, summaries and keywords of the card it had.

    structural is (section_number, tables, prose_blocks, normative_count), prior (section_id, summary, keywords, and the columns of defaults). Sections
    without a card get an empty one with the defaults; cards of sections that are gone are dropped. `state` is preserved or new.
    """
    had = prior.withColumn("__had", F.lit(True))
    joined = toc.join(structural, "section_number", "left").join(had, F.col("section_number") == had["section_id"], "left").drop("section_id")
    children = toc.select(X.parent(F.col("section_number")).alias("p"), "section_number").where("p IS NOT NULL").groupBy("p").agg(F.array_sort(F.collect_list(F.struct(X.natural_key(F.col("section_number")).alias("k"), F.col("section_number").alias("s")))).alias("c"))
    joined = joined.join(children, F.col("section_number") == F.col("p"), "left")
    strings = F.array().cast("array<string>")
    return joined.select(
        F.col("section_number").alias("section_id"),
        "title",
        "level",
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("keywords", strings).alias("keywords"),
        X.parent(F.col("section_number")).alias("parent_section"),
        F.coalesce(F.transform("c", lambda x: x["s"]), strings).alias("child_sections"),
        F.coalesce(F.array_sort("tables"), strings).alias("tables"),
        F.coalesce("prose_blocks", F.array().cast("array<int>")).alias("prose_blocks"),
        F.coalesce("normative_count", F.lit(0)).cast("int").alias("normative_count"),
        *[F.when(F.col("__had"), F.col(k)).otherwise(F.lit(v)).alias(k) for k, v in defaults.items()],
        F.when(F.col("__had"), "preserved").otherwise("new").alias("state"),
    )
