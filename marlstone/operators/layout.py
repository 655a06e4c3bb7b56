"""Page layout: noise lines, boxes, captions, headings and section cards, from tables of lines and boxes that a decoder gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as X

CAPTION = r"^(?i)fig(ure)?\.?\s+[0-9]+\s*[:.–-]"


def is_noise(header_height: float = 90.0, heading_size: float = 9.5) -> Column:
    """Whether a line (text, y0, bold, size) is blank, a running header, a page number, a caption or a heading."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return (text == "") | ((F.col("y0") < header_height) & ~F.col("bold") & text.rlike("(?i)(specification|revision|version)")) | text.rlike("^[0-9]{1,4}$") | text.rlike(CAPTION) | (F.col("bold") & (F.col("size") >= heading_size))


def heading_candidates(lines: DataFrame, size: float = 9.5) -> DataFrame:
    """Bold lines of at least that size that aren't captions or page numbers."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return lines.where(F.col("bold") & (F.col("size") >= size) & (text != "") & ~text.rlike("^[0-9]{1,4}$") & ~text.rlike(CAPTION))


def outside_boxes(lines: DataFrame, boxes: DataFrame, slack: float = 1.0) -> DataFrame:
    """Lines (page, x0, y0, x1, y1, …) whose centre lies in no box (page, bx0, by0, bx1, by1) of their page."""
    at_x, at_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    b = boxes.select(F.col("page").alias("__p"), "bx0", "by0", "bx1", "by1")
    inside = (F.col("page") == F.col("__p")) & at_x.between(F.col("bx0") - slack, F.col("bx1") + slack) & at_y.between(F.col("by0") - slack, F.col("by1") + slack)
    return lines.join(b, inside, "left_anti")


def containment(boxes: DataFrame, slack: float = 2.0) -> DataFrame:
    """boxes (page, box_id, x0, y0, x1, y1) with `parent`, the smallest other box of the page that encloses it; equal boxes enclose nothing."""
    other = boxes.select(F.col("page").alias("op"), F.col("box_id").alias("o"), *[F.col(c).alias("o" + c) for c in ("x0", "y0", "x1", "y1")])
    encloses = (F.col("page") == F.col("op")) & (F.col("box_id") != F.col("o")) & (F.col("ox0") <= F.col("x0") + slack) & (F.col("oy0") <= F.col("y0") + slack) & (F.col("ox1") >= F.col("x1") - slack) & (F.col("oy1") >= F.col("y1") - slack)
    differs = F.struct("ox0", "oy0", "ox1", "oy1") != F.struct("x0", "y0", "x1", "y1")
    area = (F.col("ox1") - F.col("ox0")) * (F.col("oy1") - F.col("oy0"))
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    found = boxes.join(other, encloses & differs & (area >= own)).groupBy("page", "box_id").agg(F.min_by("o", F.struct(area.alias("a"), "o")).alias("parent"))
    return boxes.join(found, ["page", "box_id"], "left")


def captions(tables: DataFrame, blocks: DataFrame, reach: float = 80.0, overlap: float = 2.0) -> DataFrame:
    """tables (page, table_id, top) with figure_number and caption of the nearest `Figure N:` block (page, y1, text) above, at most `reach` away."""
    named = blocks.where(F.col("text").rlike(CAPTION)).select(F.col("page").alias("__p"), "y1", F.trim("text").alias("caption"))
    gap = F.col("top") - F.col("y1")
    met = tables.join(named, (F.col("page") == F.col("__p")) & gap.between(-overlap, reach))
    best = met.groupBy("table_id").agg(F.min_by("caption", F.struct(gap.alias("g"), "caption")).alias("caption"))
    return tables.join(best, "table_id", "left").withColumn("figure_number", F.expr("try_cast(nullif(regexp_extract(caption, '([0-9]+)', 1), '') as int)"))


def outline(bookmarks: DataFrame, offset: int = 0) -> DataFrame:
    """Outline entries (toc_ord, section_number, title, level, target_page) of bookmarks (toc_ord, level, title, page); titles without a number go."""
    numbered = r"^\s*([0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)*)\.?\s+(\S.*)$"
    annex = r"^\s*(?i)annex\s+([A-Z])\b[\s.:–-]*(.*)$"
    pick = lambda g: F.coalesce(F.nullif(F.regexp_extract("title", annex, g), F.lit("")), F.nullif(F.regexp_extract("title", numbered, g), F.lit("")))
    out = bookmarks.withColumn("section_number", pick(1)).withColumn("name", pick(2)).where("section_number IS NOT NULL")
    return out.select("toc_ord", "section_number", F.trim(F.coalesce("name", F.lit(""))).alias("title"), "level", (F.col("page") - offset).alias("target_page"))


def deep_sections(lines: DataFrame, least_depth: int = 4) -> DataFrame:
    """(section_number, title, page) of bold lines that are a deep number with its title, or a number whose title is the next line of the page."""
    w = W.partitionBy("page").orderBy("line_no")
    bold = lines.where("bold").withColumn("next", F.lead("text").over(w))
    pattern = rf"^\s*([0-9]+(?:\.[0-9]+){{{least_depth - 1},}})\s*(.*)$"
    found = bold.withColumn("section_number", F.regexp_extract("text", pattern, 1)).where("section_number <> ''").withColumn("rest", F.trim(F.regexp_extract("text", pattern, 2)))
    title = F.when(F.col("rest") != "", F.col("rest")).otherwise(F.trim("next"))
    return found.select("section_number", title.alias("title"), "page", "line_no").where("title IS NOT NULL AND title <> ''")


def find_headings(toc: DataFrame, lines: DataFrame, before: int = 1, after: int = 4) -> DataFrame:
    """(spec, toc_ord, page, line_no) of the body heading of each outline entry; nulls where there is none.

    Entries are taken in order, each from where the last was found on, on pages near its own; up to three lines together
    may make a title, and an equal one goes before one that only begins so. The cursor makes this a fold over one outline, which is small, in pandas.
    """
    t = toc.select("spec", "toc_ord", X.normal_title(F.concat_ws(" ", "section_number", "title")).alias("want"), X.normal_title(F.col("title")).alias("bare"), "target_page")
    c = lines.select("spec", "page", "line_no", X.normal_title(F.col("text")).alias("text"))

    def match(key: tuple, entries: pd.DataFrame, body: pd.DataFrame) -> pd.DataFrame:
        entries, body = entries.sort_values("toc_ord"), body.sort_values(["page", "line_no"])
        spots = list(zip(body["page"], body["line_no"], body["text"], strict=True))
        cursor, out = 0, []
        for o, want, bare, target in zip(entries["toc_ord"], entries["want"], entries["bare"], entries["target_page"], strict=True):
            best = None
            for k in range(cursor, len(spots)):
                page = spots[k][0]
                if page < target - before:
                    continue
                if page >= target + after:
                    break
                for n in (1, 2, 3):
                    said = " ".join(x[2] for x in spots[k : k + n] if x[0] == page)
                    if said in (want, bare):
                        best = (0, k)
                        break
                    if best is None and said and want.startswith(said + " ") and len(said) >= 8:
                        best = (1, k)
                if best and best[0] == 0:
                    break
            if best:
                cursor = best[1] + 1
            out.append((key[0], o, *(spots[best[1]][:2] if best else (None, None))))
        return pd.DataFrame(out, columns=["spec", "toc_ord", "page", "line_no"]).astype({"page": "Int64", "line_no": "Int64"})

    return t.groupBy("spec").cogroup(c.groupBy("spec")).applyInPandas(match, "spec string, toc_ord int, page int, line_no int")


def section_ends(found: DataFrame, last_page: int) -> DataFrame:
    """found (spec, toc_ord, page) with `end_page`: the start of the next section that was found, or the end of the document."""
    w = W.partitionBy("spec").orderBy("toc_ord").rowsBetween(1, W.unboundedFollowing)
    return found.withColumn("end_page", F.when(F.col("page").isNotNull(), F.coalesce(F.first("page", ignorenulls=True).over(w), F.lit(last_page))))


def cards(toc: DataFrame, tables: DataFrame, normative: DataFrame, edges: DataFrame, summaries: DataFrame) -> DataFrame:
    """One card for each section of toc (section_number, title, level): parent, children, figures, count of normative sentences, edges, and its summary if there is one.

    tables are (section_number, figure_number), normative (section_number), edges (node, edge_ord), summaries (section_number, summary).
    """
    name = F.col("section_number")
    known = toc.select(name.alias("parent_section"))
    base = toc.withColumn("parent_section", X.parent(name)).join(known.withColumn("__k", F.lit(True)), "parent_section", "left").withColumn("parent_section", F.when(F.col("__k"), F.col("parent_section"))).drop("__k")
    children = base.where("parent_section IS NOT NULL").groupBy(F.col("parent_section").alias("section_number")).agg(F.transform(F.array_sort(F.collect_list(F.struct(X.natural_key(name).alias("k"), name.alias("v")))), lambda x: x["v"]).alias("child_sections"))
    figures = tables.groupBy("section_number").agg(F.array_sort(F.collect_set("figure_number")).alias("tables"))
    counts = normative.groupBy("section_number").agg(F.count(F.lit(1)).alias("normative_count"))
    touching = edges.where(F.col("node").startswith("section:")).groupBy(F.expr("substring(node, 9)").alias("section_number")).agg(F.array_sort(F.collect_list("edge_ord")).alias("edges"))
    out = base
    for part in (children, figures, counts, touching, summaries):
        out = out.join(part, "section_number", "left")
    return out.select("section_number", "title", "level", "parent_section", F.coalesce("child_sections", F.array().cast("array<string>")).alias("child_sections"), F.coalesce("tables", F.array().cast("array<string>")).alias("tables"), F.coalesce("normative_count", F.lit(0)).alias("normative_count"), F.coalesce("edges", F.array().cast("array<long>")).alias("edges"), F.coalesce("summary", F.lit("")).alias("summary"))


def card_prefix(section: Column, title: Column, summary: Column) -> Column:
    """What chunks of a section are led by: its id, title and summary; nothing without a summary."""
    return F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", F.concat(F.lit("["), section, F.lit(" — "), title, F.lit("] "), summary)).otherwise("")


def full_text(corpus: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(qid, doc_id, score) by how close together a text (doc_id, title, text) holds all words of a query.

    Words match by their stem. The score is the number of words over the length of the shortest stretch with all of them, titles
    weighing 1 and bodies 0.4. This is a cover-density rank of our own, not one that is score-compatible with a database's.
    """
    stem = lambda w: F.regexp_replace(w, "(?<=[a-z]{3})(ations?|ings?|ed|es|s|ly|e)$", "")
    posts = corpus.select("doc_id", F.explode(F.array(F.struct(F.lit(1.0).alias("w"), X.tokens(F.col("title")).alias("ts")), F.struct(F.lit(0.4).alias("w"), X.tokens(F.col("text")).alias("ts")))).alias("z"))
    posts = posts.select("doc_id", "z.w", F.posexplode(F.transform("z.ts", lambda t: stem(t))).alias("pos", "t"))
    asked = queries.select("qid", F.array_distinct(F.transform(X.tokens(F.col("query")), lambda t: stem(t))).alias("ts")).withColumn("n", F.size("ts"))
    hits = posts.join(asked.select("qid", "n", F.explode("ts").alias("t")), "t").groupBy("qid", "doc_id", "w", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("hits"))

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = []
            for n, found in zip(b["n"], b["hits"], strict=True):
                seen, best = {}, None
                for h in found:
                    seen[h["t"]] = h["pos"]
                    if len(seen) == n:
                        span = h["pos"] - min(seen.values()) + 1
                        best = span if best is None else min(best, span)
                scores.append(0.0 if best is None else n / best)
            yield b[["qid", "doc_id", "w"]].assign(score=scores)

    scored = hits.mapInPandas(cover, "qid long, doc_id long, w double, score double")
    total = scored.groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("score")).alias("score")).where("score > 0")
    return total.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= limit)
