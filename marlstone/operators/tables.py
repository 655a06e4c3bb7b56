"""Tables of extracted documents: cells, concepts, register containers, details of fields, nested tables, rows kept for a lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators.structure import table_class

#: Concepts: what their table captions say, what such captions may not say, what a query says that asks for them, and their label, in order.
CONCEPTS = (
    ("fid", r"(?i)feature identifiers", r"(?i)effects", r"(?i)\bfeatures?\b|\bFID\b", "Feature Identifier"),
    ("opcode", r"(?i)opcodes for", None, r"(?i)\bopcodes?\b|\bcommand\b", "Command Opcode"),
    ("lid", r"(?i)log page identifiers", r"(?i)\ballowed\b", r"(?i)\blog\s+(page\b|identifier)|\bLID\b", "Log Page Identifier"),
    ("cns", r"(?i)CNS values", None, r"(?i)\bCNS\b", "CNS Value"),
    ("status", r"(?i)status code", r"(?i)dword 0|permitted to return", r"(?i)\bstatus\s+(code|value)", "Status Code"),
)


def header_cell(cell: Column) -> Column:
    """A header cell on one line, without the lone footnote digits before capitals."""
    flat = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))
    # a mark stands in for the capital that follows, so that the next digit may share its space
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"^[0-9] +([A-Z])", "$1"), r" [0-9] +(?=[A-Z])", " "))


def data_cell(cell: Column) -> Column:
    """A data cell on one line; of footnote numbers before requirement letters M, O, R or P the letters stay."""
    flat = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))
    return F.regexp_replace(flat, r"^[0-9][,0-9]* +([MORP](/[MORP])*)$", "$1")


def concepts_of(caption: Column) -> Column:
    """The concepts whose tables such a caption names, in order."""
    said = F.coalesce(caption, F.lit(""))
    rules = [F.when(said.rlike(want) & (~said.rlike(never) if never else F.lit(True)), name) for name, want, never, _, _ in CONCEPTS]
    return F.array_compact(F.array(*rules))


def concepts_asked(query: Column, kinds: Column) -> Column:
    """The concepts that a query asks for, by its words or the kinds of its entities, in order."""
    said = F.coalesce(query, F.lit(""))
    return F.array_compact(F.array(*[F.when(F.coalesce(F.array_contains(kinds, name), F.lit(False)) | said.rlike(words), name) for name, _, _, words, _ in CONCEPTS]))


def register_containers(tables: DataFrame) -> DataFrame:
    """A field for each register that a caption of tables (table_ord, figure_number, caption) places, `Offset 1Ch: CSTS - Controller Status`; the first of a name."""
    dash = "[:\\-–—�?]"
    rule = rf"^(?:Figure\s+[0-9]+\s*[:\-–—]\s*)?Offset\s+([0-9A-Fa-f]+h)\s*{dash}\s*([A-Z][A-Z0-9]+)\s*[\-–—�?]\s*(.+)$"
    said = F.trim(F.coalesce("caption", F.lit("")))
    part = lambda i: F.regexp_extract(said, rule, i)
    found = tables.select("table_ord", "figure_number", said.alias("caption"), part(1).alias("offset"), part(2).alias("field_name"), F.trim(part(3)).alias("full_name")).where("field_name <> ''")
    first = found.groupBy("field_name").agg(F.min_by(F.struct("full_name", "figure_number", "caption", "offset"), "table_ord").alias("r"))
    return first.select("field_name", "r.*", F.lit("register_container").alias("parent_type"), F.lit("offset").alias("offset_type"), F.concat("r.full_name", F.lit(" register, located at offset "), "r.offset", F.lit(".")).alias("description"))


def field_details(tables: DataFrame) -> DataFrame:
    """Fields of tables (figure_number, caption, headers, rows) that aren't of class other: names, offset, requirements, register type and reset, values, references, description.

    A field is a row whose description, the cell under the first header that speaks of one, or else the last, begins `Full name (ABBR):`. Values are
    the rows of a pipe table in the description below its rule, which the description itself is left without.
    """
    low = F.transform("headers", lambda h: F.lower(F.trim(h)))
    at = F.coalesce(F.expr("nullif(array_position(transform(low, h -> h like '%description%' or h like '%definition%'), true), 0)"), F.size("headers"))
    each = tables.withColumn("parent_type", table_class(F.col("headers"))).where("parent_type <> 'other'").withColumn("low", low).withColumn("at", at.cast("int"))
    rows = each.select("figure_number", "caption", "headers", "low", "at", "parent_type", F.posexplode("rows").alias("row_idx", "cells")).where((F.size("cells") >= F.col("at")) & (F.col("at") > 0))
    text = F.element_at("cells", F.col("at"))
    pattern = r"^\s*([^():]{3,120}?)\s*\(([A-Z][A-Z0-9.]{1,15})\):"
    found = rows.withColumn("desc", text).withColumn("field_name", F.regexp_extract("desc", pattern, 2)).where("field_name <> ''")
    marks = ["M", "O", "R", "P", "M/O", "O/R", "M/P"]
    between = F.when((F.size("headers") >= 3) & (F.size("cells") >= 3), F.sequence(F.lit(2), F.least(F.size("headers") - 1, F.size("cells")))).otherwise(F.array().cast("array<int>"))
    needs = F.filter(F.transform(between, lambda i: F.struct(F.trim(F.element_at("headers", i)).alias("header"), F.trim(F.element_at("cells", i)).alias("mark"))), lambda x: x["mark"].isin(marks))
    cell = lambda name: F.when(F.col("parent_type") == "register", F.expr(f"nullif(trim(try_element_at(cells, cast(nullif(array_position(low, '{name}'), 0) as int))), '')"))
    lines = F.transform(F.split("desc", "\n"), lambda s: F.trim(s))
    is_rule, is_row = (lambda s: s.rlike(r"^\|[\s:|-]*-[\s:|-]*\|$")), (lambda s: s.rlike(r"^\|[^|]*\|.*\|$"))
    under = F.expr("slice(lines, cast(rule + 1 as int), size(lines))")
    pairs = F.filter(
        F.transform(F.filter(under, lambda s: is_row(s) & ~is_rule(s)), lambda s: F.struct(F.trim(F.regexp_extract(s, r"^\|([^|]*)\|", 1)).alias("value"), F.trim(F.regexp_extract(s, r"^\|[^|]*\|([^|]*)\|", 1)).alias("meaning"))),
        lambda x: (x["value"] != "") & (x["meaning"] != ""),
    )
    ref = lambda kind, rule: F.transform(F.regexp_extract_all("desc", F.lit(rule), F.lit(1)), lambda x: F.concat(F.lit(f"{kind}:"), x))
    prose = F.regexp_replace(F.array_join(F.filter("lines", lambda s: ~is_row(s) & ~is_rule(s)), "\n"), pattern, "")
    out = found.withColumn("lines", lines).withColumn("rule", F.expr(r"array_position(transform(lines, s -> s rlike '^\\|[\\s:|-]*-[\\s:|-]*\\|$'), true)"))
    return out.select(
        "figure_number",
        F.col("caption").alias("parent_caption"),
        "parent_type",
        "row_idx",
        "field_name",
        F.trim(F.regexp_extract("desc", pattern, 1)).alias("full_name"),
        F.trim(F.element_at("cells", 1)).alias("offset"),
        F.expr("CASE WHEN low[0] LIKE '%bit%' THEN 'bits' WHEN low[0] LIKE '%byte%' THEN 'bytes' WHEN low[0] LIKE '%offset%' THEN 'offset' END").alias("offset_type"),
        F.when(F.col("parent_type") == "data_structure", needs).otherwise(F.expr("cast(array() as array<struct<header: string, mark: string>>)")).alias("requirements"),
        cell("type").alias("register_type"),
        cell("reset").alias("register_reset"),
        F.when(F.col("rule") > 0, pairs).otherwise(F.expr("cast(array() as array<struct<value: string, meaning: string>>)")).alias("values"),
        F.array_distinct(F.concat(ref("section", r"(?i)\bsections?\s+([0-9A-Z]+(?:\.[0-9]+)+)"), ref("figure", r"(?i)\bfigures?\s+([0-9]+)"))).alias("cross_refs"),
        F.trim(prose).alias("description"),
    )


def nested_markdown(headers: Column, rows: Column) -> Column:
    """A table as markdown with pipes: header, rule, rows, short ones filled; pipes within cells are escaped. Nothing for an empty table."""
    n = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    fill = lambda r: F.concat(F.transform(r, lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))), F.array_repeat(F.lit(""), (n - F.size(r)).cast("int")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(fill(r), " | "), F.lit(" |"))
    head = F.when(F.size(headers) > 0, F.array(line(headers), F.concat(F.lit("|"), F.repeat(F.lit("---|"), n.cast("int"))))).otherwise(F.array().cast("array<string>"))
    return F.when(n <= 0, F.lit("")).otherwise(F.array_join(F.concat(head, F.transform(rows, line)), "\n"))


def nested_inline(headers: Column, rows: Column) -> Column:
    """A table in one line, for a place where pipes would clash: `[a / b: 1 → 2; 3 → 4]`."""
    n = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    clean = lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" ")))
    line = lambda r: F.array_join(F.concat(F.transform(r, clean), F.array_repeat(F.lit(""), (n - F.size(r)).cast("int"))), " → ")
    body = F.array_join(F.transform(rows, line), "; ")
    return F.when(n <= 0, F.lit("")).otherwise(F.concat(F.lit("["), F.when(F.size(headers) > 0, F.concat(F.array_join(F.transform(headers, clean), " / "), F.lit(": "))).otherwise(F.lit("")), body, F.lit("]")))


def inlined(cells: DataFrame, inner: DataFrame) -> DataFrame:
    """cells (table_id, row_no, col_no, text) with the text of each table inside one replaced by its rendering, in order.

    inner is (table_id, row_no, col_no, inner_ord, depth, raw, headers, rows): raw is the text of the inner table as it stands in the cell. Tables of depth 1 become
    markdown, deeper ones one line. One whose text isn't found is put at the end, on a line of its own.
    """
    shown = inner.withColumn("shown", F.when(F.col("depth") == 1, nested_markdown(F.col("headers"), F.col("rows"))).otherwise(nested_inline(F.col("headers"), F.col("rows"))))
    lists = shown.groupBy("table_id", "row_no", "col_no").agg(F.array_sort(F.collect_list(F.struct("inner_ord", "raw", "shown"))).alias("__in"))
    joined = cells.join(lists, ["table_id", "row_no", "col_no"], "left")

    def put(text, x):
        at = F.when(F.coalesce(x["raw"], F.lit("")) == "", F.lit(0)).otherwise(F.instr(text, x["raw"]))
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), x["shown"], F.substring(text, at + F.length(x["raw"]), F.length(text)))).when(x["shown"] == "", text).when(text == "", x["shown"]).otherwise(F.concat(text, F.lit("\n"), x["shown"]))

    text = F.coalesce("text", F.lit(""))
    return joined.withColumn("text", F.when(F.col("__in").isNull(), F.col("text")).otherwise(F.aggregate("__in", text, put))).drop("__in")


def kept_rows(rows: Column, names: Column, full_names: Column, ranges: Column) -> Column:
    """The rows of a table (array of arrays) that matter to a lookup of fields by these names, all where no field is asked or none is found.

    A row is a field's if its text, upper-cased, holds a full name, or a name in parentheses or before a colon. After it follow rows whose first cell overlaps one of the
    ranges (structs a, b), or, without ranges, up to 12 rows where the field's row speaks of nested ones; a row of four cells or more that is neither ends the field.
    """
    none = rows.isNull() | (F.size(names) + F.size(full_names) == 0)
    strings = lambda r: F.upper(F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " "))
    start = F.struct(F.array().cast("array<array<string>>").alias("kept"), F.lit(False).alias("in"), F.lit(0).alias("left"))

    def step(s, r):
        t = strings(r)
        own = F.exists(full_names, lambda n: F.contains(t, F.upper(n))) | F.exists(names, lambda n: F.contains(t, F.concat(F.lit("("), F.upper(n), F.lit(")"))) | F.contains(t, F.concat(F.upper(n), F.lit(":"))))
        span = X.offset_bounds(F.element_at(r, 1))
        near = s["in"] & F.exists(ranges, lambda x: F.coalesce(X.overlaps(span["lo"], span["hi"], x["a"], x["b"]), F.lit(False)))
        more = s["in"] & (F.size(ranges) == 0) & (s["left"] > 0)
        add = F.concat(s["kept"], F.array(r))
        follow = F.when(F.contains(t, F.lit("BITS | DESCRIPTION")) | F.contains(t, F.lit("VALUE |")), 12).otherwise(0)
        ends = s["in"] & (F.size(r) >= 4)
        return (
            F.when(own, F.struct(add.alias("kept"), F.lit(True).alias("in"), follow.alias("left")))
            .when(near, F.struct(add.alias("kept"), s["in"].alias("in"), s["left"].alias("left")))
            .when(more, F.struct(add.alias("kept"), s["in"].alias("in"), (s["left"] - 1).alias("left")))
            .otherwise(F.struct(s["kept"].alias("kept"), (s["in"] & ~ends).alias("in"), F.when(ends, 0).otherwise(s["left"]).alias("left")))
        )

    found = F.aggregate(rows, start, step)["kept"]
    return F.when(none | (F.size(found) == 0), rows).otherwise(found)


def confidence(fields: Column, tables: Column, ranged: Column) -> Column:
    """HIGH for one field, with a table where a range was asked; MEDIUM for anything else found; LOW for nothing."""
    return F.when((fields == 1) & (~ranged | (tables > 0)), "HIGH").when((fields > 0) | (tables > 0), "MEDIUM").otherwise("LOW")


def enum_hits(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, place, concept, value, name, text): entries of index (concept, value, value_hex, name, figures, sections) whose value and concept asked (qid, concepts, values) names.

    They come in the order of the concepts, values and names, each with a sentence that answers by itself.
    """
    labels = F.create_map(*[F.lit(x) for name, _, _, _, label in CONCEPTS for x in (name, label)])
    order = F.create_map(*[F.lit(x) for i, (name, *_) in enumerate(CONCEPTS) for x in (name, str(i))])
    wanted = asked.select("qid", F.explode(F.array_distinct("concepts")).alias("concept"), "values").select("qid", "concept", F.explode(F.array_distinct("values")).alias("value"))
    met = wanted.join(index, ["concept", "value"]).withColumn("label", F.coalesce(F.try_element_at(labels, F.col("concept")), F.upper("concept")))
    listed = lambda c, head: F.when(F.size(F.array_compact(F.col(c))) > 0, F.concat(F.lit(head), F.array_join(F.array_compact(F.col(c)), ", "), F.lit("."))).otherwise(F.lit(""))
    text = F.concat("label", F.lit(" "), "value_hex", F.lit(": "), "name", F.lit("."), listed("sections", " Defined in section "), listed("figures", " Listed in Figure "))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.try_element_at(order, F.col("concept")), "value", "name"))
    return met.select("qid", place.alias("place"), "concept", "value", "name", text.alias("text"))
