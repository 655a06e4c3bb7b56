"""Text functions as Column expressions, with their DuckDB form where a query needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words that carry no search meaning, by length.
STOP_WORDS = tuple(
    sorted(
        (
            "yourselves themselves ourselves yourself because himself against between herself further itself through should myself having during "
            "theirs before about above after again being below could doing their there these those other until under "
            "which while where would yours hers both does down each from have here into just more most once only ours over same some such than that "
            "them then they this very were what when whom will with your been all and any are but did few for had has her him his how its nor not now "
            "off our out own she the too was who why you am an as at be by do he if in is it me my no of on or so to up we a i"
        ).split(),
        key=lambda w: (len(w), w),
        reverse=True,
    )
)


def once(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's argument isn't inlined into its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits without stop words; null text has none."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.filter(F.transform(runs, F.lower), lambda t: ~t.isin(list(STOP_WORDS)))


SQL_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: NOT list_contains({SQL_STOP}, x))"


def word_count(text: Column) -> Column:
    """Words separated by white space; 0 for null and blank text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))


def context_tokens(text: Column) -> Column:
    """Token estimate for budgets: a quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def chunk_tokens(words: Column) -> Column:
    """Token estimate of a chunk from its words, at 0.75 words a token."""
    return F.floor(words / F.lit(0.75)).cast("int")


def hex_value(text: Column) -> Column:
    """Value of a hexadecimal spelling, 22, 22h or 0x22; null for anything else."""
    digits = F.regexp_extract(F.trim(text), "^(?:0[xX])?([0-9A-Fa-f]{1,8})[hH]?$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def cell_value(cell: Column) -> Column:
    """Value of a table cell that is nothing but 0x and up to four hex digits, or such digits and h."""
    digits = F.coalesce(
        F.nullif(F.regexp_extract(F.trim(cell), "^0[xX]([0-9A-Fa-f]{1,4})$", 1), F.lit("")),
        F.nullif(F.regexp_extract(F.trim(cell), "^([0-9A-Fa-f]{1,4})[hH]$", 1), F.lit("")),
    )
    return F.conv(digits, 16, 10).cast("long")


def value_hex(value: Column) -> Column:
    """Two upper-case hex digits or more, and h."""
    h = F.hex(value)
    return F.concat(F.when(F.length(h) < 2, F.lpad(h, 2, "0")).otherwise(h), F.lit("h"))


def offset_bounds(offset: Column) -> Column:
    """Struct (lo, hi) of the first two numbers of an offset, 7:4, 15 to 08 or 03h:00h; nulls without a number or with words that aren't."""
    clean = F.lower(F.coalesce(offset, F.lit("")))
    numbers = F.regexp_extract_all(clean, F.lit(r"(^|[^a-z0-9])([0-9][0-9a-f]*h?)"), F.lit(2))
    value = lambda x: F.when(x.endswith("h"), F.conv(F.regexp_replace(x, "h$", ""), 16, 10)).otherwise(F.when(x.rlike("^[0-9]+$"), x)).cast("int")
    two = F.transform(F.slice(numbers, 1, 2), value)
    bad = clean.rlike("reserved|variable")
    return F.struct(F.when(~bad, F.array_min(two)).alias("lo"), F.when(~bad, F.array_max(two)).alias("hi"))


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Whether two closed ranges share a number."""
    return ~((a_hi < b_lo) | (b_hi < a_lo))


def ancestors(dotted: Column) -> Column:
    """The prefixes of a dotted id, itself included, from the top."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def parent(dotted: Column) -> Column:
    """A dotted id without its last part; null at the top."""
    return F.when(F.instr(dotted, ".") > 0, F.regexp_replace(dotted, r"\.[^.]*$", ""))


def natural_key(dotted: Column) -> Column:
    """Sort key of a dotted id: numbers by value and before letters."""
    return F.transform(
        F.split(dotted, r"\."),
        lambda p: F.struct(F.when(p.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"), F.when(p.rlike("^[0-9]+$"), p.cast("long")).otherwise(F.ascii(p).cast("long")).alias("value")),
    )


def normal_title(title: Column) -> Column:
    """Lower-cased title of ASCII letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " "), " +", " "))


def truncated(text: Column, most: int = 700) -> Column:
    """White space squeezed; longer texts cut at the last space within `most` characters, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, most)
    cut = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))


def normal_node(kind: Column, name: Column) -> Column:
    """Spelling of a graph node without a trailing parenthesis, a leading article, a suffix that repeats its type, and odd spaces."""
    flat = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    flat = F.regexp_replace(flat, r" *\([^()]*\)$", "")
    flat = F.regexp_replace(flat, "^(?i)(the|an|a) ", "")
    flat = F.when(kind == "command", F.regexp_replace(flat, "(?i) command$", "")).when(kind == "field", F.regexp_replace(flat, "(?i) (field|bits?)$", "")).when(kind == "register", F.regexp_replace(flat, "(?i) register$", "")).otherwise(flat)
    return F.regexp_replace(flat, " +([,.;:])", "$1")


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after . ! or ? and white space."""
    return F.split(text, r"(?<=[.!?])\s+")
