"""What a question or an answer names, as Column expressions: entities, type, sub-queries, resources, verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import once

_HEX = r"(?:0[xX])?\p{XDigit}+h?"
_ENUM = r"(?:\p{XDigit}+h|0[xX]\p{XDigit}+|[0-9]\p{XDigit}*)"
#: kind, pattern whose first group is the value; in the order they are looked for.
KINDS = (
    ("fid", rf"(?i)\b(?:feature +identifier|fid) *[:=]? *({_HEX})\b"),
    ("lid", rf"(?i)\b(?:log +page +identifier|lid) *[:=]? *({_HEX})\b"),
    ("opcode", rf"(?i)\bop *code *[:=]? *({_ENUM})\b"),
    ("cns", rf"(?i)\bcns(?: +values?)? *[:=]? *({_ENUM})\b"),
    ("status", rf"(?i)\bstatus(?: +(?:code|value)s?)? *[:=]? *({_ENUM})\b"),
    ("cdw", r"(?i)\b(cdw *[0-9]{1,2}(?: *[\[] *[0-9]+ *: *[0-9]+ *[\]])?)"),
    ("figure", r"(?i)\bfig(?:ure|\.)? *([0-9]{1,4})\b"),
    ("section", r"(?:^|\s|§)([0-9]+(?:[.][0-9]+){1,5})\b"),
)
#: A literal with h at its end needs a digit, so that words such as each aren't one.
HEX = r"\b(\p{XDigit}*[0-9]\p{XDigit}*h|0[xX]\p{XDigit}+)\b"
_CAPS = r"\p{Lu}[0-9A-Z]{1,9}"
FIELD = rf"\b({_CAPS}(?:[.]{_CAPS})?)\b"


def _as(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))


def entities(query: Column, known: Column | None = None) -> Column:
    """array<struct<kind, text>>: values of each kind in order, hex literals that none of them holds, then field names among `known` (an array).

    A dotted field name that isn't known stands for those of its parts that are. Equal entities, whatever their case, count once.
    """
    q = F.coalesce(query, F.lit(""))
    base = F.concat(*[F.transform(F.regexp_extract_all(q, F.lit(p), F.lit(1)), _as(k)) for k, p in KINDS])

    def rest(found):
        literals = F.filter(F.regexp_extract_all(q, F.lit(HEX), F.lit(1)), lambda x: ~F.exists(found, lambda e: F.contains(F.upper(e["text"]), F.upper(x))))
        out = F.concat(found, F.transform(literals, _as("hex")))
        if known is not None:
            names = F.regexp_extract_all(q, F.lit(FIELD), F.lit(1))
            parts = F.flatten(F.transform(names, lambda n: F.when(F.array_contains(known, n), F.array(n)).otherwise(F.filter(F.split(n, r"\."), lambda p: F.array_contains(known, p)))))
            out = F.concat(out, F.transform(parts, _as("field")))
        return once(out, lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda d: (d["kind"] == e["kind"]) & (F.upper(d["text"]) == F.upper(e["text"])))))

    return once(base, rest)


#: Words that tell what kind of question it is.
PROCEDURAL = r"(?i)\b(set *up|configure|implement|initiali[sz]e|initialization|workflow|sequence|procedure|steps? +to|how +to)\b"
RELATIONAL = r"(?i)\b(which +commands? +use|how +do(es)?|between|compared? +to|vs|versus|differs?|difference|relat(e|ion)|interact(ion)?)\b"
STRUCTURAL = r"(?i)\b(data +structure|layout|structure|organized|how +is|what +is +(a|an|the)|explain|describe)\b"


def question_type(query: Column, found: Column) -> Column:
    """procedural, relational, structural or lookup, of a question and its entities."""
    kinds = F.size(F.array_distinct(F.transform(found, lambda e: e["kind"])))
    return (
        F.when(query.rlike(PROCEDURAL), "procedural")
        .when(query.rlike(RELATIONAL) | (F.size(found) >= 2) | (kinds >= 2), "relational")
        .when(query.rlike(STRUCTURAL), "structural")
        .when(F.size(found) > 0, "lookup")
        .otherwise("structural")
    )


def looks_up(found: Column) -> Column:
    """Whether the entities open the structured lookup."""
    return F.exists(found, lambda e: e["kind"].isin("cns", "fid", "field", "figure", "hex", "lid", "opcode", "status"))


def clean_subqueries(query: Column, given: Column, kind: Column, cap: int = 3) -> Column:
    """The sub-queries to run: 3 to 400 characters, white space squeezed, once each whatever the case; for lookups and structure the question itself."""
    squeezed = F.filter(F.transform(given, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s).between(3, 400))
    own = once(squeezed, lambda a: F.slice(F.filter(a, lambda s, i: ~F.exists(F.slice(a, F.lit(1), i), lambda d: F.lower(d) == F.lower(s))), F.lit(1), F.lit(cap)))
    return F.when(kind.isin("lookup", "structural") | (F.size(own) == 0), F.array(query)).otherwise(own)


def named_figures(text: Column) -> Column:
    """Figure numbers of a text, lists such as `Figures 3, 4 and 5` too, without leading zeros, once each."""
    lists = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\bfig(?:ure)?s?\.? +([0-9]{1,4}(?: *(?:&|and|,|/) *[0-9]{1,4})*)"), F.lit(1))
    digits = F.flatten(F.transform(lists, lambda g: F.regexp_extract_all(g, F.lit("([0-9]{1,4})"), F.lit(1))))
    return F.array_distinct(F.transform(digits, lambda d: F.regexp_replace(d, "^0+(?=.)", "")))


def named_sections(text: Column) -> Column:
    """Dotted section ids of a text, those of annexes too, once each."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b((?:[0-9]+|[A-Z])(?:[.][0-9]+)+)\b"), F.lit(1)))


def resources(missing: Column) -> Column:
    """struct(figures, sections) that a note on what is missing names: at most 8 and 5."""
    return F.struct(F.slice(named_figures(missing), 1, 8).alias("figures"), F.slice(named_sections(missing), 1, 5).alias("sections"))


VERDICT = "@@VERDICT@@"


def split_verdict(text: Column) -> Column:
    """struct(answer, verdict(answered, context_has_answer, missing)) of a text that may end in a verdict.

    Without the mark the text stays as it is; a verdict that isn't a JSON object is null, and the text is cut before the mark all the same.
    """
    has = F.instr(F.coalesce(text, F.lit("")), VERDICT) > 0
    tail = F.substring_index(text, VERDICT, -1)
    head = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(tail) - F.lit(len(VERDICT))), r"\s+$", "")
    body = F.regexp_extract(tail, r"(?s)(\{.*\})", 1)
    raw = F.from_json(body, "answered boolean, context_has_answer boolean, missing string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    ok = has & (body != "") & raw.isNotNull() & raw["_corrupt"].isNull()
    answered = F.coalesce(raw["answered"], F.lit(False))
    verdict = F.when(ok, F.struct(answered.alias("answered"), F.coalesce(raw["context_has_answer"], answered).alias("context_has_answer"), F.substring(F.coalesce(raw["missing"], F.lit("")), 1, 200).alias("missing")))
    return F.struct(F.when(has, head).otherwise(text).alias("answer"), verdict.alias("verdict"))


def hallucinated_ids(citations: Column, cap: int = 8) -> Column:
    """Ids of citations (section_id, hallucinated) that were made up but have the form of a section, once each."""
    bad = F.transform(F.filter(citations, lambda c: c["hallucinated"] & c["section_id"].rlike(r"^([0-9]+|[A-Z])([.][0-9]+)+$")), lambda c: c["section_id"])
    return F.slice(F.array_distinct(bad), 1, cap)
