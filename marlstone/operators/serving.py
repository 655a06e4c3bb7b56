"""What surrounds retrieval: hit shapes, logs, flags, progress, schema, presets, lookups by key, loaders of nested artifacts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X

#: The columns that every hit has, whatever found it, and their types.
HIT = (
    ("id", "string"), ("section_id", "string"), ("section_title", "string"), ("content_type", "string"), ("text_raw", "string"),
    ("pdf_pages", "array<int>"), ("figure_number", "string"), ("has_normative", "boolean"), ("spec", "string"), ("score", "double"),
)


def shaped(hits: DataFrame, method: str) -> DataFrame:
    """hits in the common shape: columns of HIT, null where hits lack one, pages never null, normative and score with a default, and the method."""
    default = {"pdf_pages": F.array().cast("array<int>"), "has_normative": F.lit(False), "score": F.lit(0.0)}
    cols = []
    for name, kind in HIT:
        c = F.col(f"`{name}`").cast(kind) if name in hits.columns else F.lit(None).cast(kind)
        cols.append((F.coalesce(c, default[name]) if name in default else c).alias(name))
    return hits.select(*cols, F.lit(method).alias("method"))


def grounded(citations: Column, gap_open: Column) -> Column:
    """Whether an answer rests on its context: no citation (struct with hallucinated) is made up, and no gap is left open. Null lists have none."""
    return ~F.coalesce(F.exists(citations, lambda c: F.coalesce(c["hallucinated"], F.lit(False))), F.lit(False)) & ~F.coalesce(gap_open, F.lit(False))


def log_rows(answers: DataFrame) -> DataFrame:
    """Log rows of answers (…, config): `spec` and `model` taken out of the JSON configuration, with spec base where it names none."""
    said = lambda key: F.get_json_object("config", f"$.{key}")
    return answers.withColumn("spec", F.coalesce(said("spec"), F.lit("base"))).withColumn("model", said("llm_model"))


def append_log(answers: DataFrame, path: str) -> None:
    """Append log_rows() to the log at path. The commit protocol shows all rows of a batch or none."""
    log_rows(answers).write.mode("append").parquet(path)


def with_flags(flags: DataFrame, new: DataFrame) -> DataFrame:
    """flags (id, …) and those of new whose id isn't taken; of several new ones with an id the first by created_at."""
    first = new.groupBy("id").agg(F.min_by(F.struct(*[c for c in flags.columns if c != "id"]), F.struct(*[c for c in flags.columns if c != "id"])).alias("__f"))
    fresh = first.join(flags.select("id"), "id", "left_anti").select("id", "__f.*").select(*flags.columns)
    return flags.unionByName(fresh)


def without_flags(flags: DataFrame, gone: DataFrame) -> DataFrame:
    """flags but for the ids of gone (id); a null id removes nothing."""
    return flags.join(gone.where("id IS NOT NULL").select("id").distinct(), "id", "left_anti").select(*flags.columns)


def progress_lines(events: DataFrame) -> DataFrame:
    """(request_id, ord, line): a JSON line for each step of events (request_id, ord, stage, detail, error), and a last one of kind done or error.

    A request ends at its first error; later steps aren't told. A request without one ends with done.
    """
    failed = events.where("error IS NOT NULL").groupBy("request_id").agg(F.min("ord").alias("at"))
    joined = events.join(failed, "request_id", "left").where("at IS NULL OR ord <= at")
    step = F.to_json(F.struct(F.lit("progress").alias("kind"), "stage", "detail"))
    bad = F.to_json(F.struct(F.lit("error").alias("kind"), F.col("error").alias("detail")))
    told = joined.select("request_id", "ord", F.when(F.col("error").isNotNull(), bad).otherwise(step).alias("line"))
    ended = joined.where("at IS NULL").groupBy("request_id").agg((F.max("ord") + 1).alias("ord"))
    return told.unionByName(ended.select("request_id", "ord", F.lit('{"kind":"done"}').alias("line")))


def tell_progress(stream: DataFrame, tell: Callable[[str, str], None], checkpoint: str):
    """A streaming query that hands every line of progress_lines() of each micro-batch to tell(request_id, line), in order within a request."""

    def each(batch: DataFrame, _: int) -> None:
        for row in progress_lines(batch).orderBy("request_id", "ord").toLocalIterator():
            tell(row.request_id, row.line)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


#: The tables of a corpus and their columns.
SCHEMA = {
    "sections": "spec string, section_number string, title string, level int, target_page int, toc_ord long",
    "chunks": "spec string, id string, section_id string, section_title string, content_type string, chunk_index int, text_raw string, pdf_pages array<int>, figure_number string, has_normative boolean, embedding array<float>",
    "figures": "spec string, figure_number string, caption string, headers array<string>, rows array<array<string>>, raw_text string, pdf_page int, parent_section string",
    "fields": "spec string, field_name string, field_ord int, full_name string, parent_figure string, offset string, offset_type string, description string",
    "enums": "spec string, concept string, value long, value_hex string, name string, figures array<string>, sections array<string>",
    "edges": "spec string, source string, target string, type string, evidence string, strength string, confidence string",
    "answer_log": "id string, created_at timestamp, query string, answer string, config string, spec string, model string",
    "flags": "id string, created_at timestamp, query string, note string",
}


def apply_schema(spark: SparkSession, root: str, dry_run: bool = False) -> list[str]:
    """Create the tables of SCHEMA under root that aren't there and a view of each; the statements that this amounts to. Running it again changes nothing."""
    statements = []
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, columns in SCHEMA.items():
        path = f"{root.rstrip('/')}/{name}"
        statements.append(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{path}'")
        if dry_run:
            continue
        at = fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], columns).write.parquet(path)
        spark.read.schema(columns).parquet(path).createOrReplaceTempView(name)
    return statements


_KEYS = ("agentic", "vector_topk", "bm25_topk", "rrf_output_topk", "final_rerank_topk", "max_subqueries", "auto_gap_check", "agentic_recursive", "agentic_max_iterations", "agentic_max_followups", "agentic_rerank_topk", "figure_reserve_tokens", "agentic_max_context_tokens", "llm_max_output_tokens", "agentic_max_output_tokens", "model_tier", "agentic_tier")
#: Settings by preset; tiers stand for models, which are the caller's.
PRESETS = {
    name: dict(zip(_KEYS, values, strict=True)) | {"rrf_k": 60, "agentic_targeted_fetch": True}
    for name, values in {
        "fast": (False, 6, 6, 12, 5, 1, False, False, 1, 2, 10, 1500, 8000, 1024, 1024, "small", "mid"),
        "balanced": (False, 5, 5, 20, 10, 3, True, True, 4, 3, 14, 3000, 16000, 2048, 3072, "mid", "top"),
        "thorough": (True, 8, 8, 20, 10, 3, True, True, 4, 3, 14, 3000, 16000, 2048, 3072, "mid", "mid"),
    }.items()
}
DEFAULT_PRESET = "balanced"


def resolved_presets(requests: DataFrame) -> DataFrame:
    """requests (id, preset, overrides: map<string, string>) with `settings`, a map: those of the preset, of the default one where it is unknown or null, and the overrides over them.

    An override of a name that no preset has is left out.
    """
    text = lambda v: json.dumps(v) if not isinstance(v, str) else v
    known = F.create_map(*[x for name, p in PRESETS.items() for x in (F.lit(name), F.create_map(*[F.lit(y) for k, v in p.items() for y in (k, text(v))]))])
    base = F.coalesce(F.try_element_at(known, F.col("preset")), F.try_element_at(known, F.lit(DEFAULT_PRESET)))
    names = list(PRESETS[DEFAULT_PRESET])
    own = F.map_filter(F.coalesce("overrides", F.expr("cast(map() as map<string, string>)")), lambda k, v: k.isin(names) & v.isNotNull())
    merged = F.map_from_entries(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.struct(n, F.coalesce(F.try_element_at(own, n), F.try_element_at(base, n)))))
    return requests.withColumn("settings", merged)


def figures_by_number(wanted: DataFrame, figures: DataFrame) -> DataFrame:
    """The first figure, by fig_ord, of each (spec, figure_number) of wanted; numbers are compared without leading zeros."""
    plain = lambda c: F.regexp_replace(F.trim(c.cast("string")), "^0+(?=.)", "")
    first = figures.withColumn("__k", plain(F.col("figure_number"))).groupBy("spec", "__k").agg(F.min_by(F.struct("figure_number", "caption"), "fig_ord").alias("f"))
    asked = wanted.select("spec", F.col("figure_number").alias("asked")).distinct().withColumn("__k", plain(F.col("asked")))
    return asked.join(first, ["spec", "__k"]).select("spec", "asked", "f.figure_number", "f.caption")


def definitions_of(terms: DataFrame, entries: DataFrame, most: int = 4, chars: int = 700) -> DataFrame:
    """(term, place, text): up to `most` definitions, entries (term, entry_ord, text), of each of terms (term), whatever the case, cut at a word."""
    met = terms.select("term").distinct().withColumn("k", F.upper("term")).join(entries.select(F.upper("term").alias("k"), "entry_ord", "text"), "k")
    lists = met.groupBy("term").agg(F.slice(F.array_sort(F.collect_list(F.struct("entry_ord", "text"))), 1, most).alias("all"))
    return lists.select("term", F.posexplode("all").alias("place", "e")).select("term", "place", X.truncated(F.col("e.text"), chars).alias("text"))


def acronyms(entries: DataFrame) -> DataFrame:
    """(term), once each in order: terms of capitals, digits and dots that don't look like a literal, such as 1Fh, 0x1F or 10b."""
    seen = entries.select("term").where(F.col("term").rlike("^[A-Z][A-Z0-9.]{1,15}$")).distinct()
    return seen.where(~F.col("term").rlike("^(0[xX][0-9A-Fa-f]+|[0-9A-Fa-f]+[hH]|[01]+[bB])$")).orderBy("term")


def field_rows(index: DataFrame) -> DataFrame:
    """(spec, field_name, field_ord, …) of a nested index (spec, fields: map<string, array<struct>>): one row a record, in the order of its list."""
    each = index.select("spec", F.explode("fields").alias("field_name", "records"))
    return each.select("spec", "field_name", F.posexplode("records").alias("field_ord", "r")).select("spec", "field_name", "field_ord", "r.*")


def enum_rows(blocks: DataFrame) -> DataFrame:
    """(spec, concept, label, …) of blocks (spec, concept, label, entries: array<struct>): one row an entry; a null label is the concept in capitals."""
    return blocks.select("spec", "concept", F.coalesce("label", F.upper("concept")).alias("label"), F.explode("entries").alias("e")).select("spec", "concept", "label", "e.*")


def figure_rows(tables: DataFrame) -> DataFrame:
    """tables that have a figure number, the first by table_ord of each (spec, figure_number)."""
    named = tables.where(F.coalesce(F.trim(F.col("figure_number").cast("string")), F.lit("")) != "")
    rest = [c for c in tables.columns if c not in ("spec", "figure_number")]
    return named.groupBy("spec", "figure_number").agg(F.min_by(F.struct(*rest), "table_ord").alias("t")).select("spec", "figure_number", "t.*")
