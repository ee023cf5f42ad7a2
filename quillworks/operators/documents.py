"""Weighted documents: title, numbered sections, weights, nesting, checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillworks.functions.textops import one_line_col, round_half_even, strip_col
from quillworks.operators.lines import CHAPTER_LINE, clean_own, join_wrapped, own_documents
from quillworks.operators.sections import detect_sections

CHAPTER_PREFIX = r"(?iU)^Chapter\s+\d+[\s:–\-]+"
TITLE_WINDOW, SHORT_SECTION = 4, 200
KNOWN_FIELDS = ("title", "sections", "chapter", "prefix", "totalSections", "totalWords")


def chapter_number_col(name: Column, override: Column | None = None) -> Column:
    """The override if above 0, else the first digits of the file name without folder and ending, else 0."""
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce(name, F.lit("")), r"[/\\]"), -1), r"\.[^.]*$", "")
    found = F.coalesce(F.expr("try_cast(null as int)"), F.regexp_extract(stem, r"\d+", 0).try_cast("int"), F.lit(0))
    return F.when(override > 0, override).otherwise(found) if override is not None else found


def pick_title(sections: DataFrame) -> DataFrame:
    """Adds doc_title and body_from: the first chapter line among the first four headings, else the first heading."""
    doc = Window.partitionBy("doc_id")
    marked = F.when(F.col("title").rlike(CHAPTER_LINE) & (F.col("seq") < TITLE_WINDOW), F.col("seq"))
    rows = sections.withColumn("marked", marked)
    rows = rows.withColumns({"raw": F.min_by("title", F.coalesce("marked", F.col("seq") + 1_000_000)).over(doc), "marked": F.min("marked").over(doc)})
    bare = one_line_col(F.regexp_replace("raw", CHAPTER_PREFIX, ""))
    title = F.when(F.col("marked").isNull(), one_line_col(F.col("raw"))).when(bare == "", F.col("raw")).otherwise(bare)
    return rows.withColumns({"doc_title": title, "body_from": F.coalesce("marked", F.lit(0)) + 1}).drop("marked", "raw")


def number_and_weigh(sections: DataFrame, kept: Column | None = None) -> DataFrame:
    """sections (doc_id, id_prefix, seq, title, content, word_count): adds id, no (from 1), total_words, section_weight.

    With `kept`, only the sections for which it is true are numbered and count.
    """
    kept = F.lit(True) if kept is None else kept
    order, own = Window.partitionBy("doc_id").orderBy("seq"), Window.partitionBy("doc_id")
    no, total = F.sum(kept.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum(F.when(kept, F.col("word_count"))).over(own)
    rows = sections.withColumns({"no": no, "total_words": total})
    weight = round_half_even(F.col("word_count") / F.greatest(F.col("total_words"), F.lit(1)) * 100)
    return rows.withColumns({"id": F.concat_ws(".", F.col("id_prefix"), F.col("no").cast("string")), "section_weight": weight})


def nest_document(sections: DataFrame, kept: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: chapter, prefix, title, totalSections, totalWords, sections, and the columns `also`.

    With `kept`, only the sections for which it is true count; a document without one has a row of nulls.
    """
    kept = F.lit(True) if kept is None else kept
    entry = F.struct("no", "id", "title", "content", F.col("word_count").alias("wordCount"), F.col("section_weight").alias("sectionWeight"), F.array().cast("array<string>").alias("tags"))
    own = lambda c: F.max(F.when(kept, F.col(c)))
    made = sections.groupBy("doc_id").agg(own("chapter").alias("chapter"), own("id_prefix").alias("prefix"), own("doc_title").alias("title"), F.nullif(F.count(F.when(kept, 1)), F.lit(0)).alias("totalSections"), F.sum(F.when(kept, F.col("word_count"))).alias("totalWords"), F.array_sort(F.collect_list(F.when(kept, entry))).alias("sections"), *[F.any_value(c).alias(c) for c in also])
    return made.withColumn("sections", F.when(F.size("sections") > 0, F.transform("sections", lambda s: s.dropFields("no"))))


def warnings_col() -> Column:
    """Warnings about the nested document's `sections`: none, a single one, or some of under 200 characters.

    Fixed values: the sentences.
    """
    n = F.size("sections")
    short = F.transform(F.filter("sections", lambda s: F.length(s["content"]) < SHORT_SECTION), lambda s: F.format_string("WARNING: Section '%s – %s' is unusually short (%d chars).", s["id"], s["title"], F.length(s["content"])))
    none, one = F.array(F.lit("WARNING: No headings were detected in the document.")), F.array(F.lit("WARNING: Only 1 section detected. Expected at least 2."))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, none).when(n == 1, F.concat(one, short)).otherwise(short)


def validate_documents(docs: DataFrame) -> DataFrame:
    """doc_id, warning."""
    return docs.select("doc_id", F.explode(warnings_col()).alias("warning"))


def shape_problems(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """Adds problem to rows of JSON text: not an object, empty, or none of the known fields; null if fine."""
    keys = F.json_object_keys(F.col(body_col))
    known = F.arrays_overlap(keys, F.array(*map(F.lit, KNOWN_FIELDS)))
    return raw.withColumn("problem", F.when(keys.isNull(), "not an object").when(F.size(keys) == 0, "empty object").when(~known, "no known field"))


def own_sections(docs: DataFrame, fold: Callable[[list[str]], list[str]] = join_wrapped, error_col: str | None = None, tasks: int | None = None) -> DataFrame:
    """Raw texts to the sections of own_documents(), weighed, with kept: false for those that the title takes.

    One exchange deals the documents, another the cleaned texts; what is between and after is local to them. tasks: how
    many to deal to.
    """
    chapter = chapter_number_col(F.col("source_name"), F.col("chapter_override"))
    prefix = F.coalesce(F.nullif(F.trim("prefix"), F.lit("")), chapter.cast("string"))
    no_text = strip_col(F.coalesce("text", F.lit(""))) == ""
    named = docs.select("doc_id", "source_name", "doc_type", chapter.alias("chapter"), prefix.alias("id_prefix"), no_text.alias("no_text"), "text")
    cleaned = clean_own(own_documents(named, tasks), fold=fold, error_col=error_col)
    # what comes out of Python is dealt again: as texts, before they are lines once more
    dealt = cleaned.repartition(tasks, "doc_id") if tasks else cleaned.repartition("doc_id")
    sections = pick_title(detect_sections(dealt))
    return number_and_weigh(sections.withColumn("kept", F.col("seq") >= F.col("body_from")), F.col("kept"))


def process_documents(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Raw texts (doc_id, source_name, doc_type, chapter_override, prefix, text) to sections with ids and weights.

    Null and repeated doc_ids are documents of their own; a document whose only section gives the title has no row.
    """
    rows = own_sections(docs, tasks=tasks).where("kept").drop("kept", "body_from", "source_name", "doc_type", "no_text")
    return rows.withColumn("doc_id", F.col("own_id")).drop("own_id")


def documents_with_status(docs: DataFrame, fold: Callable[[list[str]], list[str]] = join_wrapped, tasks: int | None = None) -> DataFrame:
    """Raw texts to nested documents, each with warnings, a status and a reason.

    One row per input row, found in one job: documents that yield nothing are carried through all windows as a section
    that does not count. Status: done, empty (no text), untitled (no section left), or failed, with the reason, where
    Python's helper raised; a failure stops nothing.
    """
    rows = own_sections(docs, fold, "reason", tasks)
    nested = nest_document(rows, F.col("kept"), also=("own_id", "no_text", "reason"))
    bad = F.col("reason").isNotNull()
    status = F.when(bad, "failed").when(F.col("no_text"), "empty").when(F.col("sections").isNull(), "untitled").otherwise("done")
    told = nested.withColumns({"status": status, "doc_id": F.col("own_id")})
    fine = F.col("status") == "done"
    shown = [F.when(fine, F.col(c)).alias(c) for c in ("chapter", "prefix", "title", "totalSections", "totalWords", "sections")]
    return told.select("doc_id", *shown, F.when(fine, warnings_col()).alias("warnings"), "status", "reason")
