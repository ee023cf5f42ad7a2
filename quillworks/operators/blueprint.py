"""Blueprints: ids, weights and the number of questions for every section.

Sections are rows (doc_id, no, id, title, content, word_count, section_weight), no from 1; the work is windows by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillworks.functions.textops import one_line_col, round_half_up, strip_col

QUESTION_CAP, LEAST_CAP, WORDS_PER_QUESTION, CHARS_PER_QUESTION, API_CHARS = 80, 20, 220, 900, 500
MOST_STEPS = 5_000
ID_PATTERN = r"^([A-Za-z][A-Za-z0-9]*\.)?\d+\.\d+$"
# The strings that a blueprint must have; the sentences of validate_blueprint and validate_headers.
REQUIRED_STRINGS = ("chapterId", "bookId", "chapterTitle", "sourceRelativePath", "generatedAt", "modelUsed", "modelVersion")


def own_doc() -> Window:
    return Window.partitionBy("doc_id")


def infer_book_id(title: Column) -> Column:
    """The titles that name a book."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.when(t.contains("airplane flying handbook") | t.contains("faa-h-8083-3"), "AFH").when(t.contains("pilot's handbook") | t.contains("phak"), "PHAK").otherwise("DOC")


def id_context(docs: DataFrame, prefix_col: str = "prefix", title_col: str = "title", chapter_col: str = "chapter") -> DataFrame:
    """Adds book_id, chapter_number, chapter_id: from the prefix's letters and digits, else from title and chapter."""
    raw = F.trim(F.coalesce(F.col(prefix_col), F.lit("")))
    book = F.upper(F.coalesce(F.nullif(F.regexp_extract(raw, "[A-Za-z]{2,}", 0), F.lit("")), infer_book_id(F.col(title_col))))
    own = F.greatest(F.lit(0), F.coalesce(F.col(chapter_col).cast("int"), F.lit(0)))
    number = F.coalesce(F.regexp_extract(raw, r"(\d{1,3})", 1).try_cast("int"), own)
    out = docs.withColumns({"book_id": book, "chapter_number": number})
    return out.withColumn("chapter_id", F.concat_ws("_", F.lower("book_id"), F.col("chapter_number").cast("string")))


def section_id_col(book: Column, chapter: Column, no: Column) -> Column:
    return F.concat_ws("_", F.lower(book), chapter.cast("string"), no.cast("string"))


def question_id_col(book: Column, chapter: Column, section: Column, question: Column) -> Column:
    """BOOK.chapter.section.question; chapter 0 at least, the others 1."""
    at_least = lambda c, n: F.greatest(F.lit(n), F.coalesce(c.cast("int"), F.lit(n))).cast("string")
    return F.concat_ws(".", F.coalesce(F.nullif(F.upper(F.trim(book)), F.lit("")), F.lit("DOC")), at_least(chapter, 0), at_least(section, 1), at_least(question, 1))


def section_ordinal_col(section_id: Column, fallback: Column | None = None) -> Column:
    own = F.trim(F.coalesce(section_id, F.lit("")))
    ends = lambda mark: F.regexp_extract(own, rf"{mark}(\d+)$", 1).try_cast("int")
    return F.coalesce(ends("_"), ends(r"\."), fallback if fallback is not None else F.lit(0))


def normalize_weights(rows: DataFrame, weight_col: str = "weight") -> DataFrame:
    """weight in percent with two places; the last section takes what is missing from 100. No positive weight: equal."""
    doc, last = own_doc(), F.row_number().over(own_doc().orderBy(F.desc("no"))) == 1
    w = F.coalesce(F.col(weight_col), F.lit(0.0))
    total = F.sum(w).over(doc)
    n = F.count(F.lit(1)).over(doc)
    rows = rows.withColumns({"w_sum": total, "w_n": n, "w_last": last})
    rounded = F.when(F.col("w_sum") <= 0, round_half_up(F.lit(100.0) / F.col("w_n"))).otherwise(round_half_up(w / F.col("w_sum") * 100))
    rows = rows.withColumn("w_round", rounded)
    rows = rows.withColumn("w_rest", round_half_up(F.lit(100.0) - round_half_up(F.sum("w_round").over(doc))))
    out = F.when(F.col("w_last") & (F.col("w_sum") > 0), round_half_up(F.col("w_round") + F.col("w_rest"))).otherwise(F.col("w_round"))
    return rows.withColumn(weight_col, out).drop("w_sum", "w_n", "w_last", "w_round", "w_rest")


def allocate_questions(rows: DataFrame, target_col: str = "target", mode: str = "reference") -> DataFrame:
    """Adds questions. rows: doc_id, no, weight, given (wished number or null), target (per document).

    Every section has its wish, 1 at least. mode `reference`: what is left goes to the first section of highest weight
    (5,000 steps at most); what is too many comes off the lightest first, down to 1. mode `proportional`: each gets its
    rounded share of the target, 1 at least, and the same correction follows.
    """
    doc = own_doc()
    safe = F.greatest(F.count(F.lit(1)).over(doc), F.coalesce(F.col(target_col), F.lit(0)).cast("long"))
    wish = F.floor(F.coalesce(F.col("weight"), F.lit(0.0)) / 100 * safe + 0.5) if mode == "proportional" else F.coalesce(F.col("given"), F.lit(0)).cast("long")
    rows = rows.withColumn("q_safe", safe).withColumn("q_base", F.greatest(F.lit(1).cast("long"), wish))
    rows = rows.withColumn("q_gap", F.col("q_safe") - F.sum("q_base").over(doc))
    heaviest = F.row_number().over(doc.orderBy(F.desc("weight"), "no")) == 1
    before = F.coalesce(F.sum(F.col("q_base") - 1).over(doc.orderBy("weight", "no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"q_top": heaviest, "q_before": before})
    need = F.least(-F.col("q_gap"), F.lit(MOST_STEPS).cast("long"))
    taken = F.least(F.greatest(need - F.col("q_before"), F.lit(0).cast("long")), F.col("q_base") - 1)
    more = F.when(F.col("q_top"), F.least(F.col("q_gap"), F.lit(MOST_STEPS).cast("long"))).otherwise(0)
    return rows.withColumn("questions", F.when(F.col("q_gap") >= 0, F.col("q_base") + more).otherwise(F.col("q_base") - taken)).drop("q_safe", "q_base", "q_gap", "q_top", "q_before")


def char_blueprint(sections: DataFrame) -> DataFrame:
    """doc_id, no, weight, questions: by characters, one question for every 900."""
    chars = F.coalesce(F.length("content"), F.lit(0))
    heavy = F.greatest(F.lit(1), chars)
    rows = sections.select("doc_id", "no", round_half_up(heavy / F.sum(heavy).over(own_doc()) * 100).alias("weight"), F.greatest(F.lit(1), F.ceil(chars / CHARS_PER_QUESTION)).cast("long").alias("questions"))
    return normalize_weights(rows)


def word_blueprint(sections: DataFrame, cap: int = QUESTION_CAP, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, no, id, weight, questions: by given weights or words, one question for every 220 words, at most `cap`; and
    the columns `also` of the sections."""
    doc = own_doc()
    total = F.sum("word_count").over(doc)
    safe = F.when(total > 0, total).otherwise(1)
    weight = F.when(F.col("section_weight") > 0, F.col("section_weight")).otherwise(F.col("word_count") / safe * 100)
    target = F.least(F.lit(max(LEAST_CAP, cap)).cast("long"), F.greatest(F.count(F.lit(1)).over(doc), F.ceil(safe / WORDS_PER_QUESTION)))
    rows = sections.select("doc_id", "no", "id", round_half_up(weight).alias("weight"), F.lit(None).cast("long").alias("given"), target.alias("target"), *also)
    return allocate_questions(normalize_weights(rows)).select("doc_id", "no", "id", "weight", "questions", *also)


def merge_analysis(sections: DataFrame, analysis: DataFrame) -> DataFrame:
    """doc_id, no, id, weight, questions: outside analysis rows merged in.

    analysis: doc_id, pos (order of arrival), section_id, section_index, weight, required, target. A section takes the
    last row with its id, else the last with its index. A missing weight counts the section's characters.
    """
    last = lambda keys, name: analysis.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct("weight", "required"), "pos").alias(name))
    by_id = last(["doc_id", "section_id"], "by_id").withColumnsRenamed({"doc_id": "i_doc"})
    by_no = last(["doc_id", "section_index"], "by_no").withColumnsRenamed({"doc_id": "n_doc"})
    goal = analysis.groupBy(F.col("doc_id").alias("g_doc")).agg(F.max("target").alias("asked"))
    chars = F.greatest(F.lit(1), F.coalesce(F.length("content"), F.lit(0)))
    rows = sections.select("doc_id", "no", "id", chars.alias("chars"))
    rows = rows.join(by_id, (F.col("doc_id") == F.col("i_doc")) & (F.col("id") == F.col("section_id")), "left").join(by_no, (F.col("doc_id") == F.col("n_doc")) & (F.col("no") == F.col("section_index")), "left").join(goal, F.col("doc_id") == F.col("g_doc"), "left")
    found = F.coalesce("by_id", "by_no")
    least = F.greatest(F.count(F.lit(1)).over(own_doc()), F.ceil(F.sum("chars").over(own_doc()) / API_CHARS))
    weight = F.when(found["weight"] > 0, round_half_up(found["weight"])).otherwise(F.col("chars").cast("double"))
    rows = rows.select("doc_id", "no", "id", weight.alias("weight"), F.coalesce(found["required"], F.lit(0)).cast("long").alias("given"), F.greatest(least, F.coalesce("asked", F.lit(0))).alias("target"))
    return allocate_questions(normalize_weights(rows)).select("doc_id", "no", "id", "weight", "questions")


def blueprint_totals(rows: DataFrame, floor: bool = True) -> DataFrame:
    """doc_id, total_questions: the sum of the required numbers, 1 at least each unless floor is off."""
    n = F.greatest(F.lit(1), F.coalesce("questions", F.lit(1))) if floor else F.coalesce("questions", F.lit(0))
    return rows.groupBy("doc_id").agg(F.sum(n).cast("long").alias("total_questions"))


def request_payload(sections: DataFrame, excerpt: int = 900) -> DataFrame:
    """doc_id, payload: JSON of the sections' ids, titles, lengths and one-line excerpts."""
    part = F.struct("no", "id", "title", F.coalesce(F.length("content"), F.lit(0)).alias("chars"), F.substring(one_line_col(F.col("content")), 1, excerpt).alias("excerpt"))
    return sections.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(part)).alias("sections"))).alias("payload"))


def validate_blueprint(sections: DataFrame) -> DataFrame:
    """One row per fault: doc_id, place (from 0), error. sections: doc_id, place, section_id, section_title,
    weight, required, rationale."""
    own = F.trim(F.coalesce("section_id", F.lit("")))
    ok = own.rlike(ID_PATTERN)
    seen = F.row_number().over(Window.partitionBy("doc_id", F.when(ok, own)).orderBy("place"))
    rows = sections.withColumns({"own": own, "ok": ok, "seen": seen})
    at = lambda text: F.concat(F.lit("sectionBlueprints["), F.col("place").cast("string"), F.lit("]"), text)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    quoted = F.concat(F.lit('"'), F.col("section_id"), F.lit('"'))
    about_id = (
        F.when(F.col("own") == "", at(F.lit(" must include sectionId or id as a non-empty string.")))
        .when(~F.col("ok"), at(F.concat(F.lit(" id "), quoted, F.lit(" must follow format BookId.Chapter.Section (e.g. AFH.1.1)."))))
        .when(F.col("seen") > 1, at(F.concat(F.lit(" duplicate section ID "), quoted, F.lit("."))))
    )
    faults = [
        about_id,
        F.when(blank(F.col("section_title")), at(F.lit(".sectionTitle must be a non-empty string."))),
        F.when(F.col("weight").isNull() | F.isnan("weight"), at(F.lit(".weightPercentage must be a number."))),
        F.when(F.coalesce(F.col("required") <= 0, F.lit(True)), at(F.lit(".requiredQuestions must be a positive number."))),
        F.when(blank(F.col("rationale")), at(F.lit(".rationale must be a non-empty string."))),
    ]
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), F.explode(F.array_compact(F.array(*faults))).alias("error"))


def validate_headers(banks: DataFrame) -> DataFrame:
    """doc_id, error: the required strings that are missing, and blueprints without sections."""
    faults = [F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", F.lit(f"questionBank.{f} must be a non-empty string.")) for f in REQUIRED_STRINGS]
    faults.append(F.when(F.coalesce(F.col("n_sections"), F.lit(0)) <= 0, F.lit("questionBank.sectionBlueprints must be a non-empty array.")))
    return banks.select("doc_id", F.explode(F.array_compact(F.array(*faults))).alias("error"))


def repair_blueprint(sections: DataFrame) -> DataFrame:
    """Adds fixed_id (the book id before an id that starts with a digit) and target (the sum of what is required)."""
    bare = F.trim("section_id").rlike(r"^\d")
    fixed = F.when(bare, F.concat_ws(".", F.col("book_id"), F.trim("section_id"))).otherwise(F.col("section_id"))
    return sections.withColumns({"fixed_id": fixed, "target": F.sum(F.coalesce("required", F.lit(0))).over(own_doc())})


def repair_suggestions(sections: DataFrame) -> DataFrame:
    """doc_id, bare_ids, previous, target, mismatch: what repair_blueprint would change. sections has stated (total)."""
    out = sections.groupBy("doc_id").agg(F.count(F.when(F.trim("section_id").rlike(r"^\d"), 1)).alias("bare_ids"), F.max("stated").alias("previous"), F.sum(F.coalesce("required", F.lit(0))).alias("target"))
    return out.withColumn("mismatch", ~F.col("previous").eqNullSafe(F.col("target")))
