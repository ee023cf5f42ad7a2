"""Measures of sections and documents: totals, budgets, token and cost estimates, overlap, summaries.

Sections are rows (doc_id, no, id, title, content, word_count), no from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillworks.functions.textops import jaccard_col, nearest_whole, one_line_col, round_half_up, strip_col, token_set_col, words_col

CHARS_PER_QUESTION, TOKEN_CHARS, TOP_SECTIONS = 900, 4, 8
SUMMARY_LEAST, SUMMARY_MOST, SECTION_LEAST = 500, 750, 30
OVERLAP, LEAD_WORDS, KEY_POINTS = 0.72, 220, 24
# Price lists, name and price of 1,000 tokens in and out.
PRICES = [("list 1", 0.01, 0.03), ("list 2", 0.003, 0.015)]


def chars_col() -> Column:
    return F.coalesce(F.length("content"), F.lit(0)).cast("long")


def of_document(sections: DataFrame, name: str, kind: str = "string") -> Column:
    """A column that says the same in all sections of a document (null if there is no such column)."""
    return F.max(name) if name in sections.columns else F.lit(None).cast(kind)


def document_summary(sections: DataFrame) -> DataFrame:
    """doc_id, chapter, doc_title, section_count, total_chars, synopsis. A document whose row has no `no` has no section."""
    has = F.col("no").isNotNull()
    totals = sections.groupBy("doc_id").agg(
        of_document(sections, "chapter").cast("string").alias("chapter"),
        of_document(sections, "doc_title").alias("doc_title"),
        F.count(F.when(has, 1)).alias("section_count"),
        F.coalesce(F.sum(F.when(has, chars_col())), F.lit(0)).alias("total_chars"),
    )
    # The sentence.
    chapter = F.coalesce("chapter", F.lit("?"))
    return totals.withColumn("synopsis", F.format_string("Chapter %s contains %d sections with %d characters of extracted content.", chapter, "section_count", "total_chars"))


def top_sections(sections: DataFrame, k: int = TOP_SECTIONS) -> DataFrame:
    """The k longest sections of each document, ties in order: doc_id, rank, id (null if empty), title (`Untitled` if
    empty), chars."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("chars"), "no"))
    return sections.withColumn("chars", chars_col()).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("doc_id", "rank", F.nullif("id", F.lit("")).alias("id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), "chars")


def document_metrics(sections: DataFrame) -> DataFrame:
    """doc_id, n_sections, total_chars, mean_chars (nearest whole number), questions (one for every 900 characters of a section)."""
    asked = F.ceil(chars_col() / CHARS_PER_QUESTION)
    return sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(chars_col()).alias("total_chars"), F.sum(asked).alias("questions")).withColumn("mean_chars", nearest_whole(F.col("total_chars") / F.col("n_sections")))


def token_estimate(metrics: DataFrame) -> DataFrame:
    """One row per document and output: chars_in, chars_out, tokens_in, tokens_out, mandatory."""
    chars, n = F.col("total_chars"), F.col("questions")
    records = F.floor(n * 11 * F.lit(0.3))
    rows = [("blueprint", chars * 0.15 + 500, chars * 0.5, True), ("questions", chars * 0.08 + 400, n * 200.0, True), ("summary", chars * 0.25 + 400, F.lit(1500.0), False), ("records", chars * 0.12 + 400, records * 150.0, False)]
    made = F.explode(F.array(*[F.struct(F.lit(o).alias("output"), i.cast("double").alias("chars_in"), u.cast("double").alias("chars_out"), F.lit(m).alias("mandatory")) for o, i, u, m in rows]))
    out = metrics.select("doc_id", made.alias("e")).select("doc_id", "e.*")
    return out.withColumns({"tokens_in": nearest_whole(F.col("chars_in") / TOKEN_CHARS), "tokens_out": nearest_whole(F.col("chars_out") / TOKEN_CHARS)})


def token_totals(estimates: DataFrame) -> DataFrame:
    """doc_id, scope (all, mandatory), tokens_in, tokens_out, tokens_total: of the outputs' characters together."""
    scopes = F.when(F.col("mandatory"), F.array(F.lit("all"), F.lit("mandatory"))).otherwise(F.array(F.lit("all")))
    sums = estimates.withColumn("scope", F.explode(scopes)).groupBy("doc_id", "scope").agg(F.sum("chars_in").alias("i"), F.sum("chars_out").alias("o"))
    tokens = lambda c: nearest_whole(c / TOKEN_CHARS)
    return sums.select("doc_id", "scope", tokens(F.col("i")).alias("tokens_in"), tokens(F.col("o")).alias("tokens_out"), tokens(F.col("i") + F.col("o")).alias("tokens_total"))


def cost_estimate(estimates: DataFrame, prices: list[tuple[str, float, float]] = PRICES) -> DataFrame:
    """doc_id, price_list, cost_all, cost_mandatory (three places). prices: name and price of 1,000 tokens in and out."""
    part = lambda c, mandatory: F.sum(F.when(F.col("mandatory"), F.col(c)).otherwise(F.lit(0.0)) if mandatory else F.col(c))
    sums = estimates.groupBy("doc_id").agg(part("chars_in", False).alias("i"), part("chars_out", False).alias("o"), part("chars_in", True).alias("mi"), part("chars_out", True).alias("mo"))
    cost = lambda i, o: round_half_up(F.col(i) / TOKEN_CHARS / 1000 * F.col("p.input_per_1k") + F.col(o) / TOKEN_CHARS / 1000 * F.col("p.output_per_1k"), 3)
    lists = [F.struct(F.lit(name).alias("name"), F.lit(float(i)).alias("input_per_1k"), F.lit(float(o)).alias("output_per_1k")) for name, i, o in prices]
    return sums.withColumn("p", F.explode(F.array(*lists))).select("doc_id", F.col("p.name").alias("price_list"), cost("i", "o").alias("cost_all"), cost("mi", "mo").alias("cost_mandatory"))


def summary_budget(sections: DataFrame) -> DataFrame:
    """doc_id, no, budget: each section's share of 500 to 750 words, 30 at least."""
    total = F.sum("word_count").over(Window.partitionBy("doc_id"))
    safe = F.when(total == 0, 1).otherwise(total)
    whole = F.greatest(F.lit(SUMMARY_LEAST), F.least(F.lit(SUMMARY_MOST), safe))
    return sections.select("doc_id", "no", F.greatest(F.lit(SECTION_LEAST), nearest_whole(F.col("word_count") / safe * whole)).cast("long").alias("budget"))


def trim_to_words(texts: DataFrame, max_words: int, text_col: str = "text") -> DataFrame:
    """doc_id, text: whole lines while they fit, then what fits of one line, closed by a line feed; blank lines are free."""
    rows = texts.select("doc_id", F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("words", words_col(F.col("line"))).withColumn("n", F.size("words"))
    rows = rows.withColumn("upto", F.sum("n").over(order)).withColumn("over", (F.col("n") > 0) & (F.col("upto") > max_words))
    rows = rows.withColumn("overs", F.sum(F.col("over").cast("int")).over(order))
    left = max_words - (F.col("upto") - F.col("n"))
    cut = F.array_join(F.slice("words", 1, F.greatest(left, F.lit(0)).cast("int")), " ")
    kept = F.when(F.col("overs") == 0, F.struct("line_no", "line")).when(F.col("over") & (F.col("overs") == 1) & (left > 0), F.struct("line_no", cut.alias("line")))
    out = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(kept)).alias("lines"))
    return out.select("doc_id", F.concat(strip_col(F.array_join(F.col("lines.line"), "\n")), F.lit("\n")).alias(text_col))


def overlap_flags(pairs: DataFrame, text_col: str = "text", other_col: str = "other", threshold: float = OVERLAP) -> DataFrame:
    """doc_id, overlap (highest similarity of the text's first 220 words with any of its other texts), excessive."""
    lead = F.array_join(F.slice(words_col(F.col(text_col)), 1, LEAD_WORDS), " ")
    score = jaccard_col(token_set_col(lead), token_set_col(F.col(other_col)))
    return pairs.groupBy("doc_id").agg(F.max(score).alias("overlap")).withColumn("excessive", F.col("overlap") >= threshold)


def summary_gate(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds words and action: rewrite (under 500), trim (over 750) or keep."""
    n = F.size(words_col(F.col(text_col))).cast("long")
    return texts.withColumns({"words": n, "action": F.when(n < SUMMARY_LEAST, "rewrite").when(n > SUMMARY_MOST, "trim").otherwise("keep")})


def detailed_summary(sections: DataFrame) -> DataFrame:
    """doc_id, markdown: an extractive summary of each document (chapter, doc_title, no, title, content).

    A document without sections is a row without no, title and content.
    """
    entry = F.when(F.col("no").isNotNull(), F.struct("no", "title", "content"))
    made = (of_document(sections, "doc_title").alias("doc_title"), of_document(sections, "chapter").cast("string").alias("chapter"), F.array_sort(F.collect_list(entry)).alias("s"))
    docs = sections.groupBy("doc_id").agg(*made)
    named = lambda s: F.coalesce(F.nullif(s["title"], F.lit("")), F.concat(F.lit("Section "), s["no"].cast("string")))
    titles = F.transform(F.slice("s", 1, 6), named)

    def excerpt(s: Column) -> Column:
        words = words_col(s["content"])
        text = F.concat(F.array_join(F.slice(words, 1, 45), " "), F.when(F.size(words) > 45, "...").otherwise(""))
        return F.concat(F.lit("- "), named(s), F.lit(": "), F.when(F.size(words) == 0, "No extractable content was available.").otherwise(text))

    # The sentences of the summary.
    parts = F.concat(
        F.array(F.concat(F.lit("# Chapter Summary: "), F.coalesce("doc_title", F.lit("Unknown"))), F.lit(""), F.lit("## Overview")),
        F.array(F.format_string("Chapter %s covers %d sections and focuses on pilot technique, control accuracy, risk awareness, and standards-based decision making.", F.coalesce("chapter", F.lit("?")), F.size("s"))),
        F.array(F.lit(""), F.lit("## Key Learning Objectives")),
        F.when(F.size("s") == 0, F.array(F.lit(NO_OBJECTIVE))).otherwise(F.array().cast("array<string>")),
        F.transform(titles, lambda t: F.concat(F.lit("- Understand and apply "), F.lower(t), F.lit(" in practical training scenarios."))),
        F.array(F.lit(""), F.lit("## Main Concepts")),
        F.transform(F.slice("s", 1, 10), excerpt),
        F.array(F.lit(""), F.lit("## Key Terms and Definitions")),
        F.when(F.size("s") == 0, F.array(F.lit(NO_TERM))).otherwise(F.array().cast("array<string>")),
        F.transform(titles, lambda t: F.concat(F.lit("- **"), t, F.lit("**: A primary chapter concept that supports safe execution and consistent pilot performance."))),
        F.array(F.lit(""), F.lit("## Summary of Important Facts")),
        F.array(*map(F.lit, FACTS)),
    )
    return docs.select("doc_id", F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("markdown"))


# What stands for the objectives and the terms of a document without sections.
NO_OBJECTIVE = "- Identify and apply the chapter's core procedures and safety priorities."
NO_TERM = "- **Operational Control**: The coordinated use of attitude, power, and trim to maintain desired aircraft performance."
# The closing sentences of the extractive summary.
FACTS = (
    "- Emphasis is placed on safe, standards-driven operation and consistent pilot judgment.",
    "- Regulatory, procedural, and risk-management concepts are integrated across sections.",
    "- Mastery of fundamentals in this chapter supports successful progression to advanced maneuvers and evaluations.",
    "- Practical operation details should still be validated against the source chapter text during study.",
)


def fallback_summary(summaries: DataFrame, tops: DataFrame, model: str = "deterministic", generated_at: str | None = None) -> DataFrame:
    """doc_id, markdown: overview, key sections and totals, from document_summary and top_sections. Its words."""
    keys = tops.groupBy(F.col("doc_id").alias("k_doc")).agg(F.array_sort(F.collect_list(F.struct("rank", "title", "id"))).alias("keys"))
    some = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    line = lambda k: F.concat(F.lit("- "), some(k["title"], "Untitled"), F.lit(" ("), some(k["id"], "n/a"), F.lit(")"))
    rows = summaries.join(keys, F.col("doc_id").eqNullSafe(F.col("k_doc")), "left")
    listed = F.when(F.size("keys") > 0, F.transform("keys", line)).otherwise(F.array(F.lit("- No section highlights were available.")))
    head = F.array(F.concat(F.lit("# Chapter Summary: "), some(F.col("doc_title"), "Unknown")), F.lit(""), F.lit("## Overview"), some(F.col("synopsis"), "Summary unavailable."), F.lit(""), F.lit("## Key Sections"))
    facts = [
        F.concat(F.lit("- Chapter: "), F.coalesce("chapter", F.lit("n/a"))),
        F.concat(F.lit("- Sections: "), F.coalesce("section_count", F.lit(0)).cast("string")),
        F.concat(F.lit("- Characters: "), F.coalesce("total_chars", F.lit(0)).cast("string")),
        F.lit(f"- Model Used: {model}"),
        *([F.lit(f"- Generated At: {generated_at}")] if generated_at else []),
    ]
    parts = F.concat(head, listed, F.array(F.lit(""), F.lit("## Metadata"), *facts))
    return rows.select("doc_id", F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("markdown"))


def read_time_col(given: Column, chars: Column) -> Column:
    """Minutes: as given, else a minute for every 1,200 characters; 1 at least."""
    return F.greatest(F.lit(1), F.coalesce(given, nearest_whole(chars / 1200)).cast("long"))


def usage_rollup(steps: DataFrame) -> DataFrame:
    """steps (doc_id, step, model, prompt_tokens, completion_tokens): sums, and the last model that was named."""
    return steps.groupBy("doc_id").agg(F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("step"))).alias("model"))


def key_points_col(points: Column, titles: Column, most: int = KEY_POINTS) -> Column:
    """Trimmed, empties dropped, `most` at most; the titles if none are left."""
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), strip_col), lambda x: x != "")
    return F.slice(F.when(F.size(clean(points)) > 0, clean(points)).otherwise(clean(titles)), 1, most)


def excerpt_col(content: Column, chars: int = 900) -> Column:
    return F.substring(one_line_col(content), 1, chars)
