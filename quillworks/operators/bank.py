"""Question banks: replies parsed, gated, deduplicated, accepted by section and nested.

Defined results: replies, candidates and requirements with a null doc_id or section_id meet nothing and give no row; a
null body, list of answers or subject is empty; equal candidates of one place (slot, attempt, pos) count once; an empty
table gives an empty result; extra columns of candidates go along.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillworks.functions.textops import has_words_col, strip_col
from quillworks.operators.blueprint import question_id_col

#: Executors need no copy of this module: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CORRECT, WRONG, STEM_WORDS, ANSWER_WORDS = 3, 8, 8, 5
SLOT_TRIES = 6
#: The best candidates of a section are found among this many parts of it first.
RANK_PARTS = 16


def json_part(text: Column) -> Column:
    """A reply from its first { to its last }; null if there are none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def extract_json(text: Column) -> Column:
    """The JSON object in a reply, which may stand in chatter; null if that part is no JSON."""
    part = json_part(text)
    return F.when(F.try_parse_json(part).isNotNull(), part)


def pick_reply(replies: DataFrame, priority: DataFrame, key: str = "request_id", order_col: str = "given") -> DataFrame:
    """The good reply of the best provider for each request; unlisted providers come last, in the order they were given.

    priority: provider, rank. order_col: the column with the place of a reply's provider as given. Ties go by name.
    """
    ranks = priority.select(F.lower(F.trim("provider")).alias("p_name"), F.col("rank").alias("p_rank"))
    ranks = ranks.groupBy("p_name").agg(F.min("p_rank").alias("p_rank"))
    rows = replies.where("ok").join(ranks, F.col("provider") == F.col("p_name"), "left")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("p_rank").asc_nulls_last(), F.col(order_col).asc_nulls_last(), "provider"))
    return rows.withColumn("p_place", place).where("p_place = 1").drop("p_name", "p_rank", "p_place")


def text_of(value: Column) -> Column:
    """A JSON string's text, trimmed; null for any other JSON value."""
    return F.when(F.schema_of_variant(value) == "STRING", strip_col(F.try_variant_get(value, "$", "string")))


def texts_col(answers: Column, most: int) -> Column:
    """Answers as JSON values, strings or objects with a text: trimmed, empties dropped, the first `most`."""
    none = F.array().cast("array<variant>")
    own = F.transform(F.coalesce(answers, none), lambda a: F.coalesce(text_of(a), text_of(F.try_variant_get(a, "$.text", "variant"))))
    return F.slice(F.filter(own, lambda a: a != ""), 1, most)


def parse_candidates(replies: DataFrame) -> DataFrame:
    """Candidates of replies (doc_id, section_id, slot, attempt, body): pos, question, correct, wrong, subjects.

    Candidates that name another section, or none, are dropped. Replies without JSON give no row. A reply is parsed once.
    """
    asked = F.try_variant_get(F.try_parse_json(json_part(F.col("body"))), "$.questions", "array<variant>")
    rows = replies.select("doc_id", "section_id", "slot", "attempt", F.posexplode(asked).alias("pos", "q"))
    part = lambda path, kind: F.try_variant_get("q", path, kind)
    rows = rows.where(strip_col(part("$.sectionId", "string")) == F.col("section_id"))
    question = F.coalesce(text_of(part("$.question", "variant")), F.lit(""))
    subjects = F.filter(F.transform(part("$.subjects", "array<string>"), strip_col), lambda x: x != "")
    return rows.select(
        "doc_id", "section_id", "slot", "attempt", "pos", question.alias("question"),
        texts_col(part("$.correct_answers", "array<variant>"), CORRECT).alias("correct"),
        texts_col(part("$.wrong_answers", "array<variant>"), WRONG).alias("wrong"),
        subjects.alias("subjects"),
    )


def stem_fault_col(question: Column) -> Column:
    """Null for a good stem: eight words or more, closed by a question mark."""
    return F.when(~has_words_col(question, STEM_WORDS), "short stem").when(~question.endswith("?"), "no question mark")


def rich_answer_col(answer: Column) -> Column:
    """Five words or more. The answers that say nothing ("option 3", "wrong option 3") have three at most."""
    return has_words_col(answer, ANSWER_WORDS)


def quality_gate(candidates: DataFrame) -> DataFrame:
    """Adds fault: the first gate that a candidate fails, null if it passes all."""
    both = F.concat("correct", "wrong")
    count = (F.size("correct") != CORRECT) | (F.size("wrong") != WRONG)
    alike = F.size(F.array_distinct(F.transform(both, F.lower))) != CORRECT + WRONG
    fault = F.coalesce(stem_fault_col(F.col("question")), F.when(count, "answer count").when(~F.forall(both, rich_answer_col), "poor answer").when(alike, "equal answers"))
    return candidates.withColumn("fault", fault)


def accept_questions(candidates: DataFrame, required: DataFrame, mode: str = "batch", tasks: int | None = None) -> DataFrame:
    """Accepted questions with their number in the section. candidates: passed the gate; required: doc_id, section_id,
    section_title, questions, one row for each section.

    Of equal stems in a section the earliest (slot, attempt, pos) counts. mode `batch`: the first `questions` of what is
    left. mode `slots`: slots 1 to `questions` are filled in turn, each by the first candidate of its first six attempts
    whose stem no earlier slot has taken; a slot may stay empty. tasks: how many the sections are dealt to, to be raised
    with the size.
    """
    order = ["slot", "attempt", "pos"]
    need = required.select(F.col("doc_id").alias("r_doc"), F.col("section_id").alias("r_section"), "section_title", F.greatest("questions", F.lit(1)).alias("needed"))
    if tasks:
        candidates, need = candidates.repartition(tasks, "doc_id", "section_id"), need.repartition(tasks, "r_doc", "r_section")
    joined = candidates.join(need, (F.col("doc_id") == F.col("r_doc")) & (F.col("section_id") == F.col("r_section"))).drop("r_doc", "r_section")
    rows = _by_slots(joined, bool(tasks)) if mode == "slots" else _first_ones(joined, order)
    subjects = F.when(F.size(F.coalesce("subjects", F.array().cast("array<string>"))) > 0, F.col("subjects")).otherwise(F.array("section_title"))
    return rows.withColumn("subjects", subjects).drop("needed")


def _first_ones(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first `needed` distinct stems of each section, numbered.

    No window holds all candidates of a section: repeats of a stem go before and after the exchange by stem, then each of
    a section's parts keeps its first ones, and the last window sees RANK_PARTS * needed rows at most.
    """
    stem = F.sha2(F.lower("question"), 256)
    turn = F.row_number().over(Window.partitionBy("doc_id", "section_id", stem).orderBy(*order))
    first = rows.withColumn("turn", turn).where("turn = 1").withColumn("part", F.pmod(F.xxhash64(F.lower("question")), F.lit(RANK_PARTS)))
    in_part = F.row_number().over(Window.partitionBy("doc_id", "section_id", "part").orderBy(*order))
    kept = first.withColumn("turn", in_part).where("turn <= needed").drop("turn", "part")
    number = F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy(*order))
    return kept.withColumn("number", number.cast("long")).where("number <= needed")


def _by_slots(rows: DataFrame, dealt_before: bool = False) -> DataFrame:
    """The exact slot rule as a fold over sorted partitions: sections are dealt whole and read in order of slot, attempt
    and pos, and the state of the open section is carried over the ends of Arrow batches.

    A section's slots and attempts are bounded by its required number, so no task holds more than it has to. dealt_before:
    both sides of the join were dealt by section to a stated number of tasks, which adaptive execution leaves alone.
    """
    keys = ["doc_id", "section_id"]
    asked = rows.where((F.col("slot") >= 1) & (F.col("slot") <= F.col("needed")) & (F.col("attempt") <= SLOT_TRIES)).withColumn("stem", F.lower("question"))
    dealt = (asked if dealt_before else asked.repartition(*keys)).sortWithinPartitions(*keys, "slot", "attempt", "pos")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema), "number long"])
    return dealt.mapInArrow(_fold_slots, schema).drop("stem")


def _fold_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    section, filled, taken = None, None, set()
    for batch in batches:
        fits, numbers = [], []
        for doc, name, slot, stem in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "section_id", "slot", "stem")), strict=True):
            if (doc, name) != section:
                section, filled, taken = (doc, name), None, set()
            fits.append(slot != filled and stem not in taken)
            if fits[-1]:
                filled = slot
                taken.add(stem)
                numbers.append(len(taken))
        kept = batch.filter(pa.array(fits, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(numbers, pa.int64())], [*kept.schema.names, "number"])


def shortfall(accepted: DataFrame, required: DataFrame) -> DataFrame:
    """doc_id, section_id, needed, accepted of the sections that have too few."""
    n = accepted.groupBy(F.col("doc_id").alias("a_doc"), F.col("section_id").alias("a_section")).agg(F.count(F.lit(1)).alias("n"))
    rows = required.join(n, (F.col("doc_id") == F.col("a_doc")) & (F.col("section_id") == F.col("a_section")), "left")
    rows = rows.select("doc_id", "section_id", F.col("questions").alias("needed"), F.coalesce("n", F.lit(0)).cast("long").alias("accepted"))
    return rows.where("accepted < needed")


def with_ids(accepted: DataFrame) -> DataFrame:
    """Adds question_id and nested answers with ids. accepted has book_id, chapter, section_no, number."""
    qid = question_id_col(F.col("book_id"), F.col("chapter"), F.col("section_no"), F.col("number"))
    rows = accepted.withColumn("question_id", qid)
    nested = lambda c, mark: F.transform(F.col(c), lambda a, k: F.struct(F.concat_ws(".", F.col("question_id"), F.lit(mark), (k + 1).cast("string")).alias("id"), a.alias("text")))
    return rows.withColumns({"correct_answers": nested("correct", "c"), "wrong_answers": nested("wrong", "w")})


def model_label(steps: DataFrame) -> DataFrame:
    """doc_id, model: the models' names, first seen first, joined by +; unknown if there is none."""
    first = steps.where("model is not null and model <> ''").groupBy("doc_id", "model").agg(F.min("step").alias("at"))
    named = first.groupBy(F.col("doc_id").alias("m_doc")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "model")))["model"], "+").alias("m"))
    return steps.select("doc_id").distinct().join(named, F.col("doc_id") == F.col("m_doc"), "left").select("doc_id", F.coalesce("m", F.lit("unknown")).alias("model"))


def build_bank(questions: DataFrame) -> DataFrame:
    """doc_id, total, questions: the nested bank of each document, in order of section and number."""
    entry = F.struct("section_no", "number", F.struct(F.col("question_id").alias("id"), "question", "correct_answers", "wrong_answers", "source", "subjects").alias("q"))
    return questions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(entry))["q"].alias("questions"))


def placeholder_bank(blueprint: DataFrame) -> DataFrame:
    """Rows with fixed texts for every required question. blueprint: doc_id, section_id, section_no, section_title,
    book_id, chapter_id, questions."""
    chapter = F.coalesce(F.get(F.split("chapter_id", "_"), 1).try_cast("int"), F.lit(0))
    rows = blueprint.withColumn("chapter", chapter).withColumn("number", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "questions").cast("int"))))
    rows = rows.withColumn("question_id", question_id_col(F.col("book_id"), F.col("chapter"), F.col("section_no"), F.col("number")))
    texts = lambda kind, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.format_string(f"[Placeholder {kind} answer %d for %s]", k, F.col("question_id")))
    question = F.format_string("[Placeholder question %d - section %s]", "number", "section_id")
    source = F.format_string("%s Chapter %d - %s", "book_id", "chapter", "section_title")
    return rows.withColumns({"question": question, "correct": texts("correct", CORRECT), "wrong": texts("wrong", WRONG), "source": source, "subjects": F.array(F.coalesce(F.nullif(F.col("section_title"), F.lit("")), F.lit("General")))})
