"""The three workloads end to end: texts to sections, sections to training pairs, sections to summaries and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.operators import bank, blueprint, documents, measures, pairs
from quillworks.plans import views
from quillworks.sources import runs


def section_documents(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Raw texts to numbered, weighted sections."""
    return documents.process_documents(docs, tasks)


def required_questions(sections: DataFrame) -> DataFrame:
    """doc_id, section_id, section_title, no, questions of a word blueprint."""
    # the title goes along: a join for it would read the sections again and deal them by section
    rows = blueprint.word_blueprint(sections, also=("title",)).where("doc_id is not null")
    return rows.select("doc_id", F.col("id").alias("section_id"), F.col("title").alias("section_title"), "no", "questions")


def question_bank(sections: DataFrame, candidates: DataFrame, tasks: int | None = None) -> DataFrame:
    """Accepted questions with ids: doc_id, section_no, number, question_id, question, correct, wrong, source, subjects."""
    gated = bank.quality_gate(candidates).where("fault is null")
    accepted = bank.accept_questions(gated, required_questions(sections), tasks=tasks)
    rows = accepted.select("doc_id", "section_id", F.col("no").alias("section_no"), "number", "question", "correct", "wrong", "subjects", "section_title")
    named = rows.withColumns({"book_id": F.lit("DOC"), "chapter": F.col("doc_id").cast("int"), "source": F.format_string("DOC Chapter %d - %s", "doc_id", "section_title"), "id_base": F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))})
    return bank.with_ids(named)


def training_data(sections: DataFrame, candidates: DataFrame, tasks: int | None = None) -> DataFrame:
    """Eleven labelled pairs for every accepted question."""
    accepted = question_bank(sections, candidates, tasks)
    return pairs.training_pairs(accepted.repartition(tasks, "doc_id") if tasks else accepted)


def costs(sections: DataFrame, prices: list[tuple[str, float, float]] = measures.PRICES) -> DataFrame:
    return measures.cost_estimate(measures.token_estimate(measures.document_metrics(sections)), prices)


def output_builders(sections: DataFrame, candidates: DataFrame, replies: DataFrame, tasks: int | None = None) -> dict[str, runs.Builder]:
    """How each output of the handbook jobs is made, the predecessors given as stored tables.

    sections: of a document (with chapter and doc_title for summaries); replies: doc_id, book_id, chapter, body.
    """

    def records(made: dict[str, DataFrame]) -> DataFrame:
        return pairs.clean_records(replies, pairs.record_request(made["bank"]))

    def summary(made: dict[str, DataFrame]) -> DataFrame:
        return measures.fallback_summary(measures.document_summary(sections), measures.top_sections(sections))

    return {
        "blueprint": lambda made: blueprint.word_blueprint(sections),
        "bank": lambda made: question_bank(sections, candidates, tasks),
        "pairs": lambda made: pairs.training_pairs(made["bank"]),
        "records": records,
        "summary": summary,
    }


def run_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_data(views.para_sections(spark, sf_dir), views.candidates(spark, sf_dir), views.tasks(views.documents(spark, sf_dir)))
