"""The pipeline over `documents`: select by quality, apply rules, drop near copies, mix the sources, pack.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame: the documents
with their columns, and from the last stage the pieces of the packed sequences.

Defined results of every stage: extra columns, also those named like a column that an operator makes, are passed on;
rows that share an id are decided each for itself; null ids, sources and lengths are allowed; an empty table gives an
empty result; texts are read whole. Null and empty texts: the first stage scores them by their measures alone, the
second drops them (fewer than 20 words). What a stage does with ties and repeated rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillworks.llm import common, mixing, packing, quality_classifier, quality_rules, simhash
from quillworks.llm.tokens import tokenizer_path

#: A trained model, XXH64 bits and a tokenizer make no SQL: the stages are tested against brute force.
ORACLE_SQL = None


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects, P(grade >= 1) >= 0.5 (equal counts as selected).

    Repeated rows have one score, so they stay or go together. Without a rated document, or with one grade, all
    documents have that grade: grades from 1 keep all, grade 0 or none keeps nothing.
    """
    ratings = quality_classifier.graded(common.table(spark, sf_dir, "labels"))
    return quality_classifier.keep_documents(docs, quality_classifier.fit(docs, ratings))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio (a score equal to the threshold passes).

    Repeated rows stay or go together. Without a trusted document the base rules alone decide.
    """
    return quality_rules.keep_documents(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every near-duplicate component: the smallest id, null ids last, ties by the row's hash.

    Of wholly equal rows one stays. Texts without a word have fingerprint zero and are one component.
    """
    return simhash.keep_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (never, once, up to three times), in training order.

    A null source is one of its own. Wholly equal rows are taken each for itself. A text without a word is not taken.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens; repeated rows are packed each for itself, an empty text as its end id."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", select_quality),
    ("quality rules", apply_rules),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written and read again as the next one's documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
