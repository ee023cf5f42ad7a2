"""Every handbook query against its SQL, and what the plans look like."""

import pytest
from quillworks import cleaning_queries, document_queries, reply_queries
from quillworks import queries as core
from quillworks.plans import views

from tests.compare import same_rows

SF = "/root/testdata/sf0.001"
QUERIES = core.QUERIES | document_queries.QUERIES | reply_queries.QUERIES | cleaning_queries.QUERIES
ORACLE_SQL = core.ORACLE_SQL | document_queries.ORACLE_SQL | reply_queries.ORACLE_SQL | cleaning_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_share_one_exchange(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(core.QUERIES["word_blueprint"](spark, SF))
        assert text.count("Exchange hashpartitioning") == 1
        assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


#: Exchanges and scans at most: W2 (sections to pairs, and to records) and W3 (summaries, overlap, costs).
MOST = {"training_pairs": (7, 3), "clean_records": (9, 4), "slot_questions": (4, 2), "document_summary": (1, 1), "overlap_flags": (4, 1), "cost_estimate": (1, 1), "detailed_summary": (2, 1), "parsed_candidates": (1, 1)}


@pytest.mark.parametrize("name", sorted(MOST))
def test_plans_of_pairs_and_summaries(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    exchanges, scans = MOST[name]
    assert text.count("Exchange hashpartitioning") <= exchanges and text.count("FileScan") <= scans
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_made_lines_need_no_row_each(spark):
    """Lines are made where their text is: rows for them, each with all words of the text, would be dealt and sorted."""
    text = plan(cleaning_queries._wrapped(spark, SF))
    assert "Generate" not in text and "Exchange" not in text


#: As dealt by the size of the documents: how many tasks, and exchanges at most.
SIZED = {"training_pairs": 5, "pair_totals": 5, "slot_questions": 5, "clean_text": 1, "document_status": 2, "detected_sections": 1, "section_bodies": 1}


@pytest.mark.parametrize("name", sorted(SIZED))
def test_tasks_grow_with_the_documents(spark, monkeypatch, name):
    """What a task sorts does not grow with the table: it is dealt by its characters, not by the session's number."""
    monkeypatch.setattr(views, "TASK_CHARS", 1_000)
    n = views.tasks(views.documents(spark, SF))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert n > 100 and f", {n}), REPARTITION_BY_NUM" in text
    assert text.count("Exchange hashpartitioning") <= SIZED[name] and text.count("FileScan") == 1
