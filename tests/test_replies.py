"""Replies and acceptance: the slot rule against a loop, section ids, providers, hot sections, records and their totals."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from quillworks.operators import bank, measures, pairs

from tests.test_queries import plan

CANDIDATES = "doc_id long, section_id string, slot int, attempt int, pos int, question string, subjects array<string>, extra string"
NEED = "doc_id long, section_id string, section_title string, questions int"


def by_loop(rows, need):
    """Slot after slot, attempt after attempt, candidate after candidate."""
    of = defaultdict(list)
    for doc, section, slot, attempt, pos, question, *_ in rows:
        of[doc, section].append((slot, attempt, pos, question))
    out = []
    for doc, section, _, needed in need:
        taken = set()
        for slot in range(1, max(1, needed) + 1):
            for s, attempt, pos, question in sorted(of[doc, section]):
                if s == slot and attempt <= 6 and question.lower() not in taken:
                    taken.add(question.lower())
                    out.append((doc, section, slot, attempt, pos, question, len(taken)))
                    break
    return sorted(out)


def test_slots_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(d, f"s{k}", slot, attempt, pos, rng.choice(["A", "a", "b", "C", "c", "d"]), [], "x") for d in range(12) for k in range(4) for slot in range(0, 6) for attempt in range(1, 9) for pos in range(2) if rng.random() < 0.15]
    need = [(d, f"s{k}", "T", rng.randint(0, 4)) for d in range(12) for k in range(4)]
    rows += [(None, "s1", 1, 1, 0, "n", [], "x"), (1, None, 1, 1, 0, "n", [], "x"), (99, "s0", 1, 1, 0, "n", [], "x")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # sections go on over batch ends
    try:
        found = bank.accept_questions(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame(need, NEED), "slots")
        got = sorted((r.doc_id, r.section_id, r.slot, r.attempt, r.pos, r.question, r.number) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == by_loop([r for r in rows if r[0] is not None and r[1] is not None], need)


def test_slots_beyond_the_required_number_stay_out(spark):
    rows = [(1, "s", 2, 1, 0, "second", ["own"], "x"), (1, "s", 3, 1, 0, "third", [], "x")]
    found = bank.accept_questions(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame([(1, "s", "T", 2)], NEED), "slots")
    assert [(r.question, r.number, r.subjects, r.extra) for r in found.collect()] == [("second", 1, ["own"], "x")]
    assert [(r.needed, r.accepted) for r in bank.shortfall(found, spark.createDataFrame([(1, "s", "T", 2)], NEED)).collect()] == [(2, 1)]


def test_batch_of_a_hot_section(spark):
    """The parts give the same rows as one plain ranking, and no window groups a section's candidates all at once."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("hot").alias("section_id"), (F.col("id") % 50 + 1).cast("int").alias("slot"), F.lit(1).alias("attempt"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("Q"), (F.col("id") % 700).cast("string")).alias("question"), F.array().cast("array<string>").alias("subjects"))
    need = spark.createDataFrame([(1, "hot", "T", 40)], NEED)
    found = bank.accept_questions(rows, need)
    first = {}
    for k in sorted(range(20_000), key=lambda i: (i % 50, i)):
        first.setdefault(f"Q{k % 700}", (k % 50 + 1, k))
    want = [q for q, _ in sorted(first.items(), key=lambda x: x[1])][:40]
    assert [(r.question, r.number) for r in found.orderBy("number").collect()] == [(q, n + 1) for n, q in enumerate(want)]
    text = plan(found)
    assert text.index("part#") < len(text) and "WindowGroupLimit" in text


@pytest.mark.parametrize(
    "body,want",
    [
        ('{"questions": [{"sectionId": " s ", "question": " Q? "}]}', ["Q?"]),
        ('{"questions": [{"sectionId": "s", "question": 7}]}', [""]),
        ('{"questions": [{"question": "no id?"}, {"sectionId": " ", "question": "blank"}, {"sectionId": "t", "question": "other"}, {"sectionId": null, "question": "n"}]}', []),
        ('Sure: {"questions": [{"sectionId": "s", "question": "in chatter"}]} bye', ["in chatter"]),
        ('{"questions": [{"sectionId": "s", "question": "cut off"}', []),
        ('{"questions": {"sectionId": "s"}}', []),
        ("[1]", []),
        ("", []),
        (None, []),
    ],
)
def test_section_ids_of_replies(spark, body, want):
    replies = spark.createDataFrame([(1, "s", 1, 1, body)], "doc_id long, section_id string, slot int, attempt int, body string")
    assert [r.question for r in bank.parse_candidates(replies).collect()] == want


def test_parsed_answers(spark):
    body = '{"questions": [{"sectionId": "s", "question": "q", "subjects": [" a ", "", null, "b"], "correct_answers": [" one ", {"text": " two "}, {"text": 5}, 6, null, "", {"t": "x"}, "three", "four"], "wrong_answers": "none"}]}'
    replies = spark.createDataFrame([(1, "s", 1, 1, body)], "doc_id long, section_id string, slot int, attempt int, body string")
    (row,) = bank.parse_candidates(replies).collect()
    assert (row.correct, row.wrong, row.subjects) == (["one", "two", "three"], [], ["a", "b"])


def test_unlisted_providers_keep_their_order(spark):
    rows = [("r1", "zeta", 0, True), ("r1", "alpha", 1, True), ("r2", "zeta", 0, False), ("r2", "alpha", 1, True), ("r2", "mid", 2, True), ("r3", "alpha", 1, True), ("r3", "mid", 2, True)]
    replies = spark.createDataFrame(rows, "request_id string, provider string, given int, ok boolean")
    listed = spark.createDataFrame([(" MID ", 1)], "provider string, rank int")
    assert sorted((r.request_id, r.provider) for r in bank.pick_reply(replies, listed).collect()) == [("r1", "zeta"), ("r2", "mid"), ("r3", "mid")]
    none = spark.createDataFrame([], "provider string, rank int")
    assert sorted((r.request_id, r.provider) for r in bank.pick_reply(replies, none).collect()) == [("r1", "zeta"), ("r2", "alpha"), ("r3", "alpha")]


def test_summaries_name_model_and_untitled(spark):
    rows = [(1, k, f"1.{k}" if k > 1 else "", "" if k == 2 else f"T{k}", "x" * (20 - k), 1) for k in range(1, 11)]
    sections = spark.createDataFrame(rows, "doc_id long, no long, id string, title string, content string, word_count long")
    tops = measures.top_sections(sections)
    assert [(r.rank, r.title, r.id) for r in tops.orderBy("rank").collect()][:2] == [(1, "T1", None), (2, "Untitled", "1.2")]
    (text,) = [r.markdown for r in measures.fallback_summary(measures.document_summary(sections), tops).collect()]
    assert text.count("\n- T") + text.count("\n- Untitled") == 8 and "- T1 (n/a)" in text and "- Model Used: deterministic" in text


def test_record_totals(spark):
    questions = spark.createDataFrame([(1, 1, k, f"D.1.1.{k}", "src", ["t"], f"q{k}") for k in range(1, 4)], "doc_id long, section_no long, number long, question_id string, source string, subjects array<string>, question string")
    requests = pairs.record_request(questions)
    body = '{"records": [{"instruction": "Do", "response": "so", "sourceQuestionId": "D.1.1.2"}, {"instruction": "Do", "response": ""}, {"instruction": "Do", "response": "that"}]}'
    replies = spark.createDataFrame([(1, "D", 0, body)], "doc_id long, book_id string, chapter long, body string")
    records = pairs.clean_records(replies, requests)
    assert [(r.number, r.response, r.topic, r.source) for r in records.orderBy("number").collect()] == [(1, "so", "t", "src"), (2, "that", "General", "D chapter ?")]
    headers = spark.createDataFrame([(1, 0, "", "m", "v")], "doc_id long, chapter long, chapter_title string, model_used string, model_version string")
    (row,) = pairs.record_metadata(records, requests, headers).collect()
    assert tuple(row) == (1, None, "Unknown", 2, 9, "instruction-training-record", "m", "v")


def test_empty_tables(spark):
    none = spark.createDataFrame([], CANDIDATES)
    need = spark.createDataFrame([], NEED)
    assert all(bank.accept_questions(none, need, mode).collect() == [] for mode in ("batch", "slots"))
