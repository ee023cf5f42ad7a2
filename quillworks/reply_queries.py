"""Registered queries over ids, replies, banks and usage, and their SQL.

Replies are made of the given sections: JSON within chatter, answers as strings and as objects, wrong section ids, several
providers and attempts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillworks import queries as base
from quillworks.operators import bank, blueprint, measures, pairs
from quillworks.plans import views
from quillworks.sources.shared import stored

S = base.S


def id_contexts(spark, sf_dir):
    d = F.col("doc_id")
    rows = base._sections(spark, sf_dir).where("no = 1")
    prefix = F.when(d % 4 == 0, F.concat(F.lit(" afh_"), (d % 40).cast("string"), F.lit("x"))).when(d % 4 == 1, "").when(d % 4 == 2, F.concat(F.lit("7 b "), d.cast("string"))).otherwise("Ph")
    title = F.when(d % 3 == 0, "The Airplane Flying Handbook").when(d % 3 == 1, "about PHAK").otherwise(F.col("title"))
    made = rows.select("doc_id", prefix.alias("prefix"), title.alias("title"), F.when(d % 5 > 0, d % 5 - 2).alias("chapter"))
    return blueprint.id_context(made).select("doc_id", "book_id", F.col("chapter_number").cast("long").alias("chapter_number"), "chapter_id")


ID_CONTEXTS_SQL = f"""{S}, own AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'AFH' WHEN 3 THEN 'PH' END AS from_prefix, CASE doc_id % 3 WHEN 0 THEN 'AFH' WHEN 1 THEN 'PHAK' ELSE
    CASE WHEN contains(lower(title), 'airplane flying handbook') THEN 'AFH' WHEN contains(lower(title), 'phak') THEN 'PHAK' ELSE 'DOC' END END AS from_title,
    CASE doc_id % 4 WHEN 0 THEN doc_id % 40 WHEN 2 THEN 7 ELSE greatest(0, coalesce(CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 - 2 END, 0)) END AS chapter_number FROM sections WHERE no = 1
) SELECT doc_id, coalesce(from_prefix, from_title) AS book_id, chapter_number, lower(coalesce(from_prefix, from_title)) || '_' || chapter_number AS chapter_id FROM own"""


def section_ids(spark, sf_dir):
    rows = base._sections(spark, sf_dir)
    made = blueprint.section_id_col(F.col("book_id"), F.col("doc_id"), F.col("no"))
    given = F.when(F.col("no") % 3 == 0, made).when(F.col("no") % 3 == 1, F.col("id")).otherwise(F.col("title"))
    question = blueprint.question_id_col(F.when(F.col("no") % 4 > 0, F.col("book_id")), F.col("doc_id") - 5, F.col("no") - 2, F.col("no") % 3)
    return rows.select("doc_id", "no", made.alias("section_id"), blueprint.section_ordinal_col(given, F.col("no") + 900).cast("long").alias("ordinal"), question.alias("question_id"))


def request_payloads(spark, sf_dir):
    """What each request holds: its sections, their characters, and all excerpts put together."""
    rows = blueprint.request_payload(base._sections(spark, sf_dir))
    parts = F.from_json("payload", "struct<sections:array<struct<id:string,title:string,chars:long,excerpt:string>>>")["sections"]
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    return rows.select("doc_id", F.size(parts).cast("long").alias("n"), total.alias("chars"), F.array_join(parts["id"], " ").alias("ids"), F.array_join(parts["excerpt"], "|").alias("excerpts"))


def header_faults(spark, sf_dir):
    """Blueprint headers of each document, some strings left out."""
    rows = base._sections(spark, sf_dir).groupBy("doc_id").agg(F.count(F.when(F.col("doc_id") % 9 > 0, 1)).alias("n_sections"))
    fields = [F.when(F.col("doc_id") % (k + 2) > 0, f"some {f}").otherwise(F.when(F.col("doc_id") % 2 == 0, " ")).alias(f) for k, f in enumerate(blueprint.REQUIRED_STRINGS)]
    return blueprint.validate_headers(rows.select("doc_id", "n_sections", *fields))


def extracted_json(spark, sf_dir):
    rows, m = base._sections(spark, sf_dir), F.col("no") % 7
    body = F.concat(F.lit('{"n": '), F.col("no").cast("string"), F.lit(', "t": {"a": [1]}}'))
    reply = F.when(m == 0, body).when(m == 1, F.concat(F.lit("Here it is: "), body, F.lit(" as you wished."))).when(m == 2, "no JSON {here").when(m == 3, '{"n": }')
    reply = reply.when(m == 4, F.concat(F.lit("  "), body, F.lit("\n"))).when(m == 5, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.lit(None))
    return rows.select("doc_id", "no", bank.extract_json(reply).alias("json"))


def picked_replies(spark, sf_dir):
    """Four providers as given, two of them listed; which of them answers a request depends on its section's words."""
    given = F.array(*map(F.lit, ("delta", "alpha", "gamma", "beta")))
    rows = base._sections(spark, sf_dir).select("id", "no", "word_count", F.posexplode(given).alias("given", "provider"))
    good = (F.col("word_count") + F.ascii(F.substring("provider", 1, 1))) % 3 != F.col("no") % 3
    replies = rows.select(F.col("id").alias("request_id"), "provider", "given", (good & (F.col("no") % 11 > 0)).alias("ok"))
    priority = spark.createDataFrame([(" Gamma", 1), ("beta", 2), ("gamma", 5)], "provider string, rank int")
    return bank.pick_reply(replies, priority).select("request_id", "provider")


def _replies(spark, sf_dir):
    """Two attempts for each section, as replies with two questions; every fourth stands in chatter."""
    rows = base._sections(spark, sf_dir).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    asked = F.when((F.col("no") + F.col("attempt")) % 5 == 0, F.lit("x.9")).when(F.col("no") % 5 == 1, F.lit("")).otherwise(F.concat(F.lit(" "), "id", F.lit(" ")))
    tail = F.concat("id", F.lit(" "), F.col("attempt").cast("string"))
    one = F.concat(
        F.lit('{"sectionId": "'), asked, F.lit('", "question": " What does the section say about '), tail, F.lit('? ", "correct_answers": ["first '), tail,
        F.lit('", {"text": " second '), tail, F.lit('"}, "  ", {"other": 1}, 7, null, "{third} '), tail, F.lit('", "fourth"], "wrong_answers": ["w1", {"text": "w2"}], "subjects": ["s"]}'),
    )
    of_section = F.when(F.col("no") % 3 == 0, "").otherwise(F.concat(F.lit('"sectionId": "'), "id", F.lit('", ')))
    two = F.concat(F.lit('{'), of_section, F.lit('"question": "Short '), tail, F.lit('?", "correct_answers": null}'))
    body = F.concat(F.lit('{"questions": ['), one, F.lit(", "), two, F.lit("]}"))
    body = F.when(F.col("no") % 4 == 0, F.concat(F.lit("Sure, here:\n"), body, F.lit("\nAnything else?"))).when(F.col("no") % 7 == 3, F.lit("I cannot do that.")).otherwise(body)
    return rows.select("doc_id", F.col("id").alias("section_id"), F.lit(1).alias("slot"), "attempt", body.alias("body"))


def parsed_candidates(spark, sf_dir):
    rows = bank.parse_candidates(_replies(spark, sf_dir))
    text = lambda c: F.array_join(c, "|")
    return rows.select("doc_id", "section_id", F.col("attempt").cast("long").alias("attempt"), F.col("pos").cast("long").alias("pos"), "question", text("correct").alias("correct"), text("wrong").alias("wrong"), text(F.coalesce("subjects", F.array().cast("array<string>"))).alias("subjects"))


PARSED_SQL = f"""{S}, tried AS (
  SELECT *, unnest([1, 2]) AS attempt FROM sections
), answered AS (
  SELECT *, id || ' ' || attempt AS tail FROM tried WHERE NOT (no % 7 = 3 AND no % 4 <> 0)
)
SELECT doc_id, id AS section_id, CAST(attempt AS BIGINT) AS attempt, CAST(0 AS BIGINT) AS pos, 'What does the section say about ' || tail || '?' AS question, 'first ' || tail || '|second ' || tail || '|{{third}} ' || tail AS correct, 'w1|w2' AS wrong, 's' AS subjects
FROM answered WHERE (no + attempt) % 5 <> 0 AND no % 5 <> 1
UNION ALL SELECT doc_id, id, attempt, 1, 'Short ' || tail || '?', '', '', '' FROM answered WHERE no % 3 <> 0"""


def gated_faults(spark, sf_dir):
    """The gate on candidates with equal answers, generic ones and wrong numbers of them."""
    rows = base._sections(spark, sf_dir)
    answer = lambda kind, k: F.concat(F.lit(f"The {kind} answer no. "), k.cast("string"), F.lit(" of this section"))
    correct = F.transform(F.sequence(F.lit(1), F.when(F.col("no") % 7 == 2, 4).otherwise(3)), lambda k: answer("right", k))
    wrong = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.when((F.col("no") % 7 == 3) & (k == 8), F.upper(answer("right", F.lit(2)))).when((F.col("no") % 7 == 4) & (k == 5), F.lit(" Incorrect option 3 ")).otherwise(answer("wrong", k)))
    question = F.concat(F.lit("What is the right thing to do in section"), F.when(F.col("no") % 7 == 5, ".").otherwise("?"))
    made = rows.select("doc_id", "no", question.alias("question"), correct.alias("correct"), wrong.alias("wrong"))
    return bank.quality_gate(made).select("doc_id", "no", "fault")


def nested_bank(spark, sf_dir):
    """The nested bank of each document, written as text."""
    q = F.transform("questions", lambda x: F.concat_ws("/", x["id"], F.element_at(x["correct_answers"]["id"], 3), F.element_at(x["wrong_answers"]["id"], 8), F.element_at(x["wrong_answers"]["text"], 1), x["source"], F.array_join(x["subjects"], ",")))
    return bank.build_bank(base._accepted(spark, sf_dir)).select("doc_id", "total", F.array_join(q, "|").alias("questions"))


def model_labels(spark, sf_dir):
    model = F.when(F.col("no") % 6 == 1, "m-one").when(F.col("no") % 6 == 2, "m-two").when(F.col("no") % 6 == 4, "").when((F.col("no") % 6 == 5) & (F.col("doc_id") % 2 == 0), "a-three")
    return bank.model_label(base._sections(spark, sf_dir).where("no <> 1 or doc_id % 3 > 0").select("doc_id", F.col("no").alias("step"), model.alias("model")))


def padded_answers(spark, sf_dir):
    answers = F.when(F.col("no") % 6 < 5, F.transform(F.sequence(F.lit(1), (F.col("no") % 6 + 1).cast("int")), lambda k: F.concat("id", F.lit(" "), k.cast("string"))))
    return base._sections(spark, sf_dir).select("doc_id", "no", F.array_join(pairs.padded_col(answers, bank.CORRECT, "Correct"), "|").alias("answers"))


def record_requests(spark, sf_dir):
    rows = pairs.record_request(base._accepted(spark, sf_dir))
    return rows.select("doc_id", "target", F.array_join(F.col("sample.question_id"), " ").alias("sample"))


def documents_without_records(spark, sf_dir):
    """Documents with accepted questions whose reply holds no good record: every fourth says nothing."""
    requests = stored(pairs.record_request(base._accepted(spark, sf_dir)), "requests")
    said = F.when(F.col("doc_id") % 4 == 1, '{"records": [{"instruction": " ", "response": "x"}]}').when(F.col("doc_id") % 4 == 2, "no JSON").otherwise('{"records": [{"instruction": "Explain.", "response": "So it is."}]}')
    replies = requests.select("doc_id", F.lit("DOC").alias("book_id"), F.lit(0).alias("chapter"), said.alias("body"))
    return pairs.documents_without_records(requests, pairs.clean_records(replies, requests))


def read_times(spark, sf_dir):
    given = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5)
    rows = base._sections(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.length("content")).alias("chars"))
    return rows.select("doc_id", measures.read_time_col(given, F.col("chars")).alias("minutes"))


def usage_rollup(spark, sf_dir):
    model = F.when(F.col("no") % 3 > 0, F.concat(F.lit("m-"), F.col("no").cast("string")))
    steps = base._sections(spark, sf_dir).select("doc_id", F.col("no").alias("step"), model.alias("model"), F.when(F.col("no") % 4 > 0, F.col("word_count")).alias("prompt_tokens"), (F.col("no") % 5).alias("completion_tokens"))
    return measures.usage_rollup(steps)


def key_points(spark, sf_dir):
    rows = base._sections(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "title"))).alias("t"))
    titles = F.col("t.title")
    points = F.when(F.col("doc_id") % 3 == 0, F.transform(titles, lambda t: F.concat(F.lit("  "), t, F.lit("\n")))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(" "), F.lit("")))
    return rows.select("doc_id", F.array_join(measures.key_points_col(points, titles), "|").alias("points"))


def _slot_rows(spark, sf_dir):
    """Three attempts for each of four slots, stems made of the section's own words (in changing case), some missing."""
    four = F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))
    # one of the first five words, found before the rows multiply
    words = F.split(F.trim(F.regexp_replace("content", r"\s+", " ")), " ", 6)
    rows = base._sections(spark, sf_dir).where("word_count > 0").withColumn("w", words).withColumn("slot", four)
    rows = rows.withColumn("attempt", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    at = (F.col("slot") * F.col("attempt") + F.col("no")) % F.least("word_count", F.lit(5))
    word = F.get("w", at.cast("int"))
    letter = F.translate(F.substring(word, 1, 1), "ß", "ẞ")
    stem = F.concat(F.lit("Stem "), F.when(F.col("attempt") == 2, F.upper(letter)).otherwise(letter))
    return rows.where((F.col("no") + F.col("slot") * F.col("attempt")) % 4 > 0).select("doc_id", F.col("id").alias("section_id"), "slot", "attempt", F.lit(0).alias("pos"), stem.alias("question"), F.array().cast("array<string>").alias("subjects"))


def slot_questions(spark, sf_dir):
    """Questions by the exact slot rule; one to three are required, four slots were asked."""
    need = base._sections(spark, sf_dir).select("doc_id", F.col("id").alias("section_id"), F.col("title").alias("section_title"), (F.col("no") % 3 + 1).alias("questions"))
    found = bank.accept_questions(_slot_rows(spark, sf_dir), need, "slots", views.tasks(views.documents(spark, sf_dir)))
    return found.select("doc_id", "section_id", F.col("slot").cast("long").alias("slot"), F.col("attempt").cast("long").alias("attempt"), "question", "number")


#: Slot after slot by recursion: the first attempt whose stem is not among those taken, if there is one.
SLOTS_SQL = f"""WITH RECURSIVE {S.removeprefix("WITH ")}, tried AS (
  SELECT doc_id, id, no % 3 + 1 AS needed, s.slot, a.attempt, string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ')[(s.slot * a.attempt + no) % least(word_count, 5) + 1][1] AS letter, replace(letter, 'ß', 'ẞ') AS c
  FROM sections, (VALUES (1), (2), (3), (4)) s(slot), (VALUES (1), (2), (3)) a(attempt) WHERE word_count > 0 AND (no + s.slot * a.attempt) % 4 > 0
), offers AS (
  SELECT doc_id, id, needed, slot, list(struct_pack(attempt := attempt, question := 'Stem ' || CASE WHEN attempt = 2 THEN upper(c) ELSE c END) ORDER BY attempt) AS l FROM tried GROUP BY doc_id, id, needed, slot
), steps AS (
  SELECT doc_id, id, no % 3 + 1 AS needed, 0 AS slot, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS STRUCT(attempt INT, question VARCHAR)) AS pick FROM sections WHERE word_count > 0
  UNION ALL
  SELECT doc_id, id, needed, slot, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, lower(pick.question)) END, pick FROM (
    SELECT s.doc_id, s.id, s.needed, s.slot + 1 AS slot, s.taken, list_filter(o.l, lambda x: NOT list_contains(s.taken, lower(x.question)))[1] AS pick
    FROM steps s LEFT JOIN offers o ON o.doc_id = s.doc_id AND o.id = s.id AND o.slot = s.slot + 1 WHERE s.slot < s.needed)
)
SELECT doc_id, id AS section_id, CAST(slot AS BIGINT) AS slot, CAST(pick.attempt AS BIGINT) AS attempt, pick.question AS question, CAST(len(taken) AS BIGINT) AS number FROM steps WHERE pick IS NOT NULL"""

QUERIES = {
    "id_contexts": id_contexts,
    "section_ids": section_ids,
    "request_payloads": request_payloads,
    "header_faults": header_faults,
    "extracted_json": extracted_json,
    "picked_replies": picked_replies,
    "parsed_candidates": parsed_candidates,
    "gated_faults": gated_faults,
    "nested_bank": nested_bank,
    "model_labels": model_labels,
    "padded_answers": padded_answers,
    "record_requests": record_requests,
    "documents_without_records": documents_without_records,
    "read_times": read_times,
    "usage_rollup": usage_rollup,
    "key_points": key_points,
    "slot_questions": slot_questions,
    "proportional_allotment": lambda s, d: _proportional(s, d),
}


def _proportional(spark, sf_dir):
    rows = base._sections(spark, sf_dir).select("doc_id", "no", F.col("section_weight").alias("weight"), F.lit(None).cast("long").alias("given"), F.lit(40).cast("long").alias("target"))
    return blueprint.allocate_questions(rows, mode="proportional").select("doc_id", "no", "questions")


BODY = "'{\"n\": ' || no || ', \"t\": {\"a\": [1]}}'"
ORACLE_SQL = {
    "id_contexts": ID_CONTEXTS_SQL,
    "section_ids": f"""{S} SELECT doc_id, no, lower(book_id) || '_' || doc_id || '_' || no AS section_id,
  CAST(CASE WHEN no % 3 < 2 THEN no WHEN regexp_matches(title, '_[0-9]+$') THEN CAST(regexp_extract(title, '_([0-9]+)$', 1) AS BIGINT) WHEN regexp_matches(title, '\\.[0-9]+$') THEN CAST(regexp_extract(title, '\\.([0-9]+)$', 1) AS BIGINT) ELSE no + 900 END AS BIGINT) AS ordinal,
  CASE WHEN no % 4 > 0 THEN book_id ELSE 'DOC' END || '.' || greatest(0, doc_id - 5) || '.' || greatest(1, no - 2) || '.' || greatest(1, no % 3) AS question_id FROM sections""",
    "request_payloads": f"""{S} SELECT doc_id, count(*) AS n, CAST(sum({base.CHARS}) AS BIGINT) AS chars, string_agg(id, ' ' ORDER BY no) AS ids, string_agg(trim(regexp_replace(content, '\\s+', ' ', 'g'))[1:900], '|' ORDER BY no) AS excerpts FROM sections GROUP BY doc_id""",
    "header_faults": " UNION ALL ".join(f"SELECT doc_id, 'questionBank.{f} must be a non-empty string.' AS error FROM documents WHERE text <> '' AND doc_id % {k + 2} = 0" for k, f in enumerate(blueprint.REQUIRED_STRINGS))
    + " UNION ALL SELECT doc_id, 'questionBank.sectionBlueprints must be a non-empty array.' FROM documents WHERE text <> '' AND doc_id % 9 = 0",
    "extracted_json": f"{S} SELECT doc_id, no, CASE WHEN no % 7 IN (0, 1, 4, 5) THEN {BODY} END AS json FROM sections",
    "picked_replies": f"""{S}, r AS (SELECT id, no, p.*, row_number() OVER (PARTITION BY id ORDER BY rank NULLS LAST, given) AS place FROM sections, (VALUES ('delta', 0, 100, NULL), ('alpha', 1, 97, NULL), ('gamma', 2, 103, 1), ('beta', 3, 98, 2)) p(provider, given, code, rank) WHERE (word_count + code) % 3 <> no % 3 AND no % 11 > 0)
SELECT id AS request_id, provider FROM r WHERE place = 1""",
    "parsed_candidates": PARSED_SQL,
    "gated_faults": f"{S} SELECT doc_id, no, CASE no % 7 WHEN 5 THEN 'no question mark' WHEN 2 THEN 'answer count' WHEN 4 THEN 'poor answer' WHEN 3 THEN 'equal answers' END AS fault FROM sections",
    "nested_bank": f"""{base.ACCEPTED_SQL} SELECT doc_id, count(*) AS total, string_agg(question_id || '/' || question_id || '.c.3/' || question_id || '.w.8/The wrong answer number 1 is about ' || title || '/DOC Chapter ' || doc_id || ' - ' || title || '/' || title, '|' ORDER BY no, number) AS questions FROM accepted GROUP BY doc_id""",
    "model_labels": f"""{S}, named AS (SELECT doc_id, no, CASE WHEN no % 6 = 1 THEN 'm-one' WHEN no % 6 = 2 THEN 'm-two' WHEN no % 6 = 5 AND doc_id % 2 = 0 THEN 'a-three' END AS model FROM sections WHERE no <> 1 OR doc_id % 3 > 0),
firsts AS (SELECT doc_id, model, min(no) AS first_no FROM named WHERE model IS NOT NULL GROUP BY 1, 2), l AS (SELECT doc_id, string_agg(model, '+' ORDER BY first_no) AS m FROM firsts GROUP BY 1)
SELECT DISTINCT n.doc_id, coalesce(m, 'unknown') AS model FROM named n LEFT JOIN l USING (doc_id)""",
    "padded_answers": f"""{S} SELECT doc_id, no, array_to_string(list_transform([1, 2, 3], lambda k: CASE WHEN no % 6 < 5 AND k <= no % 6 + 1 THEN id || ' ' || k ELSE '[Correct answer ' || k || ']' END), '|') AS answers FROM sections""",
    "record_requests": f"""{base.ACCEPTED_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no, number) AS q FROM accepted)
SELECT doc_id, greatest(1, CAST(floor(count(*) * 11 * CAST(0.3 AS DOUBLE)) AS BIGINT)) AS target, string_agg(question_id, ' ' ORDER BY q) FILTER (WHERE q <= 40) AS sample FROM placed GROUP BY doc_id""",
    "documents_without_records": f"{base.ACCEPTED_SQL} SELECT DISTINCT doc_id FROM accepted WHERE doc_id % 4 IN (1, 2)",
    "read_times": f"{S} SELECT doc_id, CAST(greatest(1, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 ELSE floor(sum({base.CHARS}) / 1200.0 + 0.5) END) AS BIGINT) AS minutes FROM sections GROUP BY doc_id",
    "usage_rollup": f"""{S} SELECT doc_id, CAST(sum(CASE WHEN no % 4 > 0 THEN word_count ELSE 0 END) AS BIGINT) AS prompt_tokens, CAST(sum(no % 5) AS BIGINT) AS completion_tokens, 'm-' || max(CASE WHEN no % 3 > 0 THEN no END) AS model FROM sections GROUP BY doc_id""",
    "key_points": f"""{S}, t AS (SELECT doc_id, no, title, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS r FROM sections WHERE title <> '') SELECT d.doc_id, coalesce(string_agg(title, '|' ORDER BY no) FILTER (WHERE r <= 24), '') AS points FROM (SELECT DISTINCT doc_id FROM sections) d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""",
    "slot_questions": SLOTS_SQL,
    "proportional_allotment": f"""{S}, normal AS (SELECT doc_id, no, section_weight AS weight, CAST(floor(section_weight / 100 * greatest(40, count(*) OVER (PARTITION BY doc_id)) + 0.5) AS BIGINT) AS given, 40 AS target FROM sections), {base.views.ALLOCATED_SQL} SELECT doc_id, no, questions FROM allotted""",
}
