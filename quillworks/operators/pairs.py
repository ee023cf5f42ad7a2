"""Training pairs and instruction records from question banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillworks.functions.textops import let, strip_col
from quillworks.operators.bank import CORRECT, WRONG

PAIRS, RECORD_SHARE, SAMPLE, CONTEXT_CHARS = CORRECT + WRONG, 0.3, 40, 180
RECORDS = "struct<records:array<struct<instruction:string,context:string,response:string,sourceQuestionId:string,metadata:struct<source:string,topic:string,difficulty:string>>>>"


def padded_col(answers: Column, n: int, kind: str) -> Column:
    """The first n answers, and placeholders for missing ones."""
    own = F.slice(F.coalesce(answers, F.array().cast("array<string>")), 1, n)
    pads = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit(f"[{kind} answer "), k.cast("string"), F.lit("]")))
    return F.concat(own, F.slice(pads, F.size(own) + 1, F.lit(n)))


def training_pairs(questions: DataFrame) -> DataFrame:
    """Eleven rows per question: id, doc_id, question_id, source, input, output, label, pos.

    questions: doc_id, id_base, question_id, section_no, number, question, correct, wrong, source. The question's place
    in its document is found before the rows multiply.
    """
    doc = Window.partitionBy("doc_id")
    rows = questions.withColumns({"q": F.row_number().over(doc.orderBy("section_no", "number")), "n": F.count(F.lit(1)).over(doc)})
    label = lambda kind: lambda a: F.struct(F.lit(kind).alias("label"), a.alias("output"))
    both = F.concat(F.transform(padded_col(F.col("correct"), CORRECT, "Correct"), label("correct")), F.transform(padded_col(F.col("wrong"), WRONG, "Wrong"), label("wrong")))
    rows = rows.select("doc_id", "id_base", "question_id", "source", "question", "q", "n", F.posexplode(both).alias("at", "a"))
    pos = F.col("at") + 1
    return rows.select(F.format_string(f"%s_d_%d-q-%d-%d_p%d-{PAIRS}", "id_base", "q", "q", "n", pos).alias("id"), "doc_id", "question_id", "source", F.col("question").alias("input"), F.col("a.output").alias("output"), F.col("a.label").alias("label"), pos.cast("long").alias("pos"))


def pair_totals(pairs: DataFrame) -> DataFrame:
    """doc_id, total_questions, total_pairs, correct_pairs, wrong_pairs."""
    of = lambda label: F.count(F.when(F.col("label") == label, 1))
    # a question has PAIRS pairs, so no second grouping by question is needed
    total = F.count(F.lit(1))
    return pairs.groupBy("doc_id").agg(F.floor(total / PAIRS).alias("total_questions"), total.alias("total_pairs"), of("correct").alias("correct_pairs"), of("wrong").alias("wrong_pairs"))


def placeholder_pairs(bank: DataFrame) -> DataFrame:
    """Pairs of placeholder questions. Ids end with the answer's number alone, so right and wrong ones share ids 1 to 3."""
    label = lambda kind: lambda a, k: F.struct(F.lit(kind).alias("label"), (k + 1).alias("k"), a.alias("output"))
    both = F.concat(F.transform("correct", label("correct")), F.transform("wrong", label("wrong")))
    rows = bank.withColumn("a", F.explode(both))
    text = F.format_string("[Placeholder question %d — section %s]", "number", "section_id")
    return rows.select("doc_id", F.format_string("%s.pair.%d", "question_id", "a.k").alias("id"), "question_id", text.alias("input"), F.col("a.output").alias("output"), F.col("a.label").alias("label"))


def repeated_ids(pairs: DataFrame) -> DataFrame:
    """doc_id, id, n of the ids that stand more than once."""
    return pairs.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def record_request(questions: DataFrame) -> DataFrame:
    """doc_id, target (three tenths of the pairs, 1 at least), sample (the first 40 questions)."""
    doc = Window.partitionBy("doc_id")
    rows = questions.withColumns({"q": F.row_number().over(doc.orderBy("section_no", "number")), "n": F.count(F.lit(1)).over(doc)})
    entry = F.when(F.col("q") <= SAMPLE, F.struct("q", "question_id", "source", "subjects", "question"))
    return rows.groupBy("doc_id").agg(F.greatest(F.lit(1), F.floor(F.max("n") * PAIRS * F.lit(RECORD_SHARE))).cast("long").alias("target"), F.array_sort(F.collect_list(entry)).alias("sample"))


def clean_records(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """doc_id, number, instruction, context, response, source, topic, difficulty: good records, up to the target.

    replies: doc_id, book_id, chapter, body; requests: of record_request.
    """
    own = lambda c: strip_col(F.coalesce(c, F.lit("")))
    some = lambda c: F.nullif(c, F.lit(""))
    # target and sample come with the reply, before records multiply: one join, and no second reading of the bank
    asked = requests.select(F.col("doc_id").alias("a_doc"), "target", "sample")
    rows = replies.join(asked, F.col("doc_id") == F.col("a_doc"))

    def sampled(r: Column) -> Column:
        return F.struct(r.alias("r"), F.get(F.filter("sample", lambda q: q["question_id"] == own(r["sourceQuestionId"])), 0).alias("s"))

    # a record finds its question where the sample is: records with the sample each would be rows of forty questions
    records = let(F.from_json("body", RECORDS), lambda x: F.transform(x["records"], sampled))
    rows = rows.select("doc_id", "book_id", "chapter", "target", F.posexplode(records).alias("pos", "found")).select("*", "found.r", "found.s")
    rows = rows.withColumns({"instruction": own(F.col("r.instruction")), "response": own(F.col("r.response"))}).where("instruction <> '' and response <> ''")
    rows = rows.withColumns({"s_source": F.col("s.source"), "s_topic": F.get("s.subjects", F.lit(0))})
    chapter = F.when(F.coalesce(F.col("chapter").cast("int"), F.lit(0)) == 0, "?").otherwise(F.col("chapter").cast("string"))
    fallback = F.coalesce(some(F.col("s_source")), F.concat(F.col("book_id"), F.lit(" chapter "), chapter))
    context = own(F.col("r.context"))
    short = F.when(F.length(context) > CONTEXT_CHARS, strip_col(F.substring(context, 1, CONTEXT_CHARS))).otherwise(context)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long")
    rows = rows.withColumn("number", number).where(F.col("number") <= F.col("target"))
    return rows.select("doc_id", "number", "instruction", F.coalesce(some(short), fallback).alias("context"), "response", F.coalesce(some(own(F.col("r.metadata.source"))), fallback).alias("source"), F.coalesce(some(own(F.col("r.metadata.topic"))), F.col("s_topic"), F.lit("General")).alias("topic"), F.coalesce(some(own(F.col("r.metadata.difficulty"))), F.lit("Intermediate")).alias("difficulty"))


def record_metadata(records: DataFrame, requests: DataFrame, headers: DataFrame) -> DataFrame:
    """doc_id, chapter, chapter_title, total_records, target_total, type, model_used, model_version of every document
    that has records.

    headers: doc_id, chapter (0 counts as none), chapter_title, model_used, model_version, one row for each document.
    """
    counted = records.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_records"))
    asked = requests.select(F.col("doc_id").alias("a_doc"), F.col("target").alias("target_total"))
    named = headers.select(F.col("doc_id").alias("h_doc"), F.nullif("chapter", F.lit(0)).alias("chapter"), "chapter_title", "model_used", "model_version")
    rows = counted.join(asked, F.col("doc_id") == F.col("a_doc"), "left").join(named, F.col("doc_id") == F.col("h_doc"), "left")
    title = F.coalesce(F.nullif("chapter_title", F.lit("")), F.lit("Unknown"))
    return rows.select("doc_id", "chapter", title.alias("chapter_title"), "total_records", "target_total", F.lit("instruction-training-record").alias("type"), "model_used", "model_version")


def documents_without_records(requests: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id of the documents whose replies held no good record."""
    return requests.select("doc_id").join(records.select(F.col("doc_id").alias("r_doc")).distinct(), F.col("doc_id") == F.col("r_doc"), "left_anti")
