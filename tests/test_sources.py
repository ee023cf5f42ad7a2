"""Write and read back: corpora, documents, blueprints, Markdown, chosen outputs; whole documents with their status."""

import json
import os

import pytest
from pyspark.sql import functions as F
from quillworks import document_queries
from quillworks import queries as core
from quillworks.operators import documents, lines, measures, sections
from quillworks.plans import views, workloads
from quillworks.sources import io, runs

SECTION = {"id": "3.1", "title": "Slow", "content": "words here", "wordCount": 2, "sectionWeight": 100.0, "tags": []}
DOCUMENT = {"chapter": 3, "prefix": "AFH.3", "title": "Flight", "totalSections": 1, "totalWords": 2, "sections": [SECTION]}


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def test_corpus_and_documents(spark, tmp_path):
    put(f"{tmp_path}/c", "ch_1.txt", "one\n\ntwo")
    put(f"{tmp_path}/c", "ch_2.txt", "")
    got = {r.source_name.rsplit("/", 1)[1]: r.text for r in io.read_corpus(spark, f"{tmp_path}/c/*.txt").collect()}
    assert got == {"ch_1.txt": "one\n\ntwo"}
    put(f"{tmp_path}/d", "a.json", json.dumps(DOCUMENT, indent=1))
    put(f"{tmp_path}/d", "b.json", json.dumps(DOCUMENT | {"title": "Empty", "sections": []}))
    put(f"{tmp_path}/d", "c.json", "{ no JSON")
    docs = io.read_documents(spark, f"{tmp_path}/d").cache()
    assert docs.where("_corrupt_record is not null").count() == 1
    rows = {r.doc_title: r for r in io.document_sections(docs.where("title is not null")).collect()}
    assert (rows["Flight"].no, rows["Flight"].id, rows["Flight"].wordCount) == (1, "3.1", 2)
    assert rows["Empty"].no is None and rows["Empty"].content is None


def test_documents_round_trip(spark, tmp_path):
    put(f"{tmp_path}/d", "a.json", json.dumps(DOCUMENT))
    docs = io.read_documents(spark, f"{tmp_path}/d").drop("_corrupt_record").withColumn("book_id", F.lit("AFH"))
    io.write_documents(docs, f"{tmp_path}/out")
    again = io.read_documents(spark, f"{tmp_path}/out/book_id=AFH").drop("_corrupt_record")
    assert again.collect() == docs.drop("book_id").collect()
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_documents(docs, f"{tmp_path}/out")


def test_blueprints_flag_bad_files(spark, tmp_path):
    put(f"{tmp_path}/b", "a.json", json.dumps({"questionBank": {"bookId": "AFH", "sectionBlueprints": [{"sectionId": "AFH.3.1", "requiredQuestions": 2}]}}))
    put(f"{tmp_path}/b", "b.json", "not JSON at all")
    put(f"{tmp_path}/b", "c.json", '{"other": 1}')
    rows = io.read_blueprints(spark, f"{tmp_path}/b").cache()
    assert sorted(r.bad for r in rows.collect()) == [False, True, True]
    assert rows.where("not bad").first().questionBank.sectionBlueprints[0].sectionId == "AFH.3.1"


def files_of(folder):
    return [f"{d}/{f}" for d, _, names in os.walk(folder) for f in names if not f.startswith(("_", "."))]


def test_markdown(spark, tmp_path):
    put(f"{tmp_path}/d", "a.json", json.dumps(DOCUMENT | {"sections": [SECTION, SECTION | {"id": "3.2", "content": " "}]}))
    docs = io.read_documents(spark, f"{tmp_path}/d").withColumn("doc_id", F.lit(1))
    io.write_markdown(docs, f"{tmp_path}/md")
    (row,) = io.read_markdown(spark, f"{tmp_path}/md").collect()
    assert row.name == "1" and row.markdown.split("\n")[:5] == ["# Chapter 3: Flight", "", "## Conversion Metadata", "- Chapter Number: 3", "- Section Count: 2"]
    assert "## 3.1 - Slow\n\nwords here\n\n## 3.2 - Slow\n\n[No content extracted]" in row.markdown
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_markdown(docs, f"{tmp_path}/md")


def test_files_are_bounded(spark, tmp_path):
    """Hundreds of documents of two books from many tasks, among them odd texts: few files, and all come back."""
    rows = [(k, None if k % 97 == 0 else f"T\n{k}", "big" if k % 5 else "small", ["a\n\nb", "<!-- file: x -->\n", "\x1e", "", "é\r\nü "][k % 5]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, book_id string, content string").repartition(16)
    section = F.struct(F.lit("1.1").alias("id"), F.col("title").alias("title"), "content", F.lit(1).alias("wordCount"), F.lit(100.0).alias("sectionWeight"), F.array().cast("array<string>").alias("tags"))
    docs = docs.select("doc_id", "book_id", F.lit(1).alias("chapter"), F.col("doc_id").cast("string").alias("prefix"), "title", F.lit(1).alias("totalSections"), F.lit(1).alias("totalWords"), F.array(section).alias("sections"))
    io.write_documents(docs.drop("doc_id"), f"{tmp_path}/json", files=3)
    assert 2 <= len(files_of(f"{tmp_path}/json")) <= 6
    lines_of = io.read_documents(spark, f"{tmp_path}/json", many=True).drop("_corrupt_record")
    assert sorted(map(repr, lines_of.collect())) == sorted(map(repr, docs.select(*lines_of.columns).collect()))
    io.write_markdown(docs, f"{tmp_path}/md", files=4)
    assert len(files_of(f"{tmp_path}/md/documents")) <= 4 and len(files_of(f"{tmp_path}/md/index")) == 1
    want = {str(r.doc_id): r.m.replace("\x1e", io.RECORD_SIGN) for r in docs.select("doc_id", io.markdown_col(F.col("chapter"), F.col("title"), F.col("sections")).alias("m")).collect()}
    assert {r.name: r.markdown for r in io.read_markdown(spark, f"{tmp_path}/md").collect()} == want
    some = io.read_markdown(spark, f"{tmp_path}/md", ["7", "nowhere"])
    assert [(r.name, r.markdown) for r in some.collect()] == [("7", want["7"])]
    assert {r.name: r.n_chars for r in spark.read.parquet(f"{tmp_path}/md/index").collect()} == {k: len(v) for k, v in want.items()}


def test_outputs_come_from_stored_predecessors(spark, tmp_path):
    """The bank is computed once for bank, pairs and records; what is there is not made again."""
    path, calls, read = f"file://{tmp_path}/o", [], {}

    def builder(name):
        def make(made):
            calls.append(name)
            read.update({name: {n: d.inputFiles() for n, d in made.items()}})
            return spark.range(3).withColumn("x", F.lit(name))

        return make

    builders = {n: builder(n) for n in io.NEEDS}
    made = runs.make_outputs(spark, builders, {"records", "bank"}, path)
    assert calls == ["bank", "pairs", "records"] and list(made) == calls
    assert all(f.startswith(f"{path}/bank/") for n in ("pairs", "records") for f in read[n]["bank"]) and set(read["records"]) == {"bank", "pairs"}
    assert runs.make_outputs(spark, builders, {"records", "summary"}, path)["pairs"].first().x == "pairs"
    assert calls == ["bank", "pairs", "records", "summary"]
    os.remove(f"{tmp_path}/o/pairs/_SUCCESS")  # a run was lost while it wrote
    runs.make_outputs(spark, builders, {"records"}, path)
    assert calls[4:] == ["pairs"]
    runs.make_outputs(spark, builders, {"pairs"}, path, overwrite=True)
    assert calls[5:] == ["bank", "pairs"]


def test_handbook_outputs(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = core._titled(spark, sf)
    builders = workloads.output_builders(rows, views.candidates(spark, sf), core._record_replies(spark, sf, rows))
    made = runs.make_outputs(spark, builders, {"records"}, f"file://{tmp_path}/o")
    assert list(made) == ["bank", "pairs", "records"]
    assert made["pairs"].count() == 11 * made["bank"].count()
    assert all("/o/bank/" in f for f in builders["pairs"](made).inputFiles())


DOCS = "doc_id long, source_name string, doc_type string, chapter_override int, prefix string, text string"


def test_status_of_every_row(spark):
    body = "\n".join(["Chapter 4: Slow Flight", "", "lead", "", "ENGINE STALLS", "", "x " * 150, "", "WING STALLS", "", "y " * 150])
    rows = [(1, "ch_4.pdf", "auto", None, "", body), (1, "ch_4.pdf", "auto", None, "", body), (None, "b", "auto", 7, "", body), (2, None, None, None, None, None), (3, "x", "auto", None, "", "no heading in here.")]
    got = documents.documents_with_status(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.status, r.totalSections or 0) for r in got) == [("1", "done", 1), ("1", "done", 1), ("2", "empty", 0), ("3", "untitled", 0), ("None", "done", 1)]
    assert {r.chapter for r in got if r.status == "done"} == {4, 7}


def folds_unless_bad(given):
    if any("BREAKS" in x for x in given):
        raise ValueError("cannot fold this")
    return lines.join_wrapped(given)


def test_failures_stop_nothing_and_are_redone(spark, tmp_path):
    body = "\n".join(["Chapter 4: Slow Flight", "", "lead", "", "ENGINE STALLS", "", "x " * 150, "", "WING STALLS", "", "y " * 150])
    rows = [(k, "ch_4.pdf", "auto", None, "", body.replace("lead", "it BREAKS") if k % 4 == 1 else body) for k in range(12)] + [(None, "b", "auto", None, "", body), (99, "e", "auto", None, "", "")]
    docs, path = spark.createDataFrame(rows, DOCS), f"file://{tmp_path}/runs"
    first = runs.run_documents(docs, path, folds_unless_bad).collect()
    assert len(first) == 14
    for r in first:
        bad = r.doc_id is not None and r.doc_id % 4 == 1
        assert (r.status, r.reason) == (("failed", "ValueError: cannot fold this") if bad else ("empty" if r.doc_id == 99 else "done", None))
        assert (r.sections is None) == (r.status != "done") and r.run == 0
    more = docs.unionByName(spark.createDataFrame([(200, "n", "auto", None, "", body)], DOCS))
    second = runs.run_documents(more, path).collect()
    assert len(second) == 15 and {r.doc_id for r in second if r.run == 1} == {1, 5, 9, 200}
    assert {r.status for r in second} == {"done", "empty"}
    assert {r.doc_id: r.run for r in runs.run_documents(more, path).collect()} == {r.doc_id: r.run for r in second}


def test_status_in_one_job(spark):
    """One scan, one exchange for the documents and one for their sections, no join back."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = documents.documents_with_status(views.dressed(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange ") <= 3 and "Join" not in text and text.count("FileScan") == 1 and "BatchEvalPython" not in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_extra_columns_go_along_unread(spark):
    rows = spark.createDataFrame([(1, "a\nb", "kept", {"k": 1})], "doc_id long, text string, own_id string, m map<string,int>")
    rows = rows.withColumns({c: F.lit(c) for c in ("given", "lines", "block", "own_line", "line")})
    (row,) = lines.clean_text(rows).collect()
    assert row.asDict() == {"doc_id": 1, "own_id": "kept", "m": {"k": 1}, "text": "a b"} | {c: c for c in ("given", "lines", "block", "own_line", "line")}


def test_clean_text_keeps_rows_apart(spark):
    rows = spark.createDataFrame([(None, "a\nb"), (None, None), (5, "one\n\n\n\ntwo"), (5, "Item  Speed\nx  1\ny  2"), (6, "photo")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in lines.clean_text(rows).collect())
    table = "Table columns: Item | Speed\n- Item: x; Speed: 1\n- Item: y; Speed: 2"
    assert got == [("5", table), ("5", "one\n\ntwo"), ("6", ""), ("None", ""), ("None", "a b")]


def test_one_exchange_for_documents(spark):
    docs = spark.createDataFrame([(1, "ch_4.pdf", "auto", None, "", "x")], DOCS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = documents.process_documents(docs)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange ") <= 2 and "Join" not in text and "BatchEvalPython" not in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_outline_is_the_same_as_its_parts(spark):
    import random

    rng = random.Random(9)
    words = ["Slow Flight", "plain words go on here", "", "", "Chapter 2 Stalls", "ENGINE", "and more text.", "The End of It"]
    docs = [(k, "\n".join(rng.choice(words) for _ in range(rng.randint(0, 40))), "f", "chapter") for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source_name string, doc_type string").repartition("doc_id")
    flagged = sections.flag_headings(lines.explode_lines(df.select("doc_id", "text")).withColumn("is_glossary", F.lit(False)))
    headings = sections.drop_heading_clusters(sections.merge_headings(flagged))
    parts = sections.smooth_sections(sections.assign_sections(flagged.select("doc_id", "line_no", "line"), headings))
    want = {tuple(r) for r in parts.select("doc_id", "seq", "title", "content").collect()}
    got = {(r.doc_id, r.seq, r.title, r.content) for r in sections.detect_sections(df).collect()}
    bare = {r[0] for r in got} - {r[0] for r in want}
    assert {r for r in got if r[0] not in bare} == want
    assert all((k, 0, "Content", t.strip()) in got for k, t, *_ in docs if k in bare)


def test_summary_without_sections(spark):
    rows = spark.createDataFrame([(1, 0, "T", None, None, None)], "doc_id long, chapter int, doc_title string, no long, title string, content string")
    text = measures.detailed_summary(rows).first().markdown
    assert "Chapter 0 covers 0 sections" in text and measures.NO_OBJECTIVE in text and measures.NO_TERM in text
    total = measures.document_summary(rows).first()
    assert (total.section_count, total.total_chars) == (0, 0)


def test_markdown_is_dealt_by_size(spark, monkeypatch):
    """Files grow in number with the texts, and no single task reads all of them for the index."""
    seen = []
    write = io.write_markdown
    monkeypatch.setattr(document_queries, "FILE_CHARS", 20_000)
    monkeypatch.setattr(io, "write_markdown", lambda *given, **named: (seen.append(named["files"]), write(*given, **named)))
    monkeypatch.setattr(type(spark.range(1)), "coalesce", None)
    assert document_queries.written_markdown(spark, "/root/testdata/sf0.001").count() > 0 and seen[0] > 8
