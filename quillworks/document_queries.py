"""Registered queries over names, types, titles and whole documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillworks import queries as base
from quillworks.operators import blueprint, documents, lines, measures, sections
from quillworks.plans import views, workloads
from quillworks.sources import io, runs

LINES = "CASE WHEN len({0}) > 0 AND {0}[len({0})] = '' THEN {0}[1:len({0}) - 1] ELSE {0} END"
#: Characters of the documents to a file of Markdown.
FILE_CHARS = 32_000_000
GLOSSARY_HEAD = "A-1\nA\nA-2\nB\nA-3\nC\nA-4\nA-5\n"


def document_types(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    d = F.col("doc_id")
    name = F.when(d % 7 == 0, F.concat(F.lit("GLOSSARY_"), "source")).otherwise(F.col("source"))
    kind = F.when(d % 5 == 0, "chapter").when(d % 5 == 1, " Glossary ").otherwise("auto")
    text = F.when(d % 11 == 2, F.concat(F.lit(GLOSSARY_HEAD), "text")).when(d % 13 == 3, F.concat("text", F.lit("\nsee the Glossary"))).otherwise(F.col("text"))
    rows = docs.select("doc_id", name.alias("source_name"), kind.alias("doc_type"), text.alias("text"))
    return sections.resolve_doc_type(rows).select("doc_id", "is_glossary")


DOCUMENT_TYPES_SQL = f"""WITH d AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'GLOSSARY_' || source ELSE source END AS name, doc_id % 5 AS m,
    string_split(CASE WHEN doc_id % 11 = 2 THEN '{GLOSSARY_HEAD.strip()}' || chr(10) || text WHEN doc_id % 13 = 3 THEN text || chr(10) || 'see the Glossary' ELSE text END, chr(10)) AS l FROM documents
), c AS (
  SELECT *, len(list_filter(l[1:2000], lambda x: regexp_full_match(trim(x), '[A-Z]-[0-9]{{1,3}}'))) AS marks, len(list_filter(l[1:2000], lambda x: regexp_full_match(trim(x), '\\p{{Lu}}'))) AS capitals FROM d
)
SELECT doc_id, CASE m WHEN 1 THEN true WHEN 0 THEN false
  ELSE contains(lower(coalesce(name, '')), 'glossary') OR len(list_filter(l[1:350], lambda x: contains(lower(x), 'glossary'))) > 0 OR (marks >= 5 AND capitals >= 3) END AS is_glossary FROM c"""


def heading_audit(spark, sf_dir):
    flagged = sections.flag_headings(base._marked(spark, sf_dir))
    return sections.heading_audit(flagged).withColumn("line_no", F.col("line_no").cast("long"))


def chapter_numbers(spark, sf_dir):
    d = F.col("doc_id")
    name = F.when(d % 4 == 0, F.concat(F.lit("in/7/"), "source", F.lit("_"), (d % 50).cast("string"), F.lit(".v2.pdf"))).when(d % 4 == 1, F.lit("no digits.pdf")).otherwise(F.concat(F.lit("c:\\x9\\"), d.cast("string"), F.lit("-2")))
    override = F.when(d % 6 == 0, (d % 3).cast("int"))
    return views.documents(spark, sf_dir).select("doc_id", documents.chapter_number_col(name, override).alias("chapter"))


CHAPTER_NUMBERS_SQL = """WITH n AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '_' || (doc_id % 50) || '.v2' WHEN 1 THEN 'no digits' ELSE doc_id || '-2' END AS stem, CASE WHEN doc_id % 6 = 0 THEN doc_id % 3 END AS o FROM documents
) SELECT doc_id, CAST(CASE WHEN o > 0 THEN o ELSE coalesce(TRY_CAST(regexp_extract(stem, '[0-9]+') AS INT), 0) END AS INT) AS chapter FROM n"""


def _headed(spark, sf_dir):
    """Sections of which one, at a place that differs by document, is titled as a chapter."""
    rows = base._sections(spark, sf_dir)
    named = F.concat(F.lit("chapter "), (F.col("doc_id") % 9).cast("string"), F.when(F.col("doc_id") % 4 == 0, ": ").otherwise(F.lit(" – ")), F.when(F.col("doc_id") % 8 == 1, "").otherwise(F.col("title")))
    title = F.when(F.col("no") == F.col("doc_id") % 6 + 1, named).otherwise(F.col("title"))
    return rows.withColumn("title", title).withColumn("seq", F.col("no") - 1)


def picked_titles(spark, sf_dir):
    return documents.pick_title(_headed(spark, sf_dir)).select("doc_id", "doc_title", F.col("body_from").cast("long").alias("body_from")).distinct()


HEADED_SQL = f"""{base.S}, headed AS (
  SELECT doc_id, no - 1 AS seq, CASE WHEN no = doc_id % 6 + 1 THEN 'chapter ' || (doc_id % 9) || CASE WHEN doc_id % 4 = 0 THEN ': ' ELSE ' – ' END || CASE WHEN doc_id % 8 = 1 THEN '' ELSE title END ELSE title END AS title FROM sections
), marked AS (
  SELECT *, min(CASE WHEN regexp_matches(title, '(?i)^Chapter\\s+[0-9]+') AND seq < 4 THEN seq END) OVER (PARTITION BY doc_id) AS m FROM headed
), picked AS (
  SELECT doc_id, m, arg_min(title, seq) FILTER (WHERE seq = coalesce(m, 0)) AS raw FROM marked GROUP BY doc_id, m
), bared AS (
  SELECT *, trim(regexp_replace(raw, '(?i)^Chapter\\s+[0-9]+[\\s:–\\-]+', '')) AS bare FROM picked
)"""


def _nested(spark, sf_dir):
    rows = base._titled(spark, sf_dir).withColumn("id_prefix", F.col("doc_id").cast("string"))
    return documents.nest_document(rows)


def nested_documents(spark, sf_dir):
    """Each document nested, written as text: one line of its sections' ids, titles, words and weights."""
    line = F.transform("sections", lambda s: F.concat_ws(":", s["id"], s["title"], s["wordCount"].cast("string"), F.round(s["sectionWeight"] * 100).cast("long").cast("string"), F.size(s["tags"]).cast("string")))
    return _nested(spark, sf_dir).select("doc_id", F.col("chapter").cast("long").alias("chapter"), "prefix", "title", "totalSections", "totalWords", F.array_join(line, "|").alias("sections"))


def document_warnings(spark, sf_dir):
    return documents.validate_documents(_nested(spark, sf_dir))


def document_shapes(spark, sf_dir):
    d, tail = F.col("doc_id"), F.col("doc_id").cast("string")
    body = F.when(d % 5 == 0, F.concat(F.lit('{"title": "t", "x": '), tail, F.lit("}"))).when(d % 5 == 1, "{}").when(d % 5 == 2, F.concat(F.lit("["), tail, F.lit("]"))).when(d % 5 == 3, F.concat(F.lit("text "), tail)).otherwise(F.concat(F.lit('{"other": '), tail, F.lit("}")))
    return documents.shape_problems(views.documents(spark, sf_dir).select("doc_id", body.alias("body"))).select("doc_id", "problem")


def _names(spark, sf_dir):
    d = F.col("doc_id")
    name = F.when(d % 3 == 0, F.concat(F.lit("Out\\"), "source", F.lit("_"), (d % 400).cast("string"), F.lit(".JSON"))).when(d % 3 == 1, F.concat(F.lit("a/"), F.upper("source"), F.lit("_"), (d % 400).cast("string"))).otherwise(F.lit(" "))
    return io.output_names(views.documents(spark, sf_dir).select("doc_id", name.alias("name")))


def output_names(spark, sf_dir):
    prefix = io.prefix_col(F.concat(F.lit("Chapter "), "file_name"))
    return _names(spark, sf_dir).select("doc_id", "file_name", prefix.alias("prefix"))


def name_collisions(spark, sf_dir):
    existing = views.documents(spark, sf_dir).where("doc_id % 50 = 7").select(F.concat("source", F.lit("_"), (F.col("doc_id") % 400).cast("string"), F.lit(".json")).alias("file_name"))
    return io.name_collisions(_names(spark, sf_dir), existing)


def skip_existing(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    wanted = docs.select("doc_id", F.concat(F.lit("Out/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    existing = docs.where("doc_id % 4 = 1").select(F.concat(F.lit("out\\"), F.upper("source"), F.lit("\\"), F.col("doc_id").cast("string")).alias("path"))
    return io.skip_existing(wanted, existing)


NAMES_SQL = """WITH names AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '_' || (doc_id % 400) || '.JSON' WHEN 1 THEN upper(source) || '_' || (doc_id % 400) || '.json' ELSE 'output.json' END AS file_name FROM documents
)"""


def with_status(spark, sf_dir):
    return documents.documents_with_status(views.dressed(spark, sf_dir), tasks=views.tasks(views.documents(spark, sf_dir)))


def token_totals(spark, sf_dir):
    return measures.token_totals(measures.token_estimate(measures.document_metrics(base._sections(spark, sf_dir))))


def fallback_summary(spark, sf_dir):
    rows = base._titled(spark, sf_dir).withColumn("doc_title", F.when(F.col("doc_id") % 4 > 0, F.col("doc_title")))
    return measures.fallback_summary(measures.document_summary(rows), measures.top_sections(rows))


FALLBACK_SQL = f"""{base.S}, tops AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(content) DESC, no) AS rank FROM sections
), s AS (
  SELECT doc_id, count(*) AS n, CAST(sum({base.CHARS}) AS BIGINT) AS c, {base.CHAPTER} AS ch, any_value(book_id) AS book,
    list('- ' || CASE WHEN title = '' THEN 'Untitled' ELSE title END || ' (' || id || ')' ORDER BY rank) FILTER (WHERE rank <= 8) AS keys FROM tops GROUP BY doc_id
)
SELECT doc_id, array_to_string(list_concat(['# Chapter Summary: ' || CASE WHEN doc_id % 4 > 0 THEN coalesce(book, 'Unknown') ELSE 'Unknown' END, '', '## Overview',
  'Chapter ' || coalesce(ch, '?') || ' contains ' || n || ' sections with ' || c || ' characters of extracted content.', '', '## Key Sections'], keys,
  ['', '## Metadata', '- Chapter: ' || coalesce(ch, 'n/a'), '- Sections: ' || n, '- Characters: ' || c, '- Model Used: deterministic']), chr(10)) || chr(10) AS markdown FROM s"""


def _glossary_sections(spark, sf_dir):
    """One section per document, its lines mixed with page marks, lone capitals and what tables leave."""
    k = F.col("line_no")
    extra = lambda on, text: F.when(on, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    rows = views.doc_lines(spark, sf_dir)
    made = F.concat(extra(k % 4 == 1, "Table columns: a | b"), extra(k % 4 == 1, "- a: x; b: y"), extra(k % 8 == 1, ""), extra(k % 8 == 1, "- c: x; d: y"), F.array("line"), extra(k % 4 == 2, "- e: x; f: y"), extra(k % 5 == 0, "A-3"), extra(k % 6 == 0, " B "))
    texts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", made.alias("l")))).alias("x"))
    return texts.select("doc_id", F.lit(0).alias("seq"), F.lit("G").alias("title"), F.array_join(F.flatten(F.col("x.l")), "\n").alias("content"))


def glossary_bodies(spark, sf_dir):
    return sections.clean_glossary(_glossary_sections(spark, sf_dir)).select("doc_id", "content")


GLOSSARY_SQL = f"""WITH {views.DOC_LINES_SQL}, dressed AS (
  SELECT doc_id, line_no AS k, list_concat(CASE WHEN line_no % 4 = 1 THEN ['Table columns: a | b', '- a: x; b: y'] ELSE [] END, CASE WHEN line_no % 8 = 1 THEN ['', '- c: x; d: y'] ELSE [] END, [line],
    CASE WHEN line_no % 4 = 2 THEN ['- e: x; f: y'] ELSE [] END, CASE WHEN line_no % 5 = 0 THEN ['A-3'] ELSE [] END, CASE WHEN line_no % 6 = 0 THEN [' B '] ELSE [] END) AS l FROM doc_lines
), single AS (
  SELECT doc_id, k * 100 + i AS k, l[i] AS line, trim(l[i]) AS own FROM (SELECT doc_id, k, l, unnest(range(1, len(l) + 1)) AS i FROM dressed)
), kinds AS (
  SELECT *, starts_with(own, 'Table columns:') OR own = 'Table rows:' AS head, starts_with(own, '- ') AND contains(own, ':') AND contains(own, ';') AS item FROM single
  WHERE NOT regexp_full_match(own, '[A-Z]-[0-9]{{1,3}}') AND NOT regexp_full_match(own, '\\p{{Lu}}')
), states AS (
  SELECT *, coalesce(last_value(CASE WHEN own = '' THEN NULL WHEN head THEN true WHEN NOT item THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k), false) AS skips FROM kinds
), kept AS (
  SELECT doc_id, string_agg(CASE WHEN own = '' THEN '' ELSE line END, chr(10) ORDER BY k) FILTER (WHERE NOT head AND NOT (item AND skips)) AS t FROM states GROUP BY doc_id
)
SELECT DISTINCT d.doc_id, trim(regexp_replace(coalesce(t, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS content FROM doc_lines d LEFT JOIN kept USING (doc_id)"""


def detected_sections(spark, sf_dir):
    """Sections of the dressed texts without captions and page numbers: headings, clusters, bodies, smoothing."""
    docs = lines.strip_artifacts(views.dressed_with_lines(spark, sf_dir)).withColumn("doc_type", F.lit("chapter"))
    found = sections.detect_sections(docs.select("doc_id", "source_name", "doc_type", "text").repartition(views.tasks(views.documents(spark, sf_dir)), "doc_id"))
    return found.select("doc_id", F.col("seq").cast("long").alias("seq"), "title", "content", "word_count")


#: The pieces of the core module's SQL put together: clusters go before bodies, and bodies are smoothed.
DETECTED_SQL = f"""{base.HEADINGS_SQL.replace("), merged AS (", "), all_merged AS (")}, gaps AS (
  SELECT *, CASE WHEN start_line - lag(end_line) OVER (PARTITION BY doc_id ORDER BY start_line) <= 8 THEN 0 ELSE 1 END AS g FROM all_merged
), clusters AS (
  SELECT *, sum(g) OVER (PARTITION BY doc_id ORDER BY start_line) AS cluster FROM gaps
), merged AS (
  SELECT doc_id, start_line, end_line, title FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, cluster) AS size FROM clusters) WHERE size < 6
){base.BODIES_SQL[len(base.HEADINGS_SQL):]}{base.SMOOTH_SQL[base.SMOOTH_SQL.index(", b AS ("):].replace("SELECT doc_id, no - 1 AS seq, title, content FROM sections", "SELECT doc_id, seq, title, content FROM bodies")}, sectioned AS (
  SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.part) - 1 AS seq, title, coalesce(t.t, '') AS content FROM texts t JOIN titles USING (doc_id, part)
  UNION ALL SELECT doc_id, 0, 'Content', trim(text, ' ' || chr(10) || chr(9)) FROM stripped WHERE doc_id NOT IN (SELECT doc_id FROM merged)
)
SELECT doc_id, seq, title, content, CAST(len({views.words_sql("content")}) AS BIGINT) AS word_count FROM sectioned"""

def made_outputs(spark, sf_dir):
    """All outputs, written and read back: how many rows of each a document has."""
    rows = base._titled(spark, sf_dir)
    builders = workloads.output_builders(rows, views.candidates(spark, sf_dir), base._record_replies(spark, sf_dir, rows), views.tasks(views.documents(spark, sf_dir)))
    made = runs.make_outputs(spark, builders, set(builders), runs.new_folder(spark, "outputs"))
    found = [made[n].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(n).alias("output"), "n") for n in sorted(made)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


MADE_SQL = f"""{base.RECORDS_SQL} SELECT doc_id, 'blueprint' AS output, count(*) AS n FROM sections GROUP BY doc_id UNION ALL SELECT doc_id, 'bank', count(*) FROM accepted GROUP BY doc_id
UNION ALL SELECT doc_id, 'pairs', 11 * count(*) FROM accepted GROUP BY doc_id UNION ALL SELECT doc_id, 'records', count(*) FROM records WHERE number <= target GROUP BY doc_id UNION ALL SELECT DISTINCT doc_id, 'summary', CAST(1 AS BIGINT) FROM sections"""


def written_documents(spark, sf_dir):
    """Nested documents written as JSON by book and read back: the rows of their sections."""
    path = runs.new_folder(spark, "documents")
    book = F.coalesce(F.upper("d_source"), F.lit("none"))
    of = views.documents(spark, sf_dir).select(F.col("doc_id").alias("d_doc"), F.col("source").alias("d_source"))
    docs = _nested(spark, sf_dir).join(of, F.col("doc_id") == F.col("d_doc")).withColumn("book_id", book).drop("doc_id", "d_doc", "d_source")
    io.write_documents(docs, path)
    rows = io.document_sections(io.read_documents(spark, path, many=True))
    return rows.select("chapter", "prefix", "doc_title", "no", "id", "title", F.length("content").alias("chars"), F.col("wordCount").alias("word_count"), F.col("sectionWeight").alias("section_weight"))


WRITTEN_SQL = f"""{base.S} SELECT CAST(CASE WHEN doc_id % 10 <> 3 THEN doc_id % 30 END AS INT) AS chapter, CAST(doc_id AS VARCHAR) AS prefix, book_id AS doc_title, no, id, title, CAST(length(content) AS INT) AS chars, CAST(word_count AS INT) AS word_count, section_weight FROM sections"""


def written_markdown(spark, sf_dir):
    """Nested documents written as Markdown, many to a file, and read back."""
    path = runs.new_folder(spark, "markdown")
    chars = views.documents(spark, sf_dir).agg(F.sum(F.length("text"))).first()[0] or 0
    io.write_markdown(_nested(spark, sf_dir), path, files=max(8, chars // FILE_CHARS))
    return io.read_markdown(spark, path).select("name", "markdown")


MARKDOWN_SQL = f"""{base.S}, doc AS (
  SELECT doc_id, coalesce({base.CHAPTER}, '?') AS ch, any_value(book_id) AS book, count(*) AS n,
    string_agg('## ' || id || ' - ' || title || chr(10) || chr(10) || CASE WHEN trim(content) = '' THEN '[No content extracted]' ELSE trim(content) END || chr(10), chr(10) ORDER BY no) AS body FROM sections GROUP BY doc_id
)
SELECT CAST(doc_id AS VARCHAR) AS name, rtrim('# Chapter ' || ch || ': ' || coalesce(book, 'Unknown') || chr(10) || chr(10) || '## Conversion Metadata' || chr(10) || '- Chapter Number: ' || ch || chr(10) || '- Section Count: ' || n || chr(10) || chr(10) || body, chr(10) || ' ') || chr(10) AS markdown FROM doc"""


def read_blueprints(spark, sf_dir):
    """Blueprints written as JSON, a third of them cut off or without a question bank, and read back with a flag."""
    path = runs.new_folder(spark, "blueprints")
    rows = blueprint.word_blueprint(base._sections(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", F.col("id").alias("sectionId"), F.col("questions").cast("int").alias("requiredQuestions")))).alias("s"))
    bank = F.struct(F.col("doc_id").cast("string").alias("chapterId"), F.transform("s", lambda s: s.dropFields("no")).alias("sectionBlueprints"))
    body = F.to_json(F.struct(bank.alias("questionBank")))
    cut = F.when(F.size("s") % 3 == 1, F.substring(body, 1, 20)).when(F.size("s") % 3 == 2, '{"other": 1}').otherwise(body)
    rows.select(cut.alias("value")).write.text(path)
    found = spark.read.schema(io.BLUEPRINT).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    made = io.flag_bad(found)
    return made.select("bad", F.col("questionBank.chapterId").alias("chapter_id"), F.aggregate(F.coalesce(F.col("questionBank.sectionBlueprints.requiredQuestions"), F.array().cast("array<int>")), F.lit(0), lambda n, x: n + x).cast("long").alias("questions"))


READ_SQL = f"""{base.WORD_BLUEPRINT_SQL}, b AS (SELECT doc_id, count(*) AS n, CAST(sum(questions) AS BIGINT) AS q FROM allotted GROUP BY doc_id)
SELECT n % 3 <> 0 AS bad, CASE WHEN n % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS chapter_id, CASE WHEN n % 3 = 0 THEN q ELSE 0 END AS questions FROM b"""

QUERIES = {
    "made_outputs": made_outputs,
    "written_documents": written_documents,
    "written_markdown": written_markdown,
    "read_blueprints": read_blueprints,
    "document_types": document_types,
    "heading_audit": heading_audit,
    "chapter_numbers": chapter_numbers,
    "picked_titles": picked_titles,
    "nested_documents": nested_documents,
    "document_warnings": document_warnings,
    "document_shapes": document_shapes,
    "output_names": output_names,
    "name_collisions": name_collisions,
    "skip_existing": skip_existing,
    "token_totals": token_totals,
    "fallback_summary": fallback_summary,
    "glossary_bodies": glossary_bodies,
    "detected_sections": detected_sections,
}
ORACLE_SQL = {
    "made_outputs": MADE_SQL,
    "written_documents": WRITTEN_SQL,
    "written_markdown": MARKDOWN_SQL,
    "read_blueprints": READ_SQL,
    "document_types": DOCUMENT_TYPES_SQL,
    "heading_audit": f"{base.HEADINGS_SQL} SELECT doc_id, line_no, own, NOT prev_blank AS no_blank_before FROM hh WHERE passes",
    "chapter_numbers": CHAPTER_NUMBERS_SQL,
    "picked_titles": f"{HEADED_SQL} SELECT doc_id, CASE WHEN m IS NULL THEN trim(raw) WHEN bare = '' THEN raw ELSE bare END AS doc_title, coalesce(m, 0) + 1 AS body_from FROM bared",
    "nested_documents": f"""{base.S} SELECT doc_id, any_value(CASE WHEN doc_id % 10 <> 3 THEN doc_id % 30 END) AS chapter, CAST(doc_id AS VARCHAR) AS prefix, any_value(book_id) AS title, count(*) AS totalSections, any_value(total_words) AS totalWords,
  string_agg(id || ':' || title || ':' || word_count || ':' || CAST(round(section_weight * 100) AS BIGINT) || ':0', '|' ORDER BY no) AS sections FROM sections GROUP BY doc_id""",
    "document_warnings": f"""{base.S}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sections)
SELECT doc_id, 'WARNING: Only 1 section detected. Expected at least 2.' AS warning FROM n WHERE n = 1
UNION ALL SELECT doc_id, 'WARNING: Section ''' || id || ' – ' || title || ''' is unusually short (' || length(content) || ' chars).' FROM n WHERE length(content) < 200""",
    "document_shapes": "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'empty object' WHEN 2 THEN 'not an object' WHEN 3 THEN 'not an object' WHEN 4 THEN 'no known field' END AS problem FROM documents",
    "output_names": f"{NAMES_SQL} SELECT doc_id, file_name, trim(regexp_replace(regexp_replace('Chapter ' || file_name, '(?i)chapter', '', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_') AS prefix FROM names",
    "name_collisions": f"""{NAMES_SQL}, own AS (SELECT lower(file_name) AS lower_name FROM names), there AS (SELECT DISTINCT lower(source || '_' || (doc_id % 400) || '.json') AS lower_name FROM documents WHERE doc_id % 50 = 7)
SELECT lower_name, 'repeated in the run' AS reason FROM own GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT lower_name, 'file exists' FROM own WHERE lower_name IN (SELECT lower_name FROM there)""",
    "skip_existing": "SELECT doc_id, 'Out/' || source || '/' || doc_id AS path FROM documents WHERE doc_id % 4 <> 1",
    "token_totals": f"""{base.METRICS_SQL} SELECT doc_id, scope, CAST(floor(sum(ci) / 4 + 0.5) AS BIGINT) AS tokens_in, CAST(floor(sum(co) / 4 + 0.5) AS BIGINT) AS tokens_out, CAST(floor((sum(ci) + sum(co)) / 4 + 0.5) AS BIGINT) AS tokens_total
FROM estimates, (VALUES ('all'), ('mandatory')) v(scope) WHERE scope = 'all' OR mandatory GROUP BY doc_id, scope""",
    "fallback_summary": FALLBACK_SQL,
    "glossary_bodies": GLOSSARY_SQL,
    "detected_sections": DETECTED_SQL,
}
