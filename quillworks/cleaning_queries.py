"""Registered queries over wrapped lines, tables and whole cleaning, and their SQL.

The fold of wrapped lines depends on the length that a line has reached, so its SQL is a recursion that reads line after
line. Rewritten tables are lists of lists in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillworks import document_queries
from quillworks import queries as base
from quillworks.functions.textops import words_col
from quillworks.operators import lines, sections
from quillworks.plans import views
from quillworks.sources import io

WIDTH = 7


def _some(condition, *texts):
    return F.when(condition, F.array(*texts)).otherwise(F.array().cast("array<string>"))


def _wrapped(spark, sf_dir):
    """Every text anew in lines of seven words, among them broken words, bullets, table rows, chapter lines and blanks."""
    words = views.documents(spark, sf_dir).select("doc_id", words_col(F.col("text")).alias("w")).where(F.size("w") > 0)

    def made(at):
        line, j = F.array_join(F.slice("w", at * WIDTH + 1, WIDTH), " "), at + F.col("doc_id") % 5
        line = F.when(j % 9 == 4, F.concat(line, F.lit("-"))).when(j % 11 == 5, F.concat(F.lit("- "), line)).when(j % 13 == 6, F.concat(F.get("w", 0), F.lit("  "), line)).when(j % 29 == 7, F.concat(F.lit("Chapter 4 "), line)).otherwise(line)
        return F.concat(F.array(line), _some(j % 17 == 8, F.lit("")), _some(j % 23 == 9, F.lit("word("), F.concat(F.lit("Upper "), F.get("w", 0))))

    # no row for each line: it would hold all words of its text
    places = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / WIDTH).cast("int"))
    return words.select("doc_id", F.flatten(F.transform(places, made)).alias("l"))


def wrapped_lines(spark, sf_dir):
    """The lines of each document after rejoining."""
    folded = lines.joined_lines_col(F.col("l"))["lines"]
    return _wrapped(spark, sf_dir).select("doc_id", F.array_join(folded, "\n").alias("text"))


def _tabled(spark, sf_dir):
    """The lines of all documents with tables among them: with a header, of numbers, uneven, with blanks inside, bulleted."""
    rows = views.doc_lines(spark, sf_dir)
    n, two = F.col("line_no").cast("string"), F.array_join(F.slice(words_col(F.col("line")), 1, 2), " ")
    kind = (F.col("doc_id") + F.col("line_no")) % 7
    header = (F.lit("Name:  Top Speed  Note"), F.concat(F.lit("one  "), n, F.lit("  "), two), F.lit("two  2\tx"), F.lit("three  3  y  z"), F.lit(""))
    numbers = (F.concat(F.lit("7  "), n), F.lit("8   9"), F.lit(""), F.lit("10  11  12"))
    uneven = (F.lit("A  B  C  D  E"), F.lit("a  b"), F.lit("c  d  e  f  g  h  i"), F.concat(F.lit("p  "), n, F.lit("  r  s")))
    bullets = (F.lit("- x  y"), F.lit("1. x  y"), F.lit("b) x  y"), F.lit("* x  y"))
    made = F.concat(F.array("line"), _some(kind == 1, *header), _some(kind == 2, *numbers), _some(kind == 3, *uneven), _some(kind == 4, *bullets), _some(kind == 5, F.lit("u  v"), F.lit("w  x")))
    spread = rows.select("doc_id", F.col("line_no").alias("at"), F.posexplode(made).alias("sub", "line"))
    return spread.select("doc_id", (F.col("at") * 10 + F.col("sub")).alias("line_no"), "line")


def rewritten_tables(spark, sf_dir):
    """The lines of each document after its tables are rewritten, numbered anew."""
    return lines.rewrite_tables(_tabled(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def bullet_lines(spark, sf_dir):
    """How many bullets and table rows each document has."""
    rows = _tabled(spark, sf_dir)
    bullet = F.count(F.when(F.col("line").rlike(lines.BULLET), 1))
    return rows.groupBy("doc_id").agg(bullet.alias("n_bullets"), F.count(F.when(lines.table_row_col(F.col("line")), 1)).alias("n_rows"))


def _glossary_texts(spark, sf_dir):
    """Texts as glossaries: terms in capitals under letters that fit the next term, or do not, page marks and tables."""
    rows = views.doc_lines(spark, sf_dir)
    k = F.col("line_no")
    term = F.upper(F.translate(F.regexp_replace(F.array_join(F.slice(words_col(F.col("line")), 1, 3), " "), "[.:,]", ""), "ß", "ẞ"))
    letter = F.when(k % 3 == 0, F.substring(term, 1, 1)).otherwise("Z")
    ks = k.cast("string")
    made = F.concat(
        _some(k % 3 < 2, F.lit(""), letter), _some(k % 4 == 0, F.lit("")), F.array(F.lit(""), term, F.lit(""), F.col("line")), _some(k % 2 == 0, F.concat(F.lit("G-"), (k % 500).cast("string"))),
        _some(k % 5 == 1, F.lit("Table columns: a | b"), F.concat(F.lit("- a: "), ks, F.lit("; b: y")), F.lit("")), _some(k % 7 == 2, F.lit("- c: x; d: y")), _some(k % 6 == 3, F.lit(" B ")),
        *[F.array(F.concat(F.lit(f"more about it {j} at "), ks)) for j in range(9)],
    )
    return rows.groupBy("doc_id").agg(F.array_join(F.flatten(F.array_sort(F.collect_list(F.struct("line_no", made.alias("l"))))["l"]), "\n").alias("text"))


def detected_glossary(spark, sf_dir):
    """The sections of glossaries: letters and page marks, terms, and bodies without what tables have left."""
    docs = _glossary_texts(spark, sf_dir).select("doc_id", F.lit("f").alias("source_name"), F.lit("glossary").alias("doc_type"), "text")
    found = sections.detect_sections(docs.repartition("doc_id"))
    return found.select("doc_id", F.col("seq").cast("long").alias("seq"), "title", "content", "word_count")


def glossary_dividers(spark, sf_dir):
    """How many lone letters of each glossary count as headings, and how many do not."""
    rows = lines.explode_lines(_glossary_texts(spark, sf_dir)).repartition("doc_id").withColumn("is_glossary", F.lit(True))
    flagged = sections.flag_headings(rows).where(F.col("own").rlike(sections.LONE_CAPITAL))
    return flagged.groupBy("doc_id").agg(F.count(F.when(F.col("is_heading"), 1)).alias("n_kept"), F.count(F.when(~F.col("is_heading"), 1)).alias("n_dropped"))


def document_status(spark, sf_dir):
    """Whole documents in one job: status, sections, words and warnings of each."""
    rows = document_queries.with_status(spark, sf_dir)
    return rows.select("doc_id", "status", F.coalesce("totalSections", F.lit(0)).cast("long").alias("n_sections"), F.coalesce("totalWords", F.lit(0)).cast("long").alias("n_words"), F.greatest(F.size("warnings"), F.lit(0)).cast("long").alias("n_warnings"))


def status_tally(spark, sf_dir):
    return io.status_tally(document_queries.with_status(spark, sf_dir))


BULLET = "'^\\s*([-*•]|[0-9]+[.)]|[A-Za-z][.)])\\s+'"
CELLS = "list_filter(list_transform(string_split_regex(trim({0}), '\\t+| {{2,}}'), lambda c: trim(c)), lambda c: c <> '')"
IS_ROW = f"(len({CELLS}) >= 2 AND NOT regexp_matches(trim({{0}}), {BULLET}))"
ONE_LINE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
SPACE = "' ' || chr(10) || chr(9)"


def tables_sql(source: str) -> str:
    """CTEs from relation `source` (doc_id, line_no, line) to `rewritten` (doc_id, line_no, line, numbered anew from 0)."""
    return f"""placed AS (
  SELECT doc_id, line, {CELLS.format("line")} AS cells, {IS_ROW.format("line")} AS is_row, trim(line) = '' AS blank, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM {source}
), gapped AS (
  SELECT *, place - max(CASE WHEN is_row THEN place END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, lag(blank) OVER (PARTITION BY doc_id ORDER BY place) AS blank_before FROM placed
), begun AS (
  SELECT *, sum(CASE WHEN is_row AND NOT coalesce(gap = 1 OR (gap = 2 AND blank_before), false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM gapped
), measured AS (
  SELECT *, count(*) FILTER (WHERE is_row) OVER (PARTITION BY doc_id, run) AS n_rows, max(CASE WHEN is_row THEN place END) OVER (PARTITION BY doc_id, run) AS last_row, min(CASE WHEN is_row THEN place END) OVER (PARTITION BY doc_id, run) AS first_row FROM begun
), blocks AS (
  SELECT doc_id, run, any_value(first_row) AS place, list(cells ORDER BY place) AS c, list(line ORDER BY place) AS raw FROM measured WHERE run > 0 AND n_rows >= 3 AND is_row GROUP BY doc_id, run
), usual AS (
  SELECT doc_id, run, arg_max(size, (n, -size)) AS usual FROM (SELECT doc_id, run, len(x) AS size, count(*) AS n FROM (SELECT doc_id, run, unnest(c) AS x FROM blocks) GROUP BY 1, 2, 3) GROUP BY 1, 2
), judged AS (
  SELECT b.*, len(list_filter(c, lambda r: abs(len(r) - usual) <= 1)) >= greatest(3, floor(len(c) * 0.6)) AS even,
    len(list_filter(c[1], lambda x: regexp_matches(x, '\\p{{Nd}}'))) = 0 AND len(list_filter(c[1], lambda x: regexp_matches(x, '\\p{{L}}'))) >= greatest(2, len(c[1]) - 1) AS headed,
    list_transform(c[1], lambda x, k: CASE WHEN regexp_replace({ONE_LINE.format("x")}, ':+$', '') = '' THEN 'col_' || k ELSE regexp_replace({ONE_LINE.format("x")}, ':+$', '') END) AS names FROM blocks b JOIN usual u ON b.doc_id = u.doc_id AND b.run = u.run
), told AS (
  SELECT doc_id, place, list_append(CASE WHEN NOT even THEN raw
    WHEN headed THEN list_concat(['Table columns: ' || array_to_string(names, ' | ')], list_transform(c[2:], lambda r: '- ' || array_to_string(list_transform(r, lambda x, k: coalesce(names[k], 'col_' || k) || ': ' || {ONE_LINE.format("x")}), '; ')))
    ELSE list_concat(['Table rows:'], list_transform(c, lambda r: '- ' || array_to_string(list_transform(r, lambda x: {ONE_LINE.format("x")}), ' | '))) END, '') AS l FROM judged
), outside AS (
  SELECT doc_id, place, [line] AS l FROM measured WHERE NOT (run > 0 AND n_rows >= 3 AND (place <= last_row OR (blank AND place = last_row + 1)))
), pieces AS (
  SELECT doc_id, place, l, unnest(range(1, len(l) + 1)) AS sub FROM (SELECT * FROM told UNION ALL SELECT * FROM outside)
), rewritten AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, sub) - 1 AS line_no, l[sub] AS line FROM pieces
)"""


def fold_sql(source: str) -> str:
    """CTEs from relation `source` (doc_id, line_no from 0 without gaps, line) to `joined` (doc_id, text): the recursion
    holds the open line, and gives out what is finished."""
    apart = lambda x: f"(regexp_matches({x}, {BULLET}) OR regexp_matches({x}, '(?i)^Chapter\\s+[0-9]+') OR len({CELLS.format(x)}) >= 2)"
    return f"""folding AS MATERIALIZED (
  SELECT doc_id, line_no AS k, own, {apart("own")} AS apart FROM (SELECT doc_id, line_no, trim(line) AS own FROM {source})
), steps AS (
  SELECT doc_id, CAST(-1 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS given, CAST(NULL AS VARCHAR) AS open FROM (SELECT DISTINCT doc_id FROM folding)
  UNION ALL
  SELECT doc_id, k, CASE WHEN act = 'blank' THEN CASE WHEN open IS NULL THEN [''] ELSE [open, ''] END WHEN act = 'new' AND open IS NOT NULL THEN [open] ELSE [] END AS given,
    CASE act WHEN 'blank' THEN NULL WHEN 'new' THEN own WHEN 'broken' THEN open[1:len(open) - 1] || own ELSE open || ' ' || own END AS open
  FROM (
    SELECT f.doc_id, f.k, f.own, s.open, CASE WHEN f.own = '' THEN 'blank' WHEN s.open IS NULL OR f.apart OR {apart("s.open")} THEN 'new' WHEN ends_with(s.open, '-') AND regexp_matches(f.own, '^[\\p{{L}}\\p{{N}}]') THEN 'broken'
      WHEN NOT regexp_matches(s.open, '[.!?:;]$') AND (regexp_matches(f.own, '^\\p{{Ll}}') OR regexp_matches(s.open, '[,(/]$') OR length(s.open) >= 60) THEN 'joined' ELSE 'new' END AS act
    FROM steps s JOIN folding f ON f.doc_id = s.doc_id AND f.k = s.k + 1)
), given_lines AS (
  SELECT doc_id, k, i, {ONE_LINE.format("given[i]")} AS line FROM (SELECT *, unnest(range(1, len(given) + 1)) AS i FROM steps)
  UNION ALL SELECT doc_id, k + 1, 0, {ONE_LINE.format("open")} FROM (SELECT doc_id, max(k) AS k, arg_max(coalesce(open, chr(0)), k) AS open FROM steps GROUP BY doc_id) WHERE open <> chr(0)
), joined AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY k, i) AS text FROM given_lines GROUP BY doc_id
)"""


WRAPPED_SQL = f"""WITH RECURSIVE words AS (
  SELECT doc_id, {views.words_sql("text")} AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / {WIDTH}.0) AS BIGINT))) AS j FROM words WHERE len(w) > 0
), cut AS (
  SELECT doc_id, w, j, j + doc_id % 5 AS m, array_to_string(w[j * {WIDTH} + 1 : (j + 1) * {WIDTH}], ' ') AS line FROM places
), made AS (
  SELECT doc_id, j, list_concat([CASE WHEN m % 9 = 4 THEN line || '-' WHEN m % 11 = 5 THEN '- ' || line WHEN m % 13 = 6 THEN w[1] || '  ' || line WHEN m % 29 = 7 THEN 'Chapter 4 ' || line ELSE line END],
    CASE WHEN m % 17 = 8 THEN [''] ELSE [] END, CASE WHEN m % 23 = 9 THEN ['word(', 'Upper ' || w[1]] ELSE [] END) AS l FROM cut
), spread AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j, i) - 1 AS line_no, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM made)
), {fold_sql("spread")} SELECT doc_id, text FROM joined"""

TABLED_SQL = f"""WITH {views.DOC_LINES_SQL}, tabled_lists AS (
  SELECT doc_id, line_no, list_concat([line], CASE kind WHEN 1 THEN ['Name:  Top Speed  Note', 'one  ' || line_no || '  ' || two, 'two  2' || chr(9) || 'x', 'three  3  y  z', ''] WHEN 2 THEN ['7  ' || line_no, '8   9', '', '10  11  12']
    WHEN 3 THEN ['A  B  C  D  E', 'a  b', 'c  d  e  f  g  h  i', 'p  ' || line_no || '  r  s'] WHEN 4 THEN ['- x  y', '1. x  y', 'b) x  y', '* x  y'] WHEN 5 THEN ['u  v', 'w  x'] ELSE [] END) AS l
  FROM (SELECT doc_id, line_no, line, (doc_id + line_no) % 7 AS kind, array_to_string(({views.words_sql("line")})[1:2], ' ') AS two FROM doc_lines)
), tabled AS (
  SELECT doc_id, line_no * 10 + i - 1 AS line_no, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM tabled_lists)
)"""

IMAGE_LINE = "own <> '' AND (regexp_matches(own, '(?i)^(image|photo|illustration|diagram|graphic)$') OR regexp_matches(own, '^[\\s_\\-=.|/\\\\<>\\[\\]()~`•·:]{4,}$') OR (length(regexp_replace(own, '[^\\p{L}]', '', 'g')) <= 2 AND length(regexp_replace(own, '[^_|\\-=./\\\\<>\\[\\]()~`•·:]', '', 'g')) >= greatest(4, length(own) // 2)))"
CLEANED_SQL = f"""WITH RECURSIVE {base.STRIPPED_SQL.removeprefix("WITH ")}, raw AS (
  SELECT doc_id, k - 1 AS line_no, l[k] AS line, trim(l[k]) AS own FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, list_prepend('', string_split(coalesce(text, ''), chr(10))) AS l FROM stripped))
), kept AS (
  SELECT doc_id, line_no, line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, own) AS n FROM raw) WHERE (own = '' OR n < 3 OR length(own) >= 120) AND NOT ({IMAGE_LINE})
), {tables_sql("kept")}, {fold_sql("rewritten")}, cleaned AS (
  SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), {SPACE}) AS text FROM (SELECT doc_id FROM documents) LEFT JOIN joined USING (doc_id)
)"""

#: Sections of the cleaned texts: the SQL of detection reads another relation.
_DETECT = document_queries.DETECTED_SQL[len(base.STRIPPED_SQL) :].replace("FROM stripped", "FROM cleaned")
PROCESSED_SQL = f"""{CLEANED_SQL}{_DETECT[: _DETECT.rindex(chr(10) + "SELECT")]}, every_section AS (
  SELECT doc_id, seq, title, content, CAST(len({views.words_sql("content")}) AS BIGINT) AS word_count FROM sectioned
), chaptered AS (
  SELECT *, min(CASE WHEN regexp_matches(title, '(?i)^Chapter\\s+[0-9]+') AND seq < 4 THEN seq END) OVER (PARTITION BY doc_id) AS m FROM every_section
), picked AS (
  SELECT *, max(CASE WHEN seq = coalesce(m, 0) THEN title END) OVER (PARTITION BY doc_id) AS raw FROM chaptered
), bared AS (
  SELECT *, {ONE_LINE.format("regexp_replace(raw, '(?i)^Chapter\\s+[0-9]+[\\s:–\\-]+', '')")} AS bare FROM picked
), weighed AS (
  SELECT b.doc_id, seq, b.title, b.content, b.word_count, row_number() OVER o AS no, CAST(sum(word_count) OVER (PARTITION BY b.doc_id) AS BIGINT) AS total_words,
    CASE WHEN m IS NULL THEN {ONE_LINE.format("raw")} WHEN bare = '' THEN raw ELSE bare END AS doc_title, d.source, coalesce(TRY_CAST(regexp_extract(d.source || '_' || (d.doc_id % 20), '[0-9]+') AS INT), 0) AS chapter
  FROM bared b JOIN documents d ON d.doc_id = b.doc_id WHERE seq >= coalesce(m, 0) + 1 WINDOW o AS (PARTITION BY b.doc_id ORDER BY seq)
)"""
STATUS_SQL = f"""{PROCESSED_SQL}, counted_sections AS (
  SELECT doc_id, count(*) AS n_sections, CAST(sum(word_count) AS BIGINT) AS n_words, count(*) FILTER (WHERE length(content) < 200) + CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS n_warnings FROM weighed GROUP BY doc_id
), statuses AS (
  SELECT d.doc_id, CASE WHEN trim(coalesce(t.text, ''), {SPACE}) = '' THEN 'empty' WHEN n_sections IS NULL THEN 'untitled' ELSE 'done' END AS status, coalesce(n_sections, 0) AS n_sections, coalesce(n_words, 0) AS n_words, coalesce(n_warnings, 0) AS n_warnings
  FROM documents d LEFT JOIN dressed t ON t.doc_id = d.doc_id LEFT JOIN counted_sections c ON c.doc_id = d.doc_id
)"""

TERM = f"upper(replace(regexp_replace(array_to_string(({views.words_sql('line')})[1:3], ' '), '[.:,]', '', 'g'), 'ß', 'ẞ'))"
#: As the SQL of detection, but for the text and the rule for headings, which looks at the next line that is not blank.
_GLOSSARY = document_queries.DETECTED_SQL[len(base.STRIPPED_SQL) : document_queries.DETECTED_SQL.index(", b AS (")].replace(
    "CASE WHEN regexp_matches(own, '(?i)^Chapter\\s+[0-9]+') AND NOT contains(own, '.') THEN true ELSE prev_blank AND passes END AS is_heading FROM pp",
    "CASE WHEN regexp_full_match(own, '[A-Z]-[0-9]{1,3}') THEN false WHEN regexp_matches(own, '(?i)^Chapter\\s+[0-9]+') AND NOT contains(own, '.') THEN true WHEN regexp_full_match(own, '\\p{Lu}') THEN coalesce(upper(next_own[1]) = own, false) ELSE prev_blank AND passes END AS is_heading "
    "FROM (SELECT *, first_value(CASE WHEN own <> '' THEN own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_own FROM pp)",
)
GLOSSARY_LINES_SQL = f"""WITH {views.DOC_LINES_SQL}, glossary_lists AS (
  SELECT doc_id, line_no, list_concat(CASE WHEN k % 3 < 2 THEN ['', CASE WHEN k % 3 = 0 THEN term[1] ELSE 'Z' END] ELSE [] END, CASE WHEN k % 4 = 0 THEN [''] ELSE [] END, ['', term, '', line], CASE WHEN k % 2 = 0 THEN ['G-' || (k % 500)] ELSE [] END,
    CASE WHEN k % 5 = 1 THEN ['Table columns: a | b', '- a: ' || k || '; b: y', ''] ELSE [] END, CASE WHEN k % 7 = 2 THEN ['- c: x; d: y'] ELSE [] END, CASE WHEN k % 6 = 3 THEN [' B '] ELSE [] END, list_transform(range(9), lambda j: 'more about it ' || j || ' at ' || k)) AS l
  FROM (SELECT *, line_no AS k, {TERM} AS term FROM doc_lines)
), stripped AS (
  SELECT doc_id, array_to_string(flatten(list(l ORDER BY line_no)), chr(10)) AS text FROM glossary_lists GROUP BY doc_id
){_GLOSSARY}"""
DETECTED_GLOSSARY_SQL = f"""{GLOSSARY_LINES_SQL}, body_lines AS (
  SELECT doc_id, seq, i AS k, l[i] AS line, trim(l[i]) AS own FROM (SELECT doc_id, seq, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, seq, string_split(content, chr(10)) AS l FROM bodies))
), kinds AS (
  SELECT *, starts_with(own, 'Table columns:') OR own = 'Table rows:' AS head, starts_with(own, '- ') AND contains(own, ':') AND contains(own, ';') AS item FROM body_lines WHERE NOT regexp_full_match(own, '[A-Z]-[0-9]{{1,3}}') AND NOT regexp_full_match(own, '\\p{{Lu}}')
), states AS (
  SELECT *, coalesce(last_value(CASE WHEN own = '' THEN NULL WHEN head THEN true WHEN NOT item THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id, seq ORDER BY k), false) AS skips FROM kinds
), kept_lines AS (
  SELECT doc_id, seq, string_agg(CASE WHEN own = '' THEN '' ELSE line END, chr(10) ORDER BY k) FILTER (WHERE NOT head AND NOT (item AND skips)) AS t FROM states GROUP BY doc_id, seq
), found AS (
  SELECT b.doc_id, b.seq, b.title, trim(regexp_replace(coalesce(t, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), {SPACE}) AS content FROM bodies b LEFT JOIN kept_lines k ON k.doc_id = b.doc_id AND k.seq = b.seq
  UNION ALL SELECT doc_id, 0, 'Content', trim(text, {SPACE}) FROM stripped WHERE doc_id NOT IN (SELECT doc_id FROM merged)
)
SELECT doc_id, seq, title, content, CAST(len({views.words_sql("content")}) AS BIGINT) AS word_count FROM found"""

QUERIES = {
    "detected_glossary": detected_glossary,
    "glossary_dividers": glossary_dividers,
    "wrapped_lines": wrapped_lines,
    "rewritten_tables": rewritten_tables,
    "bullet_lines": bullet_lines,
    "document_status": document_status,
    "status_tally": status_tally,
}
ORACLE_SQL = {
    "detected_glossary": DETECTED_GLOSSARY_SQL,
    "glossary_dividers": f"{GLOSSARY_LINES_SQL} SELECT doc_id, count(*) FILTER (WHERE is_heading) AS n_kept, count(*) FILTER (WHERE NOT is_heading) AS n_dropped FROM hh WHERE regexp_full_match(own, '\\p{{Lu}}') GROUP BY doc_id",
    "wrapped_lines": WRAPPED_SQL,
    "rewritten_tables": f"{TABLED_SQL}, {tables_sql('tabled')} SELECT doc_id, line_no, line FROM rewritten",
    "bullet_lines": f"{TABLED_SQL} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, {BULLET})) AS n_bullets, count(*) FILTER (WHERE {IS_ROW.format('line')}) AS n_rows FROM tabled GROUP BY doc_id",
    "clean_text": f"{CLEANED_SQL} SELECT doc_id, text FROM cleaned",
    "process_documents": f"""{PROCESSED_SQL} SELECT doc_id, chapter, CAST(chapter AS VARCHAR) AS id_prefix, seq, title, content, word_count, doc_title, no, chapter || '.' || no AS id, total_words,
  round_even(CAST(word_count AS DOUBLE) / greatest(total_words, 1) * 100, 2) AS section_weight FROM weighed""",
    "document_status": f"{STATUS_SQL} SELECT doc_id, status, n_sections, n_words, n_warnings FROM statuses",
    "status_tally": f"{STATUS_SQL} SELECT status, count(*) AS n FROM statuses GROUP BY status",
}
