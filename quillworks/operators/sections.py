"""Sections of cleaned text: headings, merged and thinned, and the lines between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillworks.functions.textops import let, split_lines_col, strip_col, word_count_col, words_col
from quillworks.operators.lines import CHAPTER_LINE, FIGURE, PAGE_NUMBER

GLOSSARY_MARK = r"(?U)^[A-Z]-\d{1,3}$"
LONE_CAPITAL = r"^\p{IsUppercase}$"
LONGEST_MARK = len("A-999")
# The words that may stand in lower case in a title.
MINOR_WORDS = "a an the to of in on at for by and or nor but with as from into over under about above below between through during".split()
MERGE_GAP, CLUSTER_GAP, CLUSTER_SIZE, LEAST_CHARS = 4, 8, 6, 200


def order_by_line() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def title_case_col(line: Column) -> Column:
    """First word capital; later words that begin with a letter capital or minor."""
    words = words_col(line)

    def fits(word: Column) -> Column:
        bare = F.regexp_replace(word, "^['\"]+|['\"]+$", "")
        return ~bare.rlike(r"^\p{L}") | F.lower(bare).isin(MINOR_WORDS) | bare.rlike(r"^\p{IsUppercase}")

    return F.coalesce(F.get(words, 0).rlike(r"^\p{IsUppercase}"), F.lit(False)) & F.forall(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), fits)


def heading_col(line: Column) -> Column:
    """The line may be a heading, whatever stands before it."""
    own = strip_col(line)
    shape = own.rlike(r"^[\p{L}\p{N}]") & ~own.rlike(FIGURE) & ~own.rlike(PAGE_NUMBER)
    # the cheap rules first: the others are not asked about most lines
    fits = F.when(shape, title_case_col(own) | ((own == F.upper(own)) & own.rlike(r"\p{L}"))).otherwise(False)
    return F.when(F.length(own).between(3, 120), F.when(own.contains(".") | own.contains(":"), False).otherwise(fits)).otherwise(False)


def resolve_doc_type(docs: DataFrame, text_col: str = "text", name_col: str = "source_name", type_col: str = "doc_type") -> DataFrame:
    """Adds is_glossary: asked for, or (auto) seen in the name, the first 350 lines, or by page marks and dividers."""
    named = F.lower(F.coalesce(F.col(name_col), F.lit(""))).contains("glossary")

    def seen(lines: Column) -> Column:
        short = F.filter(F.transform(F.slice(lines, 1, 2000), strip_col), lambda x: F.length(x) <= LONGEST_MARK)
        marks, capitals = F.size(F.filter(short, lambda x: x.rlike(GLOSSARY_MARK))), F.size(F.filter(short, lambda x: x.rlike(LONE_CAPITAL)))
        return F.exists(F.slice(lines, 1, 350), lambda x: F.lower(x).contains("glossary")) | ((marks >= 5) & (capitals >= 3))

    looks = F.when(named, True).otherwise(let(split_lines_col(F.col(text_col)), seen))
    mode = F.lower(F.trim(F.coalesce(F.col(type_col), F.lit("auto"))))
    return docs.withColumn("is_glossary", F.when(mode == "glossary", True).when(mode == "chapter", False).otherwise(looks))


def flag_headings(lines: DataFrame) -> DataFrame:
    """Adds own (the stripped line), blank, passes (heading_col), prev_blank, is_heading. lines has is_glossary."""
    order = order_by_line()
    rows = lines.withColumn("own", strip_col(F.col("line"))).withColumn("blank", F.col("own") == "")
    rows = rows.withColumn("begins", F.nullif(F.substring("own", 1, 1), F.lit("")))
    # in the order of the other windows: a frame that looks back from the end would sort the lines once more each way
    later = F.expr("lead(begins) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY line_no)")
    rows = rows.withColumns({"prev_blank": F.coalesce(F.lag("blank").over(order), F.lit(True)), "next_begins": later})
    rows = rows.withColumn("passes", heading_col(F.col("own")))
    capital = (F.length("own") == 1) & F.col("own").rlike(LONE_CAPITAL)
    divider = capital & F.coalesce(F.upper("next_begins") == F.col("own"), F.lit(False))
    is_heading = (
        F.when(F.col("is_glossary") & F.col("own").rlike(GLOSSARY_MARK), False)
        .when(F.col("begins").isin("c", "C") & F.col("own").rlike(CHAPTER_LINE) & ~F.col("own").contains("."), True)
        .when(F.col("is_glossary") & capital, divider)
        .otherwise(F.col("passes") & F.col("prev_blank"))
    )
    return rows.withColumn("is_heading", is_heading).drop("begins", "next_begins")


def heading_audit(flagged: DataFrame) -> DataFrame:
    """Lines that look like headings, and whether a missing blank line before keeps them from being one."""
    return flagged.where("passes").select("doc_id", "line_no", "own", (~F.col("prev_blank")).alias("no_blank_before"))


def merge_headings(flagged: DataFrame, max_gap: int = MERGE_GAP) -> DataFrame:
    """doc_id, start_line, end_line, title: headings with blanks alone between, at most max_gap lines apart, are one."""
    order = order_by_line()
    rows = flagged.withColumn("filled", F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(order)).where("is_heading")
    near = (F.col("line_no") - F.lag("line_no").over(order) <= max_gap) & (F.col("filled") - F.lag("filled").over(order) == 1)
    rows = rows.withColumn("starts", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("starts").over(order))
    merged = rows.groupBy("doc_id", "part").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.array_sort(F.collect_list(F.struct("line_no", "own"))).alias("parts"))
    return merged.select("doc_id", "start_line", "end_line", F.array_join(F.col("parts.own"), " ").alias("title"))


def mark_clusters(headings: DataFrame, gap: int = CLUSTER_GAP) -> DataFrame:
    """Adds cluster (number in the document) and cluster_size: runs of headings at most `gap` lines apart."""
    order = Window.partitionBy("doc_id").orderBy("start_line")
    near = F.col("start_line") - F.lag("end_line").over(order) <= gap
    rows = headings.withColumn("starts", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("cluster", F.sum("starts").over(order)).drop("starts")
    return rows.withColumn("cluster_size", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "cluster")))


def drop_heading_clusters(headings: DataFrame, gap: int = CLUSTER_GAP, min_size: int = CLUSTER_SIZE) -> DataFrame:
    """Without clusters of min_size headings or more: these are listings, whose text stays in the body."""
    return mark_clusters(headings, gap).where(F.col("cluster_size") < min_size).drop("cluster", "cluster_size")


def assign_sections(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, seq (from 0), title, content: the lines after each heading, up to the next. Earlier lines are lost."""
    order = order_by_line()
    rows = lines.join(headings.withColumnRenamed("doc_id", "h_doc"), (F.col("doc_id") == F.col("h_doc")) & (F.col("line_no") == F.col("start_line")), "left")
    seq = F.sum(F.when(F.col("start_line").isNotNull(), 1).otherwise(0)).over(order) - 1
    rows = rows.withColumns({"seq": seq, "until": F.last("end_line", ignorenulls=True).over(order)}).where("seq >= 0")
    body = F.when(F.col("line_no") > F.col("until"), F.struct("line_no", "line"))
    made = rows.groupBy("doc_id", "seq").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(body)).alias("body"))
    return made.select("doc_id", "seq", "title", strip_col(F.array_join(F.col("body.line"), "\n")).alias("content"))


def clean_glossary(sections: DataFrame) -> DataFrame:
    """Glossary bodies without page marks, lone capitals and what table rewriting left.

    With a column is_glossary, other sections stay as they are.
    """
    asked = F.col("is_glossary") if "is_glossary" in sections.columns else F.lit(True)
    keys = [F.col(c) for c in sections.columns if c != "content"]
    plain = F.when(~asked, F.col("content")).alias("plain")
    rows = sections.select(*keys, plain, F.posexplode_outer(F.when(asked, split_lines_col(F.col("content")))).alias("line_no", "line"))
    own = strip_col(F.coalesce(F.col("line"), F.lit("")))
    rows = rows.withColumn("own", own).withColumn("mark", F.col("own").rlike(GLOSSARY_MARK) | F.col("own").rlike(LONE_CAPITAL))
    head = F.col("own").startswith("Table columns:") | (F.col("own") == "Table rows:")
    item = F.col("own").startswith("- ") & F.col("own").contains(":") & F.col("own").contains(";")
    state = F.when((F.col("own") == "") | F.col("mark"), F.lit(None)).when(head, F.lit(True)).when(~item, F.lit(False))
    order = Window.partitionBy("doc_id", "seq").orderBy("line_no")
    rows = rows.withColumns({"head": head, "item": item, "state": state})
    rows = rows.withColumn("skips", F.coalesce(F.last("state", ignorenulls=True).over(order), F.lit(False)))
    fits = F.col("line_no").isNotNull() & ~F.col("mark") & ~F.col("head") & ~(F.col("item") & F.col("skips"))
    kept = F.when(fits, F.struct("line_no", F.when(F.col("own") == "", F.lit("")).otherwise(F.col("line")).alias("line")))
    texts = rows.groupBy(*keys, "plain").agg(F.array_sort(F.collect_list(kept)).alias("body"))
    text = strip_col(F.regexp_replace(F.array_join(F.col("body.line"), "\n"), "\n{3,}", "\n\n"))
    return texts.select(*[F.coalesce("plain", text).alias(c) if c == "content" else F.col(c) for c in sections.columns])


def smooth_sections(sections: DataFrame, min_chars: int = LEAST_CHARS) -> DataFrame:
    """Sections of under min_chars characters go into a neighbour; seq is renewed.

    Leading ones are put together until they are long enough, under the last title, the earlier titles in reverse order
    before the contents; a later short one goes to the section before it, title and content. Running sums decide.
    With a column is_glossary, the sections of glossaries stay as they are. Other columns belong to the document.
    """
    glossary = F.col("is_glossary") if "is_glossary" in sections.columns else F.lit(False)
    rest = [c for c in sections.columns if c not in ("doc_id", "seq", "title", "content")]
    order = Window.partitionBy("doc_id").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    length = lambda c: F.when(F.length(c) > 0, F.length(c) + 1).otherwise(0)
    rows = sections.withColumn("chars", F.sum(length("content")).over(so_far) + F.coalesce(F.sum(length("title")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1)
    everything = Window.partitionBy("doc_id")
    first = F.coalesce(F.min(F.when(F.col("chars") >= min_chars, F.col("seq"))).over(everything), F.max("seq").over(everything))
    rows = rows.withColumn("first", F.when(glossary, -1).otherwise(first))
    later = F.when((F.col("seq") > F.col("first")) & (glossary | (F.length("content") >= min_chars)), 1).otherwise(0)
    rows = rows.withColumn("opens", later).withColumn("part", F.sum("opens").over(order))
    lead = F.col("seq") <= F.col("first")
    rank = lambda group, place, text: F.struct(F.lit(group).alias("g"), place.alias("p"), text.alias("t"))
    pieces = (
        F.when(F.col("seq") < F.col("first"), F.array(rank(0, -F.col("seq"), F.col("title")), rank(1, F.col("seq"), F.col("content"))))
        .when(lead | (F.col("opens") == 1), F.array(rank(1, F.col("seq"), F.col("content"))))
        .otherwise(F.array(rank(1, F.col("seq"), F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("content"), F.lit(""))))))
    )
    titled = F.when((F.col("seq") == F.col("first")) | (F.col("opens") == 1), F.col("title"))
    made = rows.groupBy("doc_id", "part", *rest).agg(F.max(titled).alias("title"), F.array_sort(F.flatten(F.collect_list(pieces))).alias("pieces"))
    text = strip_col(F.array_join(F.filter(F.col("pieces.t"), lambda x: x != ""), "\n"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return made.select("doc_id", *rest, seq.alias("seq"), "title", text.alias("content"))


def outline(flagged: DataFrame, rest: list[str], min_size: int = CLUSTER_SIZE) -> DataFrame:
    """The bodies of flag_headings() rows in one go: merged headings, clusters dropped, lines given to sections.

    The same as merge_headings, drop_heading_clusters and assign_sections, but headings are never taken apart from the
    lines and joined back: running values carry them. Clusters of min_size headings or more are dropped. A document without headings is one section `Content`, with the text
    that its first line holds (column whole).
    """
    order = order_by_line()
    before, doc = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("doc_id")
    heading = lambda c: F.when(F.col("is_heading"), F.col(c))
    # a heading alone needs its stripped line: the others' would be sorted with them
    rows = flagged.withColumn("own", F.when(F.col("is_heading"), F.col("own"))).withColumn("filled", F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(order)).drop("blank", "passes", "prev_blank")
    rows = rows.withColumns({"prev_line": F.last(heading("line_no"), ignorenulls=True).over(before), "prev_filled": F.last(heading("filled"), ignorenulls=True).over(before)})
    gap = F.col("line_no") - F.col("prev_line")
    joins = F.coalesce((gap <= MERGE_GAP) & (F.col("filled") - F.col("prev_filled") == 1), F.lit(False))
    rows = rows.withColumn("starts", (F.col("is_heading") & ~joins).cast("int"))
    apart = F.when((F.col("starts") == 1) & ~F.coalesce(gap <= CLUSTER_GAP, F.lit(False)), 1).otherwise(0)
    rows = rows.withColumns({"part": F.sum("starts").over(order), "cluster": F.sum(apart).over(order)})
    rows = rows.withColumn("cluster_size", F.sum("starts").over(Window.partitionBy("doc_id", "cluster")))
    of_part = Window.partitionBy("doc_id", "part")
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_heading"), F.struct("line_no", "own"))).over(of_part)), lambda x: x["own"]), " ")
    rows = rows.withColumns({"real": (F.col("starts") == 1) & (F.col("cluster_size") < min_size), "end_line": F.max(heading("line_no")).over(of_part)})
    rows = rows.withColumn("head", F.when(F.col("real"), titles))
    rows = rows.withColumns({"seq": F.sum(F.col("real").cast("int")).over(order) - 1, "until": F.last(F.when(F.col("real"), F.col("end_line")), ignorenulls=True).over(order)})
    rows = rows.withColumn("found", F.max("seq").over(doc) >= 0).where("seq >= 0 or not found")
    body = F.when(F.col("line_no") > F.col("until"), F.struct("line_no", "line"))
    made = rows.groupBy("doc_id", "seq", "found", *rest).agg(F.max("head").alias("head"), F.max("whole").alias("whole"), F.array_sort(F.collect_list(body)).alias("body"))
    content = F.when(F.col("found"), F.array_join(F.col("body.line"), "\n")).otherwise(F.coalesce("whole", F.lit("")))
    return made.select("doc_id", *rest, F.greatest("seq", F.lit(0)).alias("seq"), F.when(F.col("found"), F.col("head")).otherwise("Content").alias("title"), strip_col(content).alias("content"), "found")


def detect_sections(docs: DataFrame, text_col: str = "text", name_col: str = "source_name", type_col: str = "doc_type") -> DataFrame:
    """doc_id, seq, title, content, word_count, and the other columns, of cleaned documents (doc_id, text, source_name,
    doc_type), one row per doc_id.

    A document without headings is one section `Content` with all its text. No exchange if docs are dealt by doc_id.
    """
    typed = resolve_doc_type(docs, text_col, name_col, type_col)
    rest = [c for c in typed.columns if c not in ("doc_id", text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = typed.select("doc_id", *rest, text.alias("whole_text"), F.posexplode_outer(split_lines_col(text)).alias("at", "read"))
    lines = lines.select("doc_id", *rest, F.coalesce("at", F.lit(0)).alias("line_no"), F.coalesce("read", F.lit("")).alias("line"), F.when(F.coalesce("at", F.lit(0)) == 0, F.col("whole_text")).alias("whole"))
    parts = outline(flag_headings(lines), rest)
    # a document without headings is neither smoothed nor cleaned further
    asked = [c for c in parts.columns if c != "found"]
    parts = parts.withColumn("is_glossary", F.col("is_glossary") & F.col("found")).withColumn("as_is", F.col("is_glossary") | ~F.col("found"))
    cleaned = clean_glossary(parts.select(*asked, "as_is"))
    smoothed = smooth_sections(cleaned.withColumn("is_glossary", F.col("as_is")).drop("as_is"))
    return smoothed.withColumn("word_count", word_count_col(F.col("content"))).drop("is_glossary")
