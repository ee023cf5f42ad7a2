"""Cleaning extracted text: captions, page numbers, running headers, drawings, tables, wrapped lines.

Lines are rows (doc_id, line_no, line). After one exchange by doc_id every window here is local. The line rules expect
one row per doc_id; clean_text numbers the rows itself, so that null and repeated ids are documents of their own.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillworks.functions.textops import one_line_col, split_lines_col, strip_col

#: Executors need no copy of this module: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The patterns that decide what is an artifact. They run over line ends, so blank lines before go too.
CID = r"\(cid:\d+\)"
FIGURE = r"(?imdU)^\s*Figure\s+[\d\w\-]+[.:].*$"
IMAGE = r"(?imdU)^\s*(?:Image|Photo|Illustration|Diagram)\s+[\d\w\-]+[.:].*$"
PAGE_NUMBER = r"(?imdU)^\s*(?:\d{1,3}-\d{1,3}|Page\s+\d+|\d{1,4})\s*$"
IMAGE_WORD = r"(?iU)^\s*(?:image|photo|illustration|diagram|graphic)\s*$"
DRAWING = r"(?U)^[\s_\-=\.|/\\<>\[\]\(\)~`•·:]{4,}$"
DRAWING_MARKS = r"[_|\-=./\\<>\[\]()~`•·:]"
THREE_LETTERS, LONGEST_WORD = r"\p{L}\P{L}*\p{L}\P{L}*\p{L}", len("illustration")
BULLET = r"(?U)^\s*(?:[-*•]|\d+[.)]|[A-Za-z][.)])\s+"
CELL_END = r"\t+| {2,}"
CHAPTER_LINE = r"(?iU)^Chapter\s+\d+"
WRAP_LENGTH = 60
HEADER_COUNT, HEADER_LENGTH = 3, 120


def strip_artifacts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Removes (cid:n) marks, figure and image captions, and page numbers from the whole text."""
    text = F.col(text_col)
    for pattern in (CID, FIGURE, IMAGE, PAGE_NUMBER):
        text = F.regexp_replace(text, pattern, "")
    return df.withColumn(text_col, text)


def explode_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line and the other columns."""
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(split_lines_col(F.col(text_col))).alias("line_no", "line"))


def drop_repeated_lines(lines: DataFrame, min_count: int = HEADER_COUNT, max_len: int = HEADER_LENGTH) -> DataFrame:
    """Without lines that stand min_count times or more in their document and are shorter than max_len. Blank lines stay."""
    own = strip_col(F.col("line"))
    counted = lines.withColumn("own_line", own).withColumn("own_count", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "own_line")))
    header = (F.col("own_line") != "") & (F.col("own_count") >= min_count) & (F.length("own_line") < max_len)
    return counted.where(~header).drop("own_line", "own_count")


def image_line_col(line: Column) -> Column:
    """The line is a lone image word, or drawing marks alone, or almost so."""
    own = strip_col(line)
    # most lines have three letters soon: their marks are not counted
    few = F.when(own.rlike(THREE_LETTERS), False).otherwise(F.regexp_count(own, F.lit(DRAWING_MARKS)) >= F.greatest(F.lit(4), F.floor(F.length(own) / 2)))
    return (own != "") & (((F.length(own) <= LONGEST_WORD) & own.rlike(IMAGE_WORD)) | own.rlike(DRAWING) | few)


def drop_image_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~image_line_col(F.col("line")))


def _spaced(own: Column) -> Column:
    """There may be a cell's end in a stripped line."""
    return own.contains("\t") | own.contains("  ")


def cells_col(line: Column) -> Column:
    own = strip_col(line)
    return F.when(~_spaced(own), F.array_remove(F.array(own), "")).otherwise(F.filter(F.transform(F.split(own, CELL_END), strip_col), lambda c: c != ""))


def table_row_col(line: Column) -> Column:
    own = strip_col(line)
    return F.when(_spaced(own), (F.size(cells_col(line)) >= 2) & ~own.rlike(BULLET)).otherwise(False)


def table_text_col(rows: Column) -> Column:
    """The lines that stand for a table; null if its rows are too uneven. rows: array of cell arrays, 3 or more."""
    counts = F.transform(rows, lambda r: F.size(r))
    ranked = F.array_sort(F.transform(F.array_distinct(counts), lambda c: F.struct((-F.size(F.filter(counts, lambda x: x == c))).alias("n"), c.alias("c"))))
    usual = F.get(ranked, 0)["c"]
    even = F.size(F.filter(counts, lambda c: F.abs(c - usual) <= 1)) >= F.greatest(F.lit(3), F.floor(F.size(rows) * 0.6))
    first = F.get(rows, 0)
    lettered = F.size(F.filter(first, lambda c: c.rlike(r"\p{L}")))
    header_like = ~F.exists(first, lambda c: c.rlike(r"\p{Nd}")) & (lettered >= F.greatest(F.lit(2), F.size(first) - 1))

    def name(c: Column, k: Column) -> Column:
        own = F.regexp_replace(one_line_col(c), ":+$", "")
        return F.when(own == "", F.concat(F.lit("col_"), (k + 1).cast("string"))).otherwise(own)

    names = F.transform(first, name)

    def labelled(row: Column) -> Column:
        pairs = F.transform(row, lambda c, k: F.concat(F.coalesce(F.get(names, k), F.concat(F.lit("col_"), (k + 1).cast("string"))), F.lit(": "), one_line_col(c)))
        return F.concat(F.lit("- "), F.array_join(pairs, "; "))

    def plain(row: Column) -> Column:
        return F.concat(F.lit("- "), F.array_join(F.transform(row, one_line_col), " | "))

    with_header = F.concat(F.array(F.concat(F.lit("Table columns: "), F.array_join(names, " | "))), F.transform(F.slice(rows, 2, F.size(rows)), labelled))
    without = F.concat(F.array(F.lit("Table rows:")), F.transform(rows, plain))
    return F.when(even, F.when(header_like, with_header).otherwise(without))


def mark_tables(lines: DataFrame) -> DataFrame:
    """Adds cells, block (null outside of tables of three rows or more) and after (the blank line that ends a table)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_row, blank = table_row_col(F.col("line")), strip_col(F.col("line")) == ""
    marked = lines.withColumns({"cells": cells_col(F.col("line")), "is_row": is_row, "blank": blank, "place": F.row_number().over(order)})
    gap = F.col("place") - F.last(F.when(F.col("is_row"), F.col("place")), ignorenulls=True).over(before)
    joined = (gap == 1) | ((gap == 2) & F.lag("blank").over(order))
    marked = marked.withColumn("begins", F.when(F.col("is_row"), F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).otherwise(0))
    marked = marked.withColumn("run", F.sum("begins").over(order))
    by_run = Window.partitionBy("doc_id", "run")
    marked = marked.withColumns({"run_rows": F.count(F.when(F.col("is_row"), 1)).over(by_run), "run_last": F.max(F.when(F.col("is_row"), F.col("place"))).over(by_run)})
    table = (F.col("run") > 0) & (F.col("run_rows") >= 3)
    inside = table & (F.col("place") <= F.col("run_last"))
    after = table & F.col("blank") & (F.col("place") == F.col("run_last") + 1)
    return marked.select(*lines.columns, "cells", "is_row", F.when(inside, F.col("run")).alias("block"), after.alias("after"))


def rewrite_tables(lines: DataFrame) -> DataFrame:
    """Tables of three rows or more become text lines, an empty line after each; other lines stay. line_no is renewed."""
    marked = mark_tables(lines)
    rest = [c for c in lines.columns if c not in ("doc_id", "line_no", "line")]
    row = F.when(F.col("block").isNotNull() & F.col("is_row"), F.struct("line_no", "line", "cells"))
    rows = F.array_sort(F.collect_list(row).over(Window.partitionBy("doc_id", "block")))
    # the first row of a table brings all its lines, the others none
    marked = marked.withColumn("rows", F.when(F.col("block").isNotNull() & F.col("is_row"), rows))
    marked = marked.withColumn("rows", F.when(F.get(F.col("rows.line_no"), 0) == F.col("line_no"), F.col("rows")))
    text = F.concat(F.coalesce(table_text_col(F.col("rows.cells")), F.col("rows.line")), F.array(F.lit("")))
    outside = F.when(F.col("block").isNull() & ~F.col("after"), F.array("line"))
    made = F.when(F.col("rows").isNotNull(), text).otherwise(outside)
    out = marked.select("doc_id", *rest, F.col("line_no").alias("at"), F.posexplode(made).alias("sub", "line"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "sub")) - 1
    return out.withColumn("line_no", number).select(*lines.columns)


_BULLET, _CELLS, _CHAPTER = re.compile(BULLET.replace("(?U)", "")), re.compile(CELL_END), re.compile(CHAPTER_LINE.replace("(?iU)", "(?i)"))


def _apart(line: str) -> bool:
    """A line that never joins another: a bullet, a table row, a chapter line."""
    return bool(_BULLET.match(line) or _CHAPTER.match(line) or sum(1 for c in _CELLS.split(line) if c.strip()) >= 2)


def join_wrapped(lines: list[str]) -> list[str]:
    """Wrapped lines of one document put together. Whether a line goes on depends on how long it has become: a fold."""
    out: list[str] = []
    open_line = False
    for line in (x.strip() for x in lines):
        last = out[-1] if open_line else ""
        if not line:
            out.append("")
            open_line = False
        elif not open_line or _apart(last) or _apart(line):
            out.append(line)
            open_line = True
        elif last.endswith("-") and line[0].isalnum():
            out[-1] = last[:-1] + line
        elif not last.endswith((".", "!", "?", ":", ";")) and (line[0].islower() or last.endswith((",", "(", "/")) or len(last) >= WRAP_LENGTH):
            out[-1] = f"{last} {line}"
        else:
            out.append(line)
    return [" ".join(x.split()) for x in out]


def joined_lines_col(lines: Column, fold: Callable[[list[str]], list[str]] = join_wrapped) -> Column:
    """struct<lines, error>: the folded lines of each row, or why the fold failed on it. One bad row stops no other."""

    def attempt(given) -> dict:
        try:
            return {"lines": fold(list(given)), "error": None}
        except Exception as fault:  # whatever it is becomes the row's reason
            return {"lines": [], "error": f"{type(fault).__name__}: {fault}"}

    @F.pandas_udf("lines array<string>, error string")
    def join(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([attempt(x) for x in series], columns=["lines", "error"])

    return join(lines)


def own_documents(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """doc_id becomes a serial number of the row, the given id goes on as own_id; rows are dealt by the serial.

    The only exchange of the whole job: whatever follows groups and orders by doc_id. tasks: how many to deal to, to be
    raised with the size, so that what one of them sorts stays the same.
    """
    numbered = df.withColumnRenamed("doc_id", "own_id").withColumn("doc_id", F.monotonically_increasing_id())
    return numbered.repartition(tasks, "doc_id") if tasks else numbered.repartition("doc_id")


def clean_own(docs: DataFrame, text_col: str = "text", fold: Callable[[list[str]], list[str]] = join_wrapped, error_col: str | None = None) -> DataFrame:
    """own_documents() rows with the cleaned text. An empty line put before each text keeps documents without lines.

    A row on which the fold fails has the empty text, and its reason in error_col; without error_col it stops the job.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", text_col)]
    stripped = strip_artifacts(docs, text_col)
    lines = stripped.select("doc_id", *rest, F.posexplode(F.concat(F.array(F.lit("")), split_lines_col(F.col(text_col)))).alias("line_no", "line"))
    lines = rewrite_tables(drop_image_lines(drop_repeated_lines(lines)))
    texts = lines.groupBy("doc_id").agg(*[F.any_value(c).alias(c) for c in rest], F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    texts = texts.withColumn("lines", joined_lines_col(F.col("lines.line"), fold))
    error, joined = F.col("lines.error"), F.array_join(F.col("lines.lines"), "\n")
    if error_col is None:
        joined = F.when(error.isNull(), joined).otherwise(F.raise_error(error))
    text = strip_col(F.regexp_replace(joined, "\n{3,}", "\n\n")).alias(text_col)
    return texts.select("doc_id", *rest, text, *([error.alias(error_col)] if error_col else []))


def clean_text(df: DataFrame, text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """doc_id, the other columns, and the cleaned text; a document left without lines, or a null text, has the empty text.

    Rows with a null or repeated doc_id are cleaned each for itself; other columns, whatever their names and types, go
    along unread.
    """
    given = F.struct(*[df[c] for c in df.columns if c != text_col]).alias("given")
    packed = df.select(F.lit(None).cast("long").alias("doc_id"), given, df[text_col].alias("text"))
    others = [F.col("given")[c].alias(c) for c in df.columns if c not in ("doc_id", text_col)]
    return clean_own(own_documents(packed, tasks)).select(F.col("given")["doc_id"].alias("doc_id"), *others, F.col("text").alias(text_col))


def repeated_line_report(lines: DataFrame, top: int = 20, min_count: int = HEADER_COUNT, max_len: int = HEADER_LENGTH) -> DataFrame:
    """Of each document's `top` most frequent lines, those that would go as running headers: doc_id, own_line, n."""
    counts = lines.select("doc_id", strip_col(F.col("line")).alias("own_line")).where("own_line <> ''").groupBy("doc_id", "own_line").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "own_line"))
    return counts.withColumn("place", place).where((F.col("place") <= top) & (F.col("n") >= min_count) & (F.length("own_line") < max_len)).drop("place")


def line_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_chars."""
    return df.select("doc_id", F.size(split_lines_col(F.col(text_col))).cast("long").alias("n_lines"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"))
