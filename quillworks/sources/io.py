"""Reading and writing corpora, documents, blueprints and chosen outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "struct<id:string,title:string,content:string,wordCount:int,sectionWeight:double,tags:array<string>>"
DOCUMENT = f"chapter int, prefix string, title string, totalSections int, totalWords int, sections array<{SECTION}>, _corrupt_record string"
BLUEPRINT_SECTION = "struct<sectionId:string,id:string,sectionIndex:int,sourceSectionId:string,sectionTitle:string,weightPercentage:double,requiredQuestions:int,subjects:array<string>,rationale:string,sourceWordCount:int,modelUsed:string>"
BLUEPRINT = f"questionBank struct<chapterId:string,bookId:string,chapterTitle:string,sourceRelativePath:string,generatedAt:string,modelUsed:string,modelVersion:string,notes:string,totalRequiredQuestions:int,targetTotalQuestions:int,sectionBlueprints:array<{BLUEPRINT_SECTION}>>, _corrupt_record string"
#: An output and those it is made from.
NEEDS = {"blueprint": (), "bank": (), "pairs": ("bank",), "records": ("bank", "pairs"), "summary": ()}
#: Stands between the Markdown documents of a file. A text that holds it has the sign for it in its place.
RECORD_END, RECORD_SIGN = "\x1e", "\u241e"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """source_name, text: one row per file of a path or glob; an empty file has none."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_name"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """Document JSON files, one object each; a file that is no JSON has its text in _corrupt_record.

    many: files with one document a line, as write_documents() leaves them.
    """
    return spark.read.schema(DOCUMENT).json(path, multiLine=not many, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def document_sections(docs: DataFrame) -> DataFrame:
    """chapter, prefix, title, no (from 1) and the fields of each section; a row without them for an empty document."""
    return docs.select("chapter", "prefix", F.col("title").alias("doc_title"), F.posexplode_outer("sections").alias("at", "s")).select("chapter", "prefix", "doc_title", (F.col("at") + 1).cast("long").alias("no"), "s.*")


def flag_bad(blueprints: DataFrame) -> DataFrame:
    """Adds bad: the row was no JSON or has no question bank. A bad row has no question bank."""
    bad = F.col("_corrupt_record").isNotNull() | F.col("questionBank").isNull()
    return blueprints.withColumn("bad", bad).withColumn("questionBank", F.when(~F.col("bad"), F.col("questionBank")))


def read_blueprints(spark: SparkSession, path: str) -> DataFrame:
    """Blueprint JSON files with bad: the file is no JSON or has no question bank."""
    return flag_bad(spark.read.schema(BLUEPRINT).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"))


def clustered(docs: DataFrame, partition_col: str, id_col: str, files: int) -> DataFrame:
    """Rows of one folder dealt to at most `files` tasks, by a hash of their id: a folder gets at most as many files."""
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(files))
    return docs.repartition(F.col(partition_col), part).sortWithinPartitions(partition_col)


def write_documents(docs: DataFrame, path: str, partition_col: str = "book_id", mode: str = "errorifexists", id_col: str | None = None, files: int = 8) -> None:
    """One JSON object per document, many to a file, under a folder for each book with at most `files` files.

    id_col tells documents apart (default: prefix). A large book is spread over `files` tasks; raise it with the size.
    """
    clustered(docs, partition_col, id_col or "prefix", files).write.partitionBy(partition_col).mode(mode).json(path)


def markdown_col(chapter: Column, title: Column, sections: Column) -> Column:
    """A document as Markdown: header, counts, a heading and the text of every section."""
    head = F.array(F.concat(F.lit("# Chapter "), F.coalesce(chapter.cast("string"), F.lit("?")), F.lit(": "), F.coalesce(title, F.lit("Unknown"))), F.lit(""), F.lit("## Conversion Metadata"), F.concat(F.lit("- Chapter Number: "), F.coalesce(chapter.cast("string"), F.lit("?"))), F.concat(F.lit("- Section Count: "), F.size(sections).cast("string")), F.lit(""))
    text = lambda s: F.coalesce(F.nullif(F.trim(s["content"]), F.lit("")), F.lit("[No content extracted]"))
    body = F.flatten(F.transform(sections, lambda s: F.array(F.concat(F.lit("## "), F.coalesce(s["id"], F.lit("")), F.lit(" - "), F.coalesce(s["title"], F.lit("Untitled"))), F.lit(""), text(s), F.lit(""))))
    return F.concat(F.regexp_replace(F.array_join(F.concat(head, body), "\n"), r"\s+$", ""), F.lit("\n"))


def write_markdown(docs: DataFrame, path: str, name_col: str = "doc_id", mode: str = "errorifexists", files: int = 8) -> None:
    """Markdown documents, many to a file, at most `files` files under path/documents, and an index of names.

    Every document begins with a comment that holds its name. The index (path/index: name, bucket, n_chars) tells in which
    folder a name is, so one document is found without reading the others.
    """
    name = F.regexp_replace(F.coalesce(F.col(name_col).cast("string"), F.lit("")), "[\\r\\n]|-->", " ")
    rows = docs.select(name.alias("name"), markdown_col(F.col("chapter"), F.col("title"), F.col("sections")).alias("markdown"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(files)))
    text = F.translate(F.concat(F.lit("<!-- file: "), "name", F.lit(" -->\n"), "markdown"), RECORD_END, RECORD_SIGN)
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "name")
    dealt.select("bucket", text.alias("value")).write.partitionBy("bucket").mode(mode).option("lineSep", RECORD_END).text(f"{path}/documents")
    index = read_markdown(docs.sparkSession, path).select("name", "bucket", F.length("markdown").alias("n_chars"))
    # dealt anew, not coalesced: one task would read all documents for the index
    index.repartition(1 if files <= 64 else files // 64).write.mode(mode).parquet(f"{path}/index")


def read_markdown(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """name, bucket, markdown of the documents that write_markdown() has put there; with names, only their folders are read."""
    rows = spark.read.option("basePath", f"{path}/documents").option("lineSep", RECORD_END).text(f"{path}/documents")
    if names is not None:
        found = spark.read.parquet(f"{path}/index").where(F.col("name").isin(names)).select("bucket").distinct().collect()
        rows = rows.where(F.col("bucket").isin([r.bucket for r in found]))
    head = F.regexp_extract("value", r"(?s)\A<!-- file: (.*?) -->\n", 1)
    rows = rows.select(head.alias("name"), F.col("bucket").cast("long").alias("bucket"), F.regexp_replace("value", r"(?s)\A<!-- file: .*? -->\n", "").alias("markdown"))
    return rows if names is None else rows.where(F.col("name").isin(names))


def with_needed(wanted: set[str], needs: dict[str, tuple[str, ...]] = NEEDS) -> list[str]:
    """The wanted outputs and all they are made from, in order of making. They are made by runs.make_outputs()."""
    out: list[str] = []

    def add(name: str) -> None:
        for need in needs.get(name, ()):
            add(need)
        if name not in out:
            out.append(name)

    for name in sorted(wanted):
        add(name)
    return out


def prefix_col(name: Column) -> Column:
    """A file prefix: the word chapter dropped, other characters than letters and digits made one underscore."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), "(?i)chapter", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def output_names(names: DataFrame, name_col: str = "name", ending: str = ".json", fallback: str = "output") -> DataFrame:
    """Adds file_name: the last part of a path, or the fallback, with the ending if it has none."""
    base = F.coalesce(F.nullif(F.trim(F.element_at(F.split(F.coalesce(F.col(name_col), F.lit("")), r"[/\\]"), -1)), F.lit("")), F.lit(fallback))
    return names.withColumn("file_name", F.when(F.lower(base).endswith(ending), base).otherwise(F.concat(base, F.lit(ending))))


def name_collisions(names: DataFrame, existing: DataFrame | None = None, name_col: str = "file_name") -> DataFrame:
    """lower_name, reason: names that are the same but for case within the run, or as an existing file's."""
    own = names.select(F.lower(name_col).alias("lower_name"))
    twice = own.groupBy("lower_name").count().where("count > 1").select("lower_name", F.lit("repeated in the run").alias("reason"))
    if existing is None:
        return twice
    there = existing.select(F.lower(name_col).alias("lower_name")).distinct()
    return twice.unionByName(own.distinct().join(there, "lower_name", "left_semi").withColumn("reason", F.lit("file exists")))


def skip_existing(wanted: DataFrame, existing: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows whose path, in lower case and with / for \\, is not there yet."""
    key = lambda c: F.lower(F.regexp_replace(c, r"\\", "/"))
    there = existing.select(key(F.col(path_col)).alias("there")).distinct()
    return wanted.join(there, key(wanted[path_col]) == F.col("there"), "left_anti")


def status_tally(results: DataFrame, status_col: str = "status") -> DataFrame:
    return results.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))
