"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus, after fixed base rules.

Words and pairs of neighbouring words are hashed into `buckets` buckets. Two multinomials are estimated over all
documents: of the trusted ones (a label says so) and of the raw corpus. A document's score is the sum over its n-grams
of log(target / raw) of their bucket (both smoothed towards the raw corpus), divided by their number; it is kept if the
base rules pass and the score reaches `threshold`. A word's hash is its CRC-32, a pair's a linear form of two of them. The ratios are whole numbers (millionths), so a sum does not depend on its order and reruns agree.
DataFrame functions only; the documents are never shuffled: the counting pass moves one row per task and bucket.

Defined results: a null or empty text has no words, zero counts, score null, and fails the base rules; repeated rows
each get a row; a null id is kept, and is never trusted; with no trusted document all ratios are zero; extra columns
are ignored by score_documents and passed on by keep_documents; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import common

BUCKETS = 1 << 16
#: Least score, in millionths of a natural logarithm per n-gram.
THRESHOLD = -80_000
WINDOW = 8
#: Above so many trusted ids (some MB) the ids are joined by a shuffle, not broadcast.
BROADCAST_IDS = 200_000
SYMBOLS = "#*$%&|<>"
PRIME = 1_000_003
#: Occurrences that every bucket has beforehand, at the raw corpus' rate: what is seldom seen says little.
PRIOR = 20.0


def word_hash(word: Column) -> Column:
    """A word's CRC-32, as a long."""
    return F.crc32(word.cast("binary"))


def pair_hash(first: Column, second: Column) -> Column:
    return first * PRIME + second


def neighbours(items: Column, distance: int, pair) -> Column:
    """pair(item, the item `distance` places later), for all items that have one."""
    n = F.greatest(F.size(items) - distance, F.lit(0))
    return F.zip_with(F.slice(items, 1, n), F.slice(items, 1 + distance, n), pair)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), common.SPACE_CLASS), "")


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rule_id, rule_text, rule_words, rule_hashes."""
    rows = docs.select(F.col(id_col).alias("rule_id"), F.coalesce(F.col(text_col), F.lit("")).alias("rule_text"))
    return rows.withColumn("rule_words", words_of(F.col("rule_text"))).withColumn("rule_hashes", F.transform("rule_words", word_hash))


def trusted_flag(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """rows with `trusted`: its id has label 1. The ids are broadcast while they are few; beyond that both sides shuffle."""
    ids = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("trusted_id")).distinct()
    few = ids.limit(bound + 1).count() <= bound
    ids = F.broadcast(ids) if few else ids
    return rows.join(ids, rows.rule_id == ids.trusted_id, "left").withColumn("trusted", F.col("trusted_id").isNotNull()).drop("trusted_id")


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS) -> DataFrame:
    """bucket, target_n, raw_n, ratio (millionths of a nat): of counts over all documents, smoothed by the prior."""
    rows = trusted_flag(docs.select(F.col(id_col).alias("rule_id"), F.col(text_col).alias("rule_text")), labels, id_col, label_col)
    # a row per word with the word after it, then a row per bucket: all of it compiled, no array functions
    words = words_of(F.col("rule_text"))
    rows = rows.withColumn("rule_words", words)
    rows = rows.withColumn("rule_next", F.slice("rule_words", 2, F.greatest(F.size("rule_words"), F.lit(1))))
    rows = rows.select("trusted", F.inline(F.arrays_zip("rule_words", "rule_next"))).toDF("trusted", "word", "after")
    hashed = rows.select("trusted", word_hash(F.col("word")).alias("h"), word_hash(F.col("after")).alias("g"))
    both = F.array(F.col("h") % buckets, pair_hash(F.col("h"), F.col("g")) % buckets)
    grams = hashed.select("trusted", F.explode(both).alias("bucket")).where("bucket is not null")
    grams = grams.select("trusted", F.col("bucket").cast("int").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.when(F.col("trusted"), 1)).alias("target_n"), F.count(F.lit(1)).alias("raw_n"))
    counts = common.materialize(counts, "ngrams")
    totals = counts.agg(F.coalesce(F.sum("target_n"), F.lit(0)).alias("target"), F.coalesce(F.sum("raw_n"), F.lit(0)).alias("raw")).first()
    d = lambda n: n.cast("double")
    expected = d(F.col("raw_n")) * (totals.target / totals.raw if totals.raw else 0.0)
    ratio = F.ln((d(F.col("target_n")) + PRIOR) / (expected + PRIOR))
    return counts.withColumn("ratio", (F.round(ratio * 1_000_000) if totals.target else F.lit(0)).cast("long"))


def ratio_array(ratios: DataFrame, buckets: int) -> list[int]:
    """The ratios by bucket: `buckets` numbers, whatever the corpus."""
    found = [0] * buckets
    for r in ratios.select("bucket", "ratio").collect():
        found[r.bucket] = r.ratio
    return found


def measures(rows: DataFrame, ratios: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """Adds the counts, base_failed, score and kept to rows of with_words()."""
    text, words, hashes, pairs = (F.col(c) for c in ("rule_text", "rule_words", "rule_hashes", "rule_pairs"))
    last = F.size(words) - WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "rule_lines": lines,
        "rule_pairs": neighbours(hashes, 1, pair_hash),
    })
    rows = rows.withColumn("rule_fours", neighbours(pairs, 2, lambda a, b: F.xxhash64(a, b)))
    # a window can stand twice only where a hash of four words does, and then one of eight words
    again = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    rows = rows.withColumn("rule_eights", F.when((last > 0) & again("rule_fours"), neighbours(F.col("rule_fours"), 4, lambda a, b: F.xxhash64(a, b))))
    rows = rows.withColumn("rule_windows", F.when(again("rule_eights"), windows))
    # equal windows stand side by side once (window, place) pairs are sorted
    seen = F.col("rule_windows")
    paired = F.sort_array(F.transform(seen, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("rule_sorted", F.when(F.size(F.array_distinct(seen)) < F.size(seen), paired))
    s = F.col("rule_sorted")
    again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("rule_places", F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col("rule_places")
    covered = F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), i + WINDOW) - i)), F.lit(0), lambda a, x: a + x)
    # always zero, but not deterministic either: no filter on the results is pushed below this point, where it would
    # repeat each measure inside the next
    barrier = F.when(F.spark_partition_id() < 0, 1).otherwise(0)
    by_bucket = F.from_json(F.lit(json.dumps(ratios)), "array<bigint>")
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + F.get(by_bucket, (b % len(ratios)).cast("int")))
    rows = rows.withColumns({
        "n_dup_lines": (F.size("rule_lines") - F.size(F.array_distinct("rule_lines"))).cast("long"),
        "n_repeat_words": (F.coalesce(covered, F.lit(0)) + barrier).cast("long"),
        "rule_total": total(hashes) + total(pairs),
        "rule_n": (F.size(hashes) + F.size(pairs)).cast("long"),
    })
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return rows.withColumns({
        "score": F.when(F.col("rule_n") > 0, F.col("rule_total") / F.col("rule_n") / 1_000_000),
        "kept": ~F.col("base_failed") & (F.col("rule_total") >= threshold * F.col("rule_n")),
    })


OUTPUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: id, the counts, base_failed, kept, score (nats per n-gram)."""
    ratios = ratio_array(log_ratios(docs, labels, id_col, text_col, label_col, buckets), buckets)
    return measures(with_words(docs, id_col, text_col), ratios, threshold).select(F.col("rule_id").alias(id_col), *OUTPUT)


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, threshold: int = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the rules keep."""
    ratios = ratio_array(log_ratios(docs, labels, id_col, text_col, label_col, buckets), buckets)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("rule_row"))
    rows = rows.withColumn("rule_text", F.coalesce(F.col("rule_row")[text_col], F.lit("")))
    rows = rows.withColumn("rule_words", words_of(F.col("rule_text"))).withColumn("rule_hashes", F.transform("rule_words", word_hash))
    return measures(rows, ratios, threshold).where("kept").select("rule_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


#: CRC-32 of the distinct words, by a table of 256 remainders.
OP1_SQL = f"""
WITH words AS (
  SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), remainders AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))
), bytes AS (
  SELECT word, [4294967295] || list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM placed)
), crcs AS (
  SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, remainders
), hashed AS (
  SELECT doc_id, h, h * {PRIME} + lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM placed JOIN crcs USING (word)
), grams AS (
  SELECT doc_id, h % {BUCKETS} AS bucket FROM hashed UNION ALL SELECT doc_id, g % {BUCKETS} FROM hashed WHERE g IS NOT NULL
), trusted AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), counts AS (
  SELECT bucket, count(trusted.doc_id) AS t, count(*) AS r FROM grams LEFT JOIN trusted USING (doc_id) GROUP BY bucket
), ratios AS (
  SELECT bucket, CASE WHEN sum(t) OVER () > 0 THEN CAST(round(ln((CAST(t AS DOUBLE) + {PRIOR}) / (CAST(r AS DOUBLE) * (CAST(sum(t) OVER () AS DOUBLE) / CAST(sum(r) OVER () AS DOUBLE)) + {PRIOR})) * 1000000) AS BIGINT) ELSE 0 END AS ratio FROM counts
), scores AS (
  SELECT doc_id, sum(ratio) AS total, count(*) AS n FROM grams JOIN ratios USING (bucket) GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)
), again AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows
), covered AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again WHERE c > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), measured AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, total, n
  FROM words w JOIN lines l USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN scores USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND total >= {THRESHOLD} * n AS kept,
  CAST(total AS DOUBLE) / CAST(n AS DOUBLE) / 1000000 AS score
FROM measured
"""
