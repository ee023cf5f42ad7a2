"""Rows that share an id are recordings of their own."""

import numpy as np
from pyspark.sql import functions as F
from quillworks.llm import audio, common, mixing, simhash


def test_rows_with_one_id(spark):
    rng = np.random.default_rng(8)
    a, b = (rng.standard_normal(64).clip(-4, 4).tolist() for _ in range(2))
    rows = [(20, [x / 10 for x in a]), (20, [x / 10 for x in a]), (3, [x / 10 for x in a]), (40, [x / 10 for x in b])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    prints = common.materialize(audio.fingerprint_vectors(vectors), "prints")
    assert prints.select("serial").distinct().count() == 4
    got = sorted((r.media_id, r.n_matches, r.best_id, r.best_error) for r in audio.search(prints, F.col("media_id") % 20 == 0).collect())
    assert got == [(20, 2, 3, 0.0), (20, 2, 3, 0.0), (40, 0, None, None)]


def test_rows_that_differ_in_a_map_alone(spark):
    """Equal ids and texts: the mix takes both rows, near-dedup keeps one of the two, and no row is swapped for another."""
    rows = [(1, "some words of a text here", "s", {"k": 1}), (1, "some words of a text here", "s", {"k": 2})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>")
    docs = docs.withColumns({"v": F.parse_json(F.concat(F.lit("["), F.col("m")["k"].cast("string"), F.lit("]"))), "deep": F.array("m")})
    assert docs.select(common.row_hash(docs).alias("h")).distinct().count() == 2
    assert {r.m["k"] for r in mixing.mixed_documents(docs).select("m").collect()} == {1, 2}
    assert simhash.keep_documents(docs).count() == 1
    turned = spark.createDataFrame([(1, {"a": 1, "b": 2}), (2, {"b": 2, "a": 1})], "i long, m map<string,int>").select("m")
    assert turned.select(common.row_hash(turned).alias("h")).distinct().count() == 1
