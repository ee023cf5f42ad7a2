"""The similarity joins against all pairs: classes, links, membership, hot tokens in blocks, odd texts."""

import glob
import os
import random
import time
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from quillworks.functions.textops import has_tokens_col, token_set_col
from quillworks.operators import simjoin
from quillworks.sources import shared

from tests.test_queries import QUERIES, plan

TEXTS = "id string, text string"


def tokens_of(text):
    kept = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (text or "").lower())
    return frozenset(w for w in kept.split() if len(w) >= 4)


def some_texts(n=90):
    rng = random.Random(3)
    rare = [f"token{k:02d}" for k in range(24)]
    texts = [" ".join(["shared", *(rng.choice(rare[: rng.choice([6, 24])]) for _ in range(rng.randint(0, 9)))]) for _ in range(n)]
    texts += [texts[0], texts[0].upper(), texts[1] + " abc", None, "", "a bc def", "ÄÖÜ ßß", "shared", "SHARED, shared!", "KelvinK words"]
    return [(f"t{k:03d}", t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("threshold,block", [(0.72, 2_000), (0.72, 3), (0.5, 2), (1.0, 2)])
def test_within_equals_all_pairs(spark, threshold, block):
    rows = some_texts()
    pairs, members = simjoin.similar_within(spark.createDataFrame(rows, TEXTS).withColumn("key", F.lit("clash")), threshold, block=block)
    ids = defaultdict(list)
    for i, t in rows:
        if tokens_of(t):
            ids[tokens_of(t)].append(i)
    part, want, links = Fraction(str(threshold)), set(), defaultdict(int)
    for a in ids:
        for b in ids:
            if min(ids[a]) < min(ids[b]) and Fraction(len(a & b), len(a | b)) >= part:
                want.add((min(ids[a]), min(ids[b]), len(a & b) / len(a | b)))
                links[a] += 1
                links[b] += 1
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sorted(map(tuple, members.collect())) == sorted((i, min(ids[s]), len(ids[s]), links[s]) for s in ids for i in ids[s])


def test_groups_of_two_tables(spark):
    rows = some_texts(40)
    left, right = spark.createDataFrame(rows, TEXTS), spark.createDataFrame(rows[:15] + rows[-10:], TEXTS)
    got = {(r.left_id, r.right_id): (r.n_left, r.n_right) for r in simjoin.similar_groups(left, right, 0.6).collect()}
    a, b = defaultdict(list), defaultdict(list)
    for side, table in ((a, rows), (b, rows[:15] + rows[-10:])):
        for i, t in table:
            if tokens_of(t):
                side[tokens_of(t)].append(i)
    want = {(min(a[x]), min(b[y])): (len(a[x]), len(b[y])) for x in a for y in b if Fraction(len(x & y), len(x | y)) >= Fraction(3, 5)}
    assert got == want


def test_cells_spread_a_hot_token(spark):
    """Every two sets of a token meet in just one cell, and no cell holds more than a few blocks' sets."""
    index = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit(4).alias("size"), F.lit(0).alias("place"), F.lit("everywhere").alias("token"))
    rows = [r for r in simjoin.cells(index, 50).collect()]
    by_cell = defaultdict(list)
    for r in rows:
        by_cell[r.low, r.high].append(r)
    assert len(by_cell) == 55 and max(map(len, by_cell.values())) < 170
    met = defaultdict(int)
    for (low, high), found in by_cell.items():
        for a in found:
            for b in found:
                if a.key < b.key and (a.blk != b.blk or low == high):
                    met[a.key, b.key] += 1
    assert len(met) == 500 * 499 // 2 and set(met.values()) == {1}


def test_no_plan_groups_by_a_token_alone(spark):
    texts = spark.createDataFrame(some_texts(), TEXTS)
    sets, _ = simjoin.classes(texts)
    text = plan(simjoin.links(sets))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    joins = [line for line in text.split("\n") if "Join" in line and "token_b" in line]
    assert joins and all("low" in line and "high" in line for line in joins)


def test_a_table_compared_with_itself_is_dealt_once(spark, tmp_path):
    """The index goes through one exchange that both sides read, and so do the sets that pairs are verified with."""
    simjoin.classes(spark.createDataFrame(some_texts(), TEXTS))[0].write.parquet(f"{tmp_path}/sets")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        text = plan(simjoin.links(spark.read.parquet(f"{tmp_path}/sets")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    reused = [line for line in text.split("\n") if "ReusedExchange" in line]
    assert sum("Exchange hashpartitioning(token" in line and "low" in line for line in reused) == 1
    assert sum("tokens_b" in line for line in reused) == 1


def test_a_stored_table_leaves_no_shuffle_files(spark):
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*", recursive=True))
    setting = spark.conf.get(shared.DROP_SHUFFLES, None)
    there = files()
    assert shared.stored(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 9).alias("k")).count(), "counts").count() == 9
    made, until = files() - there, time.time() + 20
    while made & files() and time.time() < until:
        time.sleep(0.2)
    # what is left belongs to the count of the table, one row
    assert sum(os.path.getsize(f) for f in files() - there) < 1_000 and spark.conf.get(shared.DROP_SHUFFLES, None) == setting


def test_token_sets(spark):
    rows = some_texts() + [("x", "ab-cdef_ghij;klm\x0bnopq 12345 é2345")]
    for r in spark.createDataFrame(rows, TEXTS).select("text", token_set_col(F.col("text")).alias("t"), has_tokens_col(F.col("text")).alias("some")).collect():
        assert frozenset(r.t) == tokens_of(r.text) and len(r.t) == len(set(r.t)) and r.some == bool(r.t)


def test_empty(spark):
    none = spark.createDataFrame([], TEXTS)
    pairs, members = simjoin.similar_within(none)
    assert pairs.collect() == [] and members.collect() == [] and simjoin.similar_groups(none, none).collect() == []


def test_signs_leave_few_pairs_but_true_ones(spark):
    """Sets that share a rare token and little else do not leave the join as pairs, and no pair at the threshold is lost."""
    rng, t = random.Random(5), Fraction("0.72")
    words = [f"word{k:04d}" for k in range(3_000)]
    rows = [(k, ["aaaa", *rng.sample(words, rng.choice([12, 30, 80]))]) for k in range(60)]
    rows += [(100 + k, [*w[: len(w) - len(w) // 8], *rng.sample(words, len(w) // 12)]) for k, w in rows]
    sets = spark.createDataFrame([(k, sorted(set(w))) for k, w in rows], "key long, tokens array<string>")
    other = sets.withColumnsRenamed({"key": "key_b", "tokens": "tokens_b"})
    both = sets.withColumns({"size": F.size("tokens"), "sign": simjoin.sign_col(F.col("tokens"))}).join(other.withColumns({"size_b": F.size("tokens_b"), "sign_b": simjoin.sign_col(F.col("tokens_b"))}), F.col("key") < F.col("key_b"))
    shared = F.size(F.array_intersect("tokens", "tokens_b"))
    true = shared * t.denominator >= (F.col("size") + F.col("size_b") - shared) * t.numerator
    allowed = simjoin.signs_allow(F.col("sign"), F.col("sign_b"), F.col("size"), F.col("size_b"), t)
    n_true, n_allowed, n_lost = both.select(F.count_if(true), F.count_if(allowed), F.count_if(true & ~allowed)).first()
    assert n_true >= 50 and n_lost == 0 and n_allowed <= n_true + 20


def test_benchmark_pairs_name_every_copy(spark, tmp_path):
    text = "alpha bravo charlie delta echoes"
    spark.createDataFrame([(1, "s", text), (2, "s", text), (3, "s", text + " foxtrot"), (4, "s", "quite other words")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, text), (8, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.left_id, r.right_id) for r in QUERIES["similar_benchmark"](spark, str(tmp_path)).collect()}
    assert got == {(f"{d}.1", i) for d in (1, 2, 3) for i in ("7", "8")}
