"""Vector codes and centroid clusters against loops and SQL: null and odd vectors, ties, repeated rows, empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillworks.llm import centroids, codebooks, common, vectors

from tests.compare import same_rows

SF = "/root/testdata/sf0.001"
TABLE = "vec_id long, embedding array<double>, label int"


def d2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(x, entries):
    return min((d2(x, e), k) for k, e in enumerate(entries))


def refined(points, entries, rounds):
    """Plain rounds of assignment and floor means."""
    for _ in range(rounds):
        groups = [[] for _ in entries]
        for x in points:
            groups[nearest(x, entries)[1]].append(x)
        entries = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(groups, entries, strict=True)]
    return entries


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [refined([cut(v, p) for _, v, _ in kept], [cut(v, p) for _, v, _ in kept[:entries]], rounds) for p in range(parts)]
    found = [(i, [nearest(cut(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    total = {}
    for _, f, label in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[label], digest)) for i, f, label in found)


def plain_clusters(rows, n=40, rounds=5, scale=256):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = refined([v for _, v in kept], [v for _, v in kept[:n]], rounds)
    found = [(i, *nearest(v, cents)) for i, v in kept]
    inertia = {}
    for _, d, k in found:
        inertia[k] = inertia.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(repr((i, k, d, inertia[k], sum(inertia.values()), digest[k])) for i, d, k in found)


def odd_rows(seed=5, n=90):
    """Near and equal vectors, ties on a coarse grid, odd values, repeated rows and ids."""
    rng = random.Random(seed)
    base = [[rng.choice([-0.5, -0.25, 0.0, 0.25]) for _ in range(64)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = [c + rng.choice([0.0, 0.0, 1 / 256, -1 / 256, rng.gauss(0, 0.1)]) for c in rng.choice(base)]
        rows.append((i * 7 % n, v, rng.choice([None, 1, 2, 3])))
    rows += [rows[0], rows[0], (3, [0.125] * 64, 1), (None, [0.5] * 64, None), (500, [70_000.0 * (k % 3 - 1) for k in range(64)], 2), (501, [-0.0] * 64, 3)]
    return rows + [(600, None, 1), (601, [None] + [0.1] * 63, 1), (602, [float("nan")] * 64, 1), (603, [float("inf")] + [0.1] * 63, 1)]


def code_rows(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(repr(tuple(r)) for r in df.collect())


def cluster_rows(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    extra = spark.createDataFrame(odd_rows(), TABLE).repartition(3)
    for name in ("id", "v", "code", "error", "cluster", "known", "sum_label"):
        extra = extra.withColumn(name, F.lit("clash"))
    return common.materialize(extra, "vectors")


def test_codes_equal_plain_rounds(table):
    assert code_rows(codebooks.compress(table)) == plain_codes(odd_rows())


def test_clusters_equal_plain_rounds(table):
    assert cluster_rows(centroids.cluster(table)) == plain_clusters(odd_rows())


@pytest.mark.parametrize("name,query,sql", [("op12", codebooks.op12_vector_codes, codebooks.op12_sql()), ("op13", centroids.op13_centroid_clusters, centroids.op13_sql())])
def test_queries_match_sql(spark, name, query, sql):
    same_rows(query(spark, SF), sql, SF)


def test_few_rows_and_none(spark):
    few = [(i, [0.01 * i * (k % 5) for k in range(64)], None) for i in range(5)]
    small = spark.createDataFrame(few, TABLE)
    assert code_rows(codebooks.compress(small)) == plain_codes(few)
    assert cluster_rows(centroids.cluster(small)) == plain_clusters(few)
    none = spark.createDataFrame([], TABLE)
    assert code_rows(codebooks.compress(none)) == [] and cluster_rows(centroids.cluster(none)) == []
    odd = spark.createDataFrame([(1, None, 1), (2, [float("nan")] * 64, 1)], TABLE)
    assert code_rows(codebooks.compress(odd)) == [] and cluster_rows(centroids.cluster(odd)) == []


def test_other_lengths(spark):
    """Clusters take 64 components only; codes take the width of the least id, and others keep a row without a code."""
    rows = [(i, [0.1 * i + 0.01 * k for k in range(16)], 1) for i in range(4)] + [(9, [0.5] * 64, 1), (8, [0.5] * 3, None), (7, [], 2)]
    made = spark.createDataFrame(rows, TABLE)
    got = {r.vec_id: r for r in codebooks.compress(made).collect()}
    assert sorted(got) == [0, 1, 2, 3, 7, 8, 9]
    assert [got[i].code for i in (7, 8, 9)] == [None] * 3 and got[9].label_error == got[0].label_error == 0
    assert [r.vec_id for r in centroids.cluster(made).collect()] == [9]


def test_values_beyond_64_bits(spark):
    """Squares and sums that no 64 bits hold are exact; results beyond a long are its greatest value or null."""
    rows = [(i, [float((i % 3 - 1) * 2**30 + k) for k in range(64)], 1) for i in range(50)]
    made = spark.createDataFrame(rows, TABLE)
    longest = 2**63 - 1
    want = [eval(r) for r in plain_clusters(rows, scale=256)]
    got = sorted(centroids.cluster(made).collect())
    assert [(r.vec_id, r.cluster, r.distance) for r in got] == sorted((w[0], w[1], min(w[2], longest)) for w in want)
    assert code_rows(codebooks.compress(spark.createDataFrame([(1, [1e308] * 64, 1), (2, [-1e308] * 64, 1)], TABLE)))


@pytest.mark.parametrize("entries,width", [(1, 3), (2, 1), (16, 8), (40, 5)])
def test_orchard_search(entries, width):
    rng = np.random.default_rng(entries)
    for spread in (2, 50, 10**9):
        book = rng.integers(-spread, spread, (entries, width))
        x = rng.integers(-spread, spread, (200, width))
        book, x = (book.astype(object), x.astype(object)) if spread > vectors.NARROW else (book, x)
        found, d = codebooks.Orchard(book).nearest(x)
        assert [(int(b), int(a)) for a, b in zip(found, d, strict=True)] == [nearest(list(map(int, r)), book.tolist()) for r in x]


def test_orchard_stops_early():
    """Entries of far groups are never measured: the lists end at twice the current distance."""
    book = np.array([[k // 4 * 10_000 + k % 4, 0] for k in range(16)])
    orchard = codebooks.Orchard(book)
    orchard.guess = lambda x: np.full(len(x), 3)
    # a measurement of one of these would raise
    orchard.entries = np.array([list(map(int, e)) if k < 4 else [None, None] for k, e in enumerate(book)], dtype=object)
    found, _ = orchard.nearest(np.array([[0, 1], [1, -1], [2, 0], [9, 9]], dtype=object))
    assert found.tolist() == [0, 1, 2, 3]


def test_progressive_search():
    rng = np.random.default_rng(3)
    for spread in (2, 60, 10**8):
        cents, x = (rng.integers(-spread, spread, (n, 64)) for n in (40, 150))
        x[:40] = cents
        found, d = centroids.nearest(x, cents.astype(object) if spread > vectors.NARROW else cents)
        assert [(int(b), int(a)) for a, b in zip(found, d, strict=True)] == [nearest(list(map(int, r)), cents.tolist()) for r in x]


def test_transform_is_hadamard():
    x = np.random.default_rng(1).integers(-9, 9, (3, 8))
    signs = np.array([[(-1) ** ((i & j).bit_count()) for j in range(8)] for i in range(8)])
    order = sorted(range(8), key=lambda i: (int((signs[i][1:] != signs[i][:-1]).sum()), i))
    assert (centroids.transform(x) == (x @ signs.T)[:, order]).all()
    assert ((centroids.transform(x) ** 2).sum(axis=1) == 8 * (x**2).sum(axis=1)).all()


def test_batches_without_finite_vectors(spark):
    """Tasks that hold none but odd vectors, and whole numbers as vectors."""
    rows = [(i, [math.nan] * 64, 1) for i in range(40)] + [(i, [float(i % 7)] * 64, 1) for i in range(100, 110)]
    made = spark.createDataFrame(rows, TABLE).repartitionByRange(4, "vec_id")
    assert code_rows(codebooks.compress(made)) == plain_codes(rows)
    assert cluster_rows(centroids.cluster(made)) == plain_clusters(rows)
    ints = spark.createDataFrame(rows[40:], TABLE).withColumn("embedding", F.col("embedding").cast("array<int>"))
    assert code_rows(codebooks.compress(ints)) == plain_codes(rows)


def test_groupings_agree(table):
    one, many = (sorted(map(tuple, centroids.cluster(table.repartition(n)).collect()), key=repr) for n in (1, 7))
    assert one == many
