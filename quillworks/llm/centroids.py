"""Centroid clustering with progressive search in the Walsh-Hadamard domain.

Vectors of 64 whole numbers and their centroids go through the exact integer transform; squared coefficient differences
add up to 64 times the squared distance. They are accumulated from coarse (few sign changes) to fine: after the first
few the most likely centroid of each vector is measured in full, which bounds its distance; a centroid whose partial sum
is beyond the bound is strictly worse and goes; those left over finish all 64 coefficients, so distances and ties are
exact.

Defined results: only vectors of exactly 64 components, none null, NaN or infinite, are kept; others have no row.
Repeated rows each count and get a row; equal ids are ordered by their vectors; a null id is hashed as the empty text.
With fewer kept vectors than centroids there are as many centroids as vectors. Components whose whole number is beyond
2**40 count as that; distances beyond a long become the greatest long, sums beyond it null. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import common, vectors

common.ship(__name__)

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
#: Where the levels of the search begin, in coefficients from coarse to fine.
LEVELS = (0, 4, 12, 28, WIDTH)
#: Rows of a batch that are searched together.
BLOCK = 4_096


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (of a power of two in length), fewest sign changes first."""
    n, step = x.shape[1], 1
    while step < n:
        halves = x.reshape(len(x), -1, 2, step)
        a, b = halves[:, :, 0], halves[:, :, 1]
        x, step = np.stack([a + b, a - b], axis=2).reshape(len(x), n), 2 * step
    return x[:, by_changes(n)]


def by_changes(n: int) -> np.ndarray:
    """The rows of the transform's matrix in order of their sign changes."""
    signs = np.array([[(i & j).bit_count() & 1 for j in range(n)] for i in range(n)])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def nearest(x: np.ndarray, centroids: np.ndarray, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid for each row of x; of equal ones the smaller number."""
    x, centroids = vectors.common_kind(x, centroids)
    fine, known = transform(x), transform(centroids)
    coarse = ((fine[:, None, : levels[1]] - known[None, :, : levels[1]]) ** 2).sum(axis=2)
    bound = ((fine - known[coarse.argmin(axis=1)]) ** 2).sum(axis=1)
    row, c = np.nonzero((coarse <= bound[:, None]).astype(bool))
    total = coarse[row, c]
    for low, high in zip(levels[1:-1], levels[2:], strict=True):
        total = total + ((fine[row, low:high] - known[c, low:high]) ** 2).sum(axis=1)
        stays = (total <= bound[row]).astype(bool)
        row, c, total = row[stays], c[stays], total[stays]
    # rows are in order, and so are the centroids of a row: the first of the least ones counts
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, starts)
    at = np.flatnonzero((total == least[np.cumsum(np.diff(row, prepend=-1) != 0) - 1]).astype(bool))
    first = at[np.flatnonzero(np.diff(row[at], prepend=-1))]
    return c[first], least // x.shape[1]


def searched(whole: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors, centroid numbers and squared distances, block by block."""
    for at in range(0, len(whole), BLOCK):
        x = whole[at : at + BLOCK]
        yield x, *nearest(x, centroids)


def fit(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Centroids after some rounds of assignment and floor means. rows: column v, all as long as the centroids; those
    that are not finite do not count."""
    for _ in range(rounds):

        def assigned(column: pa.Array, now: np.ndarray = centroids) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for x, c, _ in searched(vectors.matrix(column, scale, now.shape[1])[0], now):
                yield c, x

        centroids = vectors.floor_means(centroids, *vectors.task_sums(rows, assigned, len(centroids), centroids.shape[1]))
    return centroids


def clustered(rows: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """rows (id, v): id, cluster, distance of the finite vectors."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, finite = vectors.matrix(batch.column(1), scale, centroids.shape[1])
            if len(whole):
                found = [(c, d) for _, c, d in searched(whole, centroids)]
                c, d = (np.concatenate(part) for part in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(finite)), pa.array(c, pa.int32()), vectors.longs(d)], ["id", "cluster", "distance"])

    return rows.select("id", "v").mapInArrow(assign, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", n_centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = table.where(F.size(vector_col) == WIDTH).select(F.col(id_col).alias("id"), vectors.number_col(table, vector_col).alias("v"))
    place = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r.v for r in rows.where(vectors.finite_col(F.col("v"))).orderBy(place, "v").select("v").limit(n_centroids).collect()]
    centroids = fit(rows, vectors.whole(np.array(first), scale), rounds, scale) if first else np.zeros((0, WIDTH), dtype=np.int64)
    found = common.materialize(clustered(rows, centroids, scale), "clusters")
    # one row for each centroid: a bound, whatever the table's size
    sums = {r.cluster: int(r.n) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    as_long = lambda n: n if n <= vectors.LONGEST else None
    hashes = [hashlib.sha256(vectors.comma_joined(c).encode()).hexdigest() for c in centroids]
    known = [(k, as_long(sums[k]), as_long(sum(sums.values())), hashes[k]) for k in sorted(sums)]
    totals = table.sparkSession.createDataFrame(known, "known int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(totals), F.col("cluster") == F.col("known"))
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings"))


def op13_sql(n_centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rounds as SQL: every vector is compared with every centroid."""
    squared = "CAST(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS e, x AS y FROM kept QUALIFY e < {n_centroids})",
    ]
    for k in range(rounds + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(struct_pack(d := {squared}, e := e)) AS best FROM kept, c{k} GROUP BY vec_id)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT best.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM d{k}, range(1, {WIDTH + 1}) r(i) GROUP BY ALL)")
            steps.append(f"m{k} AS (SELECT e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM s{k} GROUP BY e)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT e, coalesce(m{k}.y, c{k}.y) AS y FROM c{k} LEFT JOIN m{k} USING (e))")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(best.e AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.e) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256 FROM d{rounds} JOIN c{rounds} ON e = best.e"""
