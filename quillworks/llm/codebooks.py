"""Vector code compression: product codes whose nearest entries are found by orchard search.

A vector of whole numbers is cut into equal consecutive parts; each part position has a codebook, and a vector's code
names the nearest entry of each. Codebooks are fitted to all vectors by rounds of assignment and exact floor means.

The search: every entry keeps all entries of its codebook sorted by their distance from it. From a first guess it reads
the guess's list; an entry that is nearer (or as near, with a lower index) becomes the current one, and its list is
read from the start; entries met before are marked and not measured again. It ends where the list goes beyond twice the
current distance: by the triangle inequality nothing later is nearer, and what is as near lies at most at twice that
distance, so ties are exact as well. All vectors of an Arrow batch take their steps together.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped. The width is that of
the kept vector with the least id whose length is a positive multiple of the number of parts; vectors of other lengths
keep their row, with null code and error. Equal ids are ordered by their vectors, null ids come last. With fewer kept
vectors than entries the codebooks are that much shorter. Repeated rows each get a row. Components whose whole number is
beyond 2**40 count as that; errors beyond a long become the greatest long, label sums beyond it null. Extra columns are
ignored; an empty table gives an empty result.
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

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Label sums are broadcast up to this many labels, and joined by a shuffle beyond.
BROADCAST_LABELS = 200_000


class Orchard:
    """The entries of one codebook, each with the others by their distance from it."""

    def __init__(self, entries: np.ndarray):
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.entries = entries
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, axis=1)
        self.by_sum = np.argsort(entries.sum(axis=1), kind="stable")

    def guess(self, x: np.ndarray) -> np.ndarray:
        """A first entry for each row: one whose components have about the same sum."""
        at = np.searchsorted(self.entries.sum(axis=1)[self.by_sum], x.sum(axis=1))
        return self.by_sum[np.minimum(at, len(self.entries) - 1)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for each row of x; of equal ones the lowest index."""
        x, entries = vectors.common_kind(x, self.entries)
        now = self.guess(x)
        best = ((x - entries[now]) ** 2).sum(axis=1)
        met = np.zeros((len(x), len(entries)), dtype=bool)
        met[np.arange(len(x)), now] = True
        place = np.zeros(len(x), dtype=np.int64)
        live = np.arange(len(x))
        while len(live):
            within = self.apart[now[live], place[live]] <= 4 * best[live]
            live = live[within.astype(bool)]
            other = self.near[now[live], place[live]]
            place[live] += 1
            fresh = ~met[live, other]
            row, other = live[fresh], other[fresh]
            met[row, other] = True
            d = ((x[row] - entries[other]) ** 2).sum(axis=1)
            better = ((d < best[row]) | ((d == best[row]) & (other < now[row]))).astype(bool)
            row, other = row[better], other[better]
            now[row], best[row], place[row] = other, d[better], 0
            live = live[place[live] < len(entries)]
        return now, best


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def fit(rows: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """Codebooks of each part position. rows: column v, vectors as long as those of `first`, the first entries; those
    that are not finite do not count."""
    books, width = cut(first, parts), first.shape[1] // parts
    for _ in range(rounds):
        orchards = [Orchard(b) for b in books]

        def assigned(column: pa.Array, orchards: list[Orchard] = orchards) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for p, x in enumerate(cut(vectors.matrix(column, scale, width * parts)[0], parts)):
                yield p * len(first) + orchards[p].nearest(x)[0], x

        totals, counts = vectors.task_sums(rows, assigned, parts * len(first), width)
        books = [vectors.floor_means(b, t, n) for b, t, n in zip(books, np.split(totals, parts), np.split(counts, parts), strict=True)]
    return books


def encoded(rows: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """rows (v and others): the others with code and error in place of v, for finite vectors."""
    parts, width = len(books), books[0].shape[1]
    others = [f for f in rows.schema if f.name != "v"]
    orchards = [Orchard(b) for b in books]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, finite = vectors.matrix(batch.column(batch.schema.get_field_index("v")), scale, width * parts)
            if not len(whole):
                continue
            batch, pieces = batch.filter(pa.array(finite)), cut(whole, parts)
            found = [o.nearest(x) for o, x in zip(orchards, pieces, strict=True)]
            digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in others), codes, vectors.longs(sum(f[1] for f in found))], [*(f.name for f in others), "code", "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "code string, error long"])
    return rows.mapInArrow(encode, schema)


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vectors.number_col(table, vector_col).alias("v"))
    finite, by_id = vectors.finite_col(F.col("v")), [F.col("id").asc_nulls_last(), "v"]
    fits = (F.size("v") > 0) & (F.size("v") % parts == 0)
    least = rows.where(fits & finite).orderBy(*by_id).select(F.size("v").alias("n")).limit(1).collect()
    digest, width = hashlib.sha256(b"").hexdigest(), least[0].n if least else -1
    coded = rows.where(finite & (F.size("v") != width)).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if least:
        same = rows.where(F.size("v") == width)
        first = same.where(finite).orderBy(*by_id).select("v").limit(entries).collect()
        books = fit(same, vectors.whole(np.array([r.v for r in first]), scale), parts, rounds, scale)
        digest = hashlib.sha256(vectors.comma_joined(np.stack([b.astype(object) for b in books])).encode()).hexdigest()
        coded = encoded(same, books, scale).union(coded)
    coded = common.materialize(coded, "codes")
    sums = common.materialize(coded.groupBy(F.col("label").alias("sum_label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    joined = coded.join(F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums, F.col("label").eqNullSafe(F.col("sum_label")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(common.table(spark, sf_dir, "embeddings"))


SQUARED = "CAST(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def op12_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rounds as SQL: every part is compared with every entry."""
    part = f"v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})]"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"pieces AS MATERIALIZED (SELECT vec_id, label, p, {part} AS x FROM kept, range({parts}) r(p))",
        f"ranked AS (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries})",
        f"c0 AS MATERIALIZED (SELECT p, e, {part} AS y FROM ranked, range({parts}) r(p))",
    ]
    for k in range(rounds + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT vec_id, label, p, x, min(struct_pack(d := {SQUARED}, e := e)) AS best FROM pieces JOIN c{k} USING (p) GROUP BY vec_id, label, p, x)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT p, best.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM d{k}, (SELECT unnest(range(1, len(x) + 1)) AS i FROM (SELECT x FROM pieces LIMIT 1)) GROUP BY ALL)")
            steps.append(f"m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM s{k} GROUP BY p, e)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.y, c{k}.y) AS y FROM c{k} LEFT JOIN m{k} USING (p, e))")
    steps.append(f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM d{rounds} GROUP BY vec_id)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, digest"
