"""Chroma audio fingerprints and their search.

A recording's spectrum is folded to twelve pitch classes per frame. Sixteen rectangle filters, summed by an integral
image over (frame, pitch class), compare parts of a window of frames; each comparison is cut at three levels, two bits in
Gray code, so a window packs into one 32-bit integer. Two recordings are aligned by a histogram of the offsets at which
they hold equal integers; the share of differing bits over the overlap at the best offset decides.

Search: the recordings whose id is divisible by `every` are the queries, against all others. Queries go in blocks, all
recordings in buckets; every (block, bucket) pair is one group of bounded size, whatever the data hold, and returns a
row per query. A recording that thousands share costs its pairs inside numpy, and no row of them is shuffled.

Defined results: null, empty or too short audio has no integers and matches nothing; an odd last byte is ignored;
repeated rows each get a row and match each other; a null id is no query; extra columns are ignored; an empty table
gives an empty result. Equal bit errors: the smallest other id wins; a match
without an id counts, and as the best one has id null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import common

common.ship(__name__)

RATE = 8_000
FRAME, HOP, SPAN = 1024, 400, 16
LEVEL = 0.06
#: Filters: kind, first pitch class, pitch classes, frames.
FILTERS = [(k % 5, (5 * k) % (13 - h), h, 4 * (1 + k % 4)) for k, h in ((k, (12, 4, 6, 8)[(k // 4 + k) % 4]) for k in range(16))]
#: A pair aligns with so many equal integers at one offset, so long an overlap there, and at most that share of bit errors.
MIN_VOTES, MIN_OVERLAP, MAX_ERROR = 4, 40, 0.25
BLOCK, BUCKET = 4_096, 2_000


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12): spectral magnitude by pitch class from 80 to 2,000 Hz, each frame of length one."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    size = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1))
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = np.flatnonzero((hertz >= 80) & (hertz <= 2_000))
    fold = np.zeros((len(hertz), 12), dtype=np.float32)
    fold[heard, np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12] = 1
    out = size @ fold
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def integers(image: np.ndarray) -> np.ndarray:
    """One uint32 per window of SPAN frames."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[at + t1, p1] - total[at + t0, p1] - total[at + t1, p0] + total[at + t0, p0]

    out = np.zeros(n, dtype=np.uint32)
    for kind, p, h, w in FILTERS:
        whole = area(0, w, p, p + h)
        if kind == 0:  # later half of the frames
            part = area(w // 2, w, p, p + h)
        elif kind == 1:  # upper half of the pitch classes
            part = area(0, w, p + h // 2, p + h)
        elif kind == 2:  # two opposite quarters
            part = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
        elif kind == 3:  # the middle frames
            part = area(w // 4, w - w // 4, p, p + h)
        else:  # the middle pitch classes
            part = area(0, w, p + h // 4, p + h - h // 4)
        x = np.log((1 + part) / (1 + whole - part))
        level = (x > -LEVEL).astype(np.uint32) + (x > 0) + (x > LEVEL)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)
    return out


def fingerprint(pcm: bytes | None, rate: int | None) -> bytes:
    """The integers of 16-bit little-endian mono sound, as little-endian bytes."""
    if not pcm or not rate:
        return b""
    return integers(chroma(np.frombuffer(pcm[: len(pcm) // 2 * 2], dtype="<i2"), rate)).astype("<u4").tobytes()


def fingerprint_audio(media: DataFrame, id_col: str = "media_id", pcm_col: str = "pcm", rate_col: str = "sample_rate") -> DataFrame:
    """id, fingerprint (binary, 32-bit little-endian integers), n_integers, serial (the row's own number).

    A worker holds one Arrow batch of sounds: spark.sql.execution.arrow.maxRecordsPerBatch is to fit their size.
    """

    @F.pandas_udf("binary")
    def prints(pcm: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(p, r) for p, r in zip(pcm, rate, strict=True)], dtype=object)

    out = media.select(F.col(id_col), prints(F.col(pcm_col), F.col(rate_col)).alias("fingerprint"))
    return out.withColumns({"n_integers": (F.length("fingerprint") / 4).cast("long"), "serial": F.monotonically_increasing_id()})


def stacked(prints: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as rows of one matrix, padded with zeros, and their lengths."""
    sizes = np.array([len(p) // 4 for p in prints], dtype=np.int64)
    out = np.zeros((len(prints), max(1, int(sizes.max(initial=1)))), dtype=np.uint32)
    for k, p in enumerate(prints):
        out[k, : sizes[k]] = np.frombuffer(p, dtype="<u4")
    return out, sizes


def alignments(queries: list[bytes], others: list[bytes], min_votes: int, min_overlap: int, max_error: float, part: int = 64) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, other, offset, error) of the pairs that align. Offset: frames by which the other's sound comes later."""
    q, q_size = stacked(queries)
    row, place = np.nonzero(np.arange(q.shape[1]) < q_size[:, None])
    value = q[row, place]
    order = np.argsort(value, kind="stable")
    value, row, place = value[order], row[order], place[order]
    for at in range(0, len(others), part):
        o, o_size = stacked(others[at : at + part])
        o_row, o_place = np.nonzero(np.arange(o.shape[1]) < o_size[:, None])
        wanted = o[o_row, o_place]
        first, last = np.searchsorted(value, wanted, "left"), np.searchsorted(value, wanted, "right")
        n = last - first
        if not n.sum():
            continue
        mine = np.repeat(np.arange(len(wanted)), n)
        hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        offset = o_place[mine] - place[hit]
        span = q.shape[1] + o.shape[1]
        cell = (row[hit] * part + o_row[mine]) * (2 * span) + offset + span
        cells, votes = np.unique(cell, return_counts=True)
        cells, votes = cells[votes >= min_votes], votes[votes >= min_votes]
        pair, shift = cells // (2 * span), cells % (2 * span) - span
        best = np.lexsort((shift, -votes, pair))
        best = best[np.unique(pair[best], return_index=True)[1]]
        for s in np.unique(shift[best]):
            own = best[shift[best] == s]
            a, b = pair[own] // part, pair[own] % part
            q0, o0 = max(0, -s), max(0, s)
            width = min(q.shape[1] - q0, o.shape[1] - o0)
            inside = np.minimum(q_size[a] - q0, o_size[b] - o0)
            differ = np.bitwise_count(q[a, q0 : q0 + width] ^ o[b, o0 : o0 + width]).astype(np.int64)
            error = (differ * (np.arange(width) < inside[:, None])).sum(axis=1) / (32 * np.maximum(1, inside))
            fits = (error <= max_error) & (inside >= min_overlap)
            yield a[fits], at + b[fits], np.full(fits.sum(), s), error[fits]


def search(prints: DataFrame, is_query: Column, id_col: str = "media_id", min_votes: int = MIN_VOTES, min_overlap: int = MIN_OVERLAP, max_error: float = MAX_ERROR) -> DataFrame:
    """One row per query: id, n_integers, n_matches (other recordings that align), best_id, best_offset, best_error.

    prints: id, fingerprint and serial, as of fingerprint_audio, read from a table: it is used several times. A row is
    told by its serial, so rows with one id are recordings of their own.
    """
    kind = prints.schema[id_col].dataType.simpleString()
    rows = prints.select("serial", F.col(id_col).cast("string").alias("id"), F.coalesce(F.col("fingerprint"), F.lit(b"")).alias("print"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("asking")).first()
    buckets, blocks = max(1, -(-counts.n // BUCKET)), max(1, -(-counts.asking // BLOCK))
    spread = F.xxhash64("serial")
    queries = rows.where("asks").withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
    left = queries.select("block", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "serial", "id", "print")
    right = rows.withColumn("bucket", F.pmod(spread, F.lit(buckets)).cast("int")).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "bucket", "serial", "id", "print")

    def align(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        ids, others = asking["id"].tolist(), held["id"].to_numpy(dtype=object)
        serials, held_serials = asking["serial"].tolist(), held["serial"].tolist()
        found = np.zeros(len(ids), dtype=np.int64)
        best: list[tuple | None] = [None] * len(ids)
        for a, b, shift, error in alignments(asking["print"].tolist(), held["print"].tolist(), min_votes, min_overlap, max_error):
            for k, j, s, e in zip(a.tolist(), b.tolist(), shift.tolist(), error.tolist(), strict=True):
                if held_serials[j] == serials[k]:
                    continue
                found[k] += 1
                other = others[j] or ""
                rank = (round(e, 9), len(other), other, s)
                if best[k] is None or rank < best[k]:
                    best[k] = rank
        return pd.DataFrame({"serial": serials, "id": pd.Series(ids, dtype=object), "n_integers": [len(p) // 4 for p in asking["print"]], "n_matches": found, "best_error": [b[0] if b else None for b in best], "best_id": pd.Series([b[2] if b else None for b in best], dtype=object), "best_offset": [b[3] if b else None for b in best]}).astype({"serial": "int64", "n_integers": "int64", "best_error": "float64", "best_offset": "Int64"})

    parts = left.groupBy("block", "bucket").cogroup(right.groupBy("block", "bucket")).applyInPandas(align, "serial long, id string, n_integers long, n_matches long, best_error double, best_id string, best_offset long")
    rank = F.when(F.col("best_error").isNotNull(), F.struct("best_error", F.length("best_id").alias("l"), "best_id", "best_offset"))
    out = parts.groupBy("serial", "id").agg(F.max("n_integers").alias("n_integers"), F.sum("n_matches").alias("n_matches"), F.min(rank).alias("b"))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_integers", "n_matches", F.nullif(F.col("b.best_id"), F.lit("")).cast(kind).alias("best_id"), F.col("b.best_offset").alias("best_offset"), F.col("b.best_error").alias("best_error"))


def tone_table(note: int) -> np.ndarray:
    """Twelve tones of `note` samples, a semitone apart, faded at both ends."""
    t = np.arange(note) / RATE
    fade = np.minimum(1, np.minimum(np.arange(note), note - 1 - np.arange(note)) / 40)
    return np.stack([12_000 * fade * (np.sin(2 * np.pi * f * t) + 0.4 * np.sin(4 * np.pi * f * t)) for f in 220 * 2 ** (np.arange(12) / 12)]).astype("<i2")


def render(vector: list[float] | None, tones: np.ndarray) -> bytes:
    """A tone for each component of a vector: its twelfth of [-0.4, 0.4] is the pitch class."""
    x = np.nan_to_num(np.array([c if c is not None else 0 for c in vector] if vector is not None else [], dtype=np.float64))
    return tones[np.clip((x + 0.4) / 0.8 * 12, 0, 11).astype(int)].tobytes()


def fingerprint_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", note: int = 800) -> DataFrame:
    """Fingerprints of the sounds that the vectors stand for, for no given table has sound: media_id, fingerprint, serial.

    A vector's sound lives in its task alone, one at a time: a hundred kilobytes each, it is neither sent nor stored.
    """

    @F.pandas_udf("binary")
    def prints(series: pd.Series) -> pd.Series:
        tones = tone_table(note)
        return pd.Series([fingerprint(render(v, tones), RATE) for v in series], dtype=object)

    return vectors.select(F.col(id_col).alias("media_id"), prints(F.col(vector_col)).alias("fingerprint"), F.monotonically_increasing_id().alias("serial"))


def op9_chroma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = common.materialize(fingerprint_vectors(common.table(spark, sf_dir, "embeddings")), "prints")
    return search(prints, F.col("media_id") % 20 == 0).withColumnRenamed("media_id", "vec_id")
