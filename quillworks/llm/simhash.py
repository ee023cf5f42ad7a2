"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits, each the majority of that bit over the hashes of a text's three-word shingles. Two fingerprints
link if they differ in at most `threshold` bits. Anchors are the words of a covering code: two blocks of 23 bits in the
perfect Golay code (covering radius 3), for large corpora a third block of 15 bits in the perfect Hamming code (radius
1). A fingerprint's home is the one anchor within the radius in every block. If y differs from x in t_i bits of block i,
y lies within radius + t_i of x's home there; so y is replicated to every anchor within radius + t_i for some t_1 + t_2
(+ t_3) <= threshold, and meets x at x's home. All meetings are compared bit by bit: no link is missed, none is false.
About 60 replicas of a fingerprint with two blocks, whatever the corpus; equal fingerprints count once.

Defined results: a null or empty text has fingerprint zero, linked like any other; repeated rows share a fingerprint and
a component; the component id is the smallest id that is not null; extra columns are ignored by link_documents and
passed on by keep_documents; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillworks.llm import common
from quillworks.llm.common import give_back, worker_cache, worker_state
from quillworks.llm.components import components

common.ship(__name__)

SEED = 42
SHINGLE = 3
#: With more distinct fingerprints than this a third block makes anchors finer; the links are the same.
TWO_BLOCKS_MOST = 20_000_000
PART = 1 << 18
#: Distinct fingerprints to a task that replicates them: each makes about 60 rows.
TASK_PRINTS = 20_000


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text, unsigned."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest, last = xxhash.xxh64_intdigest, min(size, len(words)) - 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PART):
        hashes = np.array([digest(line[starts[i] : ends[i + last] - 1], seed) for i in range(at, min(n, at + PART))], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, row_hash, text to doc, row_hash, fp. One text at a time is a Python string; what earlier stages keep is dropped."""
    worker_cache("fingerprints", dict)
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py() or "") for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc", "row_hash", "fp"])
        del batch
        give_back()
    give_back()


class Block:
    """A perfect code of `length` bits given by its generator polynomial; words are info bits, then the remainder."""

    def __init__(self, length: int, polynomial: int, radius: int, threshold: int):
        self.length, self.check = length, polynomial.bit_length() - 1
        self.polynomial = polynomial
        patterns: dict[int, list[tuple[int, int]]] = {}
        for weight in range(radius + threshold + 1):
            for bits in itertools.combinations(range(length), weight):
                e = sum(1 << b for b in bits)
                patterns.setdefault(self.remainder(e), []).append((max(0, weight - radius), e))
        most = max(map(len, patterns.values()))
        #: By remainder: the changes that lead to an anchor, nearest first, and how far beyond the radius it lies.
        self.changes = np.zeros((1 << self.check, most), dtype=np.int64)
        self.excess = np.full((1 << self.check, most), 99, dtype=np.int8)
        for s, found in patterns.items():
            self.changes[s, : len(found)] = [e for _, e in found]
            self.excess[s, : len(found)] = [x for x, _ in found]
        self.by_bit = np.array([self.remainder(1 << b) for b in range(length)], dtype=np.int64)

    def remainder(self, word: int) -> int:
        for b in range(word.bit_length() - 1, self.check - 1, -1):
            if word >> b & 1:
                word ^= self.polynomial << (b - self.check)
        return word

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int64)
        for b in range(self.length):
            out ^= np.where(words >> b & 1, self.by_bit[b], 0)
        return out


class Covering:
    """Anchors over the low bits of a fingerprint, block after block."""

    #: Generator polynomials of the perfect binary Golay code of 23 bits and the Hamming code of 15 bits.
    GOLAY, HAMMING = (23, 0b101011100011, 3), (15, 0b10011, 1)

    def __init__(self, blocks: int, threshold: int):
        self.threshold = threshold
        kinds = [self.GOLAY, self.GOLAY, self.HAMMING][:blocks]
        made = {k: Block(*k, threshold) for k in set(kinds)}
        self.blocks = [made[k] for k in kinds]

    def parts(self, fingerprints: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for block in self.blocks:
            out.append(fingerprints >> at & ((1 << block.length) - 1))
            at += block.length
        return out

    def homes(self, fingerprints: np.ndarray) -> np.ndarray:
        key = np.zeros(len(fingerprints), dtype=np.int64)
        for block, words in zip(self.blocks, self.parts(fingerprints), strict=True):
            key = key << (block.length - block.check) | (words ^ block.changes[block.syndromes(words), 0]) >> block.check
        return key

    def replicas(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and anchors, every pair once."""
        row, key, over = np.arange(len(fingerprints)), np.zeros(len(fingerprints), dtype=np.int64), np.zeros(len(fingerprints), dtype=np.int64)
        for block, words in zip(self.blocks, self.parts(fingerprints), strict=True):
            s = block.syndromes(words)[row]
            fits = over[:, None] + block.excess[s] <= self.threshold
            i, j = np.nonzero(fits)
            anchor = (words[row[i]] ^ block.changes[s[i], j]) >> block.check
            row, key, over = row[i], key[i] << (block.length - block.check) | anchor, over[i] + block.excess[s[i], j]
        return row, key


def links(distinct: DataFrame, threshold: int = 2, blocks: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most `threshold` bits."""

    def covering() -> Covering:
        state = worker_state()
        if ("covering", blocks, threshold) not in state:
            state["covering", blocks, threshold] = Covering(blocks, threshold)
        return state["covering", blocks, threshold]

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"anchor": covering().homes(batch["fp"].to_numpy()), "a": batch["fp"]})

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for at in range(0, len(fps), 2_000):
                row, key = covering().replicas(fps[at : at + 2_000])
                yield pd.DataFrame({"near": key, "b": fps[at : at + 2_000][row]})

    home = distinct.select("fp").mapInPandas(at_home, "anchor long, a long")
    near = distinct.select("fp").mapInPandas(replicate, "near long, b long")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # Spark takes 60 replicas of a row for one row, and would send them all through the driver as a small table
    return home.join(near.hint("merge"), (F.col("anchor") == F.col("near")) & close).select("a", "b")


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row_hash, fp. A UDF's rows would wait for its answers in the executor with their texts; these go by once."""
    rows = docs.select(F.col(id_col).alias("doc"), common.row_hash(docs).alias("row_hash"), F.col(text_col).alias("text"))
    schema = StructType([StructField("doc", rows.schema["doc"].dataType), StructField("row_hash", LongType()), StructField("fp", LongType())])
    return rows.mapInArrow(with_fingerprints, schema)


def fingerprinted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row_hash, fp: written once, for fingerprints are the costly part."""
    return common.materialize(fingerprint_rows(docs, id_col, text_col), "fingerprints")


def classes(fps: DataFrame, threshold: int = 2, two_blocks_most: int = TWO_BLOCKS_MOST) -> DataFrame:
    """fp, root: each distinct fingerprint and the smallest one it is linked with, in one or more steps."""
    distinct = common.materialize(fps.select("fp").distinct(), "distinct")
    n = distinct.count()
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_PRINTS)
    found = components(links(distinct.repartition(tasks), threshold, 2 if n <= two_blocks_most else 3))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id of its component).

    A fingerprint held by a third of all documents is one row until the last join, and that join may be split.
    """
    fps = fingerprinted(docs, id_col, text_col)
    root = common.materialize(classes(fps, threshold), "classes")
    smallest = fps.groupBy("fp").agg(F.min("doc").alias("smallest"))
    ids = root.join(smallest, "fp")
    ids = common.materialize(ids.join(ids.groupBy("root").agg(F.min("smallest").alias("component_id")), "root").select(F.col("fp").alias("known"), "component_id"), "components")
    out = fps.join(ids, fps.fp == ids.known)
    return out.select(F.col("doc").alias(id_col), hex_column(F.col("fp")).alias("fingerprint"), "component_id")


def hex_column(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """The documents, with all their columns, that come first (smallest id, then row hash) in their component.

    The texts are shuffled once: the last step deals by the same keys as the join.
    """
    fps = fingerprinted(docs, id_col, text_col)
    root = classes(fps, threshold)
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "row_hash")).alias("least"))
    kept = root.join(first, "fp").groupBy("root").agg(F.min("least").alias("least"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kept = common.materialize(kept.select(F.col("least.row_hash").alias("near_hash"), name(F.col("least.doc")).alias("near_id")), "kept")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("near_row")
    rows = docs.select(whole, common.row_hash(docs).alias("near_hash"), name(F.col(id_col)).alias("near_id")).join(kept, ["near_hash", "near_id"])
    # wholly equal rows: one stays
    turn = F.row_number().over(Window.partitionBy("near_hash", "near_id").orderBy("near_hash"))
    return rows.withColumn("near_turn", turn).where("near_turn = 1").select("near_row.*")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(common.table(spark, sf_dir, "documents"))
