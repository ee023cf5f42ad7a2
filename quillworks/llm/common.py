"""Shared helpers of the training-data operators: reading, checkpoint tables, shipping code, bounded samples."""

from __future__ import annotations

import builtins
import ctypes
import itertools
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def ship(module_name: str) -> None:
    """Pickle the functions of a module's package by value, so executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name.rpartition(".")[0]])


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker: caches shared by the tasks it runs."""
    return builtins.__dict__.setdefault("_quillworks_worker_state", {})


def worker_cache(tag: object, make: Callable[[], dict]) -> dict:
    """The cache of the operator at work in this Python worker. Workers are used again by later stages: what another
    operator (or another model) has left is dropped before a new cache is made, so a worker holds one at most."""
    state = worker_state()
    if state.get("cache", (None,))[0] != tag:
        state.pop("cache", None)
        give_back()
        state["cache"] = tag, make()
    return state["cache"][1]


def give_back() -> None:
    """Return the memory that this Python process has freed to the system. Arrow's pool and the C library keep it, and
    workers stay beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def send(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a model. Its class goes along by value; open it with received()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> object:
    return pickle.loads(sent.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset: a temporary one in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    state = worker_state()
    if "checkpoint_root" not in state:
        state["checkpoint_root"] = tempfile.mkdtemp(prefix="spark-quillworks-")
    return f"file://{state['checkpoint_root']}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back: lineage ends there."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if folder.startswith(checkpoint_root(spark).removeprefix("file://")) or folder.startswith("file:"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_hash(docs: DataFrame) -> Column:
    """A hash of a whole row. Maps and variants, which have no hash, count as their JSON, a map by its sorted entries."""

    def hashable(name: str, kind: str) -> Column:
        if kind.startswith("map<") and "map<" not in kind[4:] and "variant" not in kind:
            return F.array_sort(F.map_entries(docs[name]))
        return F.to_json(F.struct(docs[name])) if "map<" in kind or "variant" in kind else docs[name]

    return F.xxhash64(*[hashable(f.name, f.dataType.simpleString()) for f in docs.schema])


def words_col(text: Column) -> Column:
    """array<string>: the words `[^\\x20\\x09-\\x0D]+` of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(rows: DataFrame, id_col: str, label_cols: list[str], size: int) -> DataFrame:
    """At most `size` rows with the lowest hash of their id: a fixed sample, whatever the partitioning.

    Rows of the label table that share an id count once (the smallest labels), so a join cannot multiply.
    """
    one = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("sample_id")).agg(*[F.min(c).alias(c) for c in label_cols])
    return one.orderBy(F.xxhash64("sample_id"), "sample_id").limit(size)


def within_chars(rows: DataFrame, order: list[str], size: int, chars: int) -> tuple[DataFrame, int]:
    """The rows up to a cut, and how many of them to take in the order of the bigint columns `order`: at most `size`, and
    as many as have `chars` characters of text together.

    Sizes are looked at first (the driver sees `size` rows of numbers), so no text moves that does not fit. A text of
    over a 64th of `chars` is left out: one long text cannot take the place of all others. Rows that are equal in
    `order` are to hold equal texts; copies of the last one may follow it. A null text has no characters; no rows give
    no rows.
    """
    length = F.coalesce(F.length("text"), F.lit(0))
    rows = rows.where(length <= chars // 64)
    first = rows.select(*order, length.alias("chars")).orderBy(*order).limit(size).collect()
    taken = [r for r, total in zip(first, itertools.accumulate(r.chars for r in first), strict=True) if total <= chars]
    if not taken:
        return rows.limit(0), 0
    last = F.struct(*[F.lit(taken[-1][c]).cast("bigint").alias(c) for c in order])
    return rows.where(F.struct(*order) <= last), len(taken)
