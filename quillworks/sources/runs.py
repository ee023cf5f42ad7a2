"""Runs that can be taken up again: outputs made from stored predecessors, and documents whose failures alone are redone.

Every step is a table in a shared folder. A table counts as there when its writer has finished it; what a lost run has
left half-written is written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillworks.operators.documents import documents_with_status
from quillworks.operators.lines import join_wrapped
from quillworks.sources.io import NEEDS, with_needed
from quillworks.sources.shared import finished, new_folder

__all__ = ["finished", "make_outputs", "new_folder", "run_documents", "run_state"]
Builder = Callable[[dict[str, DataFrame]], DataFrame]


def make_outputs(spark: SparkSession, builders: dict[str, Builder], wanted: set[str], path: str, needs: dict[str, tuple[str, ...]] = NEEDS, overwrite: bool = False) -> dict[str, DataFrame]:
    """The wanted outputs and those they are made from, one Parquet table each under `path`, in order of making.

    A builder gets the tables of its predecessors as read back, so nothing is computed twice; outputs that are there
    already stay, unless overwrite is set. Returns all of them, read back.
    """
    made: dict[str, DataFrame] = {}
    for name in with_needed(wanted, needs):
        place = f"{path}/{name}"
        if overwrite or not finished(spark, place):
            builders[name]({need: made[need] for need in needs.get(name, ())}).write.mode("overwrite").parquet(place)
        made[name] = spark.read.parquet(place)
    return made


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds run_key: which document this is, by id, name and text."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "source_name", "text")]
    return docs.withColumn("run_key", F.sha2(F.concat_ws("\1", *told), 256))


def run_documents(docs: DataFrame, path: str, fold: Callable[[list[str]], list[str]] = join_wrapped) -> DataFrame:
    """Process the documents that no run at `path` has got done or found empty or untitled; gives the state of all.

    Each run writes one table of its documents with status and reason. A first run takes all, a later one the failed and
    the new ones. A document counts as another when its text has changed.
    """
    spark, runs, number = docs.sparkSession, [], 0
    while finished(spark, f"{path}/run={number}"):
        runs.append(f"{path}/run={number}")
        number += 1
    keyed = _keyed(docs)
    if runs:
        settled = spark.read.parquet(*runs).where("status <> 'failed'").select("run_key").distinct()
        keyed = keyed.join(settled, "run_key", "left_anti")
    # the key goes along as the id, and the id inside it comes back at the end
    given = F.struct(F.col("doc_id").alias("doc_id"), "run_key")
    found = documents_with_status(keyed.withColumn("doc_id", given), fold)
    out = found.select(F.col("doc_id.run_key").alias("run_key"), F.col("doc_id.doc_id").alias("doc_id"), *[c for c in found.columns if c != "doc_id"])
    out.write.mode("overwrite").parquet(f"{path}/run={number}")
    return run_state(spark, path)


def run_state(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all runs at `path`, with the run that settled each: the last one it was part of."""
    runs = [0]
    while finished(spark, f"{path}/run={runs[-1] + 1}"):
        runs.append(runs[-1] + 1)
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/run={n}" for n in runs])
    last = F.max("run").over(Window.partitionBy("run_key"))
    return rows.withColumn("last_run", last).where("run = last_run").drop("last_run", "run_key")
