"""Connected components of a link table, by alternating star steps: every step is a join and an aggregation.

Defined results: repeated links, either way round, count once; a link with a null end or from a node to itself is none
(a node with no other has no row); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillworks.llm.common import discard, materialize


def _mins(pairs: DataFrame) -> DataFrame:
    """node, least: the smallest neighbour of each node, or the node itself if that is smaller."""
    return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to its smallest one."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_mins(both), F.col("a") == F.col("node")).where("b > a")
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    joined = down.join(_mins(down), F.col("a") == F.col("node"))
    moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(joined.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: columns a, b. Gives node, root: the smallest node it is linked with, in one or more steps.

    Nodes without a link have no row. Rounds grow with the logarithm of the largest component; every round's links are
    written to the shared checkpoint folder, so lost executors repeat one round at most.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        before, now = now, materialize(_small_star(_large_star(now)), "links")
        discard(before)
        last, mark = mark, now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == last or mark.n == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
