"""What the vector operators share: which rows count, whole-number batches, and sums by cell over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillworks.llm import common

common.ship(__name__)

#: Components beyond this count as this: no long holds a squared distance across it.
MOST = 1 << 40
#: Up to this size of the components squares and their sums stay inside 64 bits; beyond it Python's integers take over.
NARROW = 1 << 24
LONGEST = (1 << 63) - 1


def finite_col(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; the empty vector passes. False for null."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def number_col(table: DataFrame, name: str) -> Column:
    """A vector column as it is if it holds floats or doubles, else as doubles."""
    kind = table.schema[name].dataType.simpleString()
    return F.col(name) if kind in ("array<float>", "array<double>") else F.col(name).cast("array<double>")


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each value, as 64-bit integers if all are narrow, else as Python's integers."""
    with np.errstate(over="ignore"):
        floors = np.clip(np.floor(values.astype(np.float64) * scale), -MOST, MOST)
    numbers = floors.astype(np.int64)
    return numbers if not numbers.size or np.abs(numbers).max() <= NARROW else numbers.astype(object)


def matrix(column: pa.Array, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The finite vectors of an Arrow column, all `width` long, as whole numbers; and which of them are finite.

    Nulls inside a vector come as NaN. Numpy tells them at a fraction of what a lambda over the array costs in Spark.
    """
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    finite = np.isfinite(values).all(axis=1)
    return whole(values if finite.all() else values[finite], scale), finite


def common_kind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays as Python's integers if one of them is."""
    return (a.astype(object), b.astype(object)) if object in (a.dtype, b.dtype) else (a, b)


def group_sums(groups: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups that occur, how many rows each has, and the sums of its rows."""
    order = np.argsort(groups, kind="stable")
    found, starts, counts = np.unique(groups[order], return_index=True, return_counts=True)
    return found, counts, np.add.reduceat(x[order], starts, axis=0)


def floor_means(entries: np.ndarray, totals: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Every entry replaced by floor(sum / count) of its rows; those without rows stay."""
    out = entries.astype(object)
    for at in np.flatnonzero(counts):
        out[at] = [int(t) // int(counts[at]) for t in totals[at]]
    narrow = max((abs(int(v)) for v in out.flat), default=0) <= NARROW
    return out.astype(np.int64) if narrow else out


def task_sums(rows: DataFrame, groups_of: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]], n_groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of vector parts by group over all rows, exact at every size.

    groups_of takes the vectors of a batch (column v) and yields (group of each row, values of each row). A task sends
    one row for each of its n_groups * (width + 1) cells at most; they are added up by cell, and that many numbers reach
    the driver, whatever the table's size.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((n_groups, width + 1), dtype=object)
        for batch in batches:
            if batch.num_rows:
                for groups, x in groups_of(batch.column(0)):
                    if not len(x):
                        continue
                    found, counts, sums = group_sums(groups, x)
                    cells[found, 0] += counts
                    cells[found, 1:] += sums
        at = np.flatnonzero(cells.ravel())
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([str(n) for n in cells.ravel()[at]])], ["cell", "total"])

    sent = rows.select("v").mapInArrow(add, "cell long, total string")
    found = sent.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    cells = np.zeros(n_groups * (width + 1), dtype=object)
    for r in found:
        cells[r.cell] = int(r.total)
    cells = cells.reshape(n_groups, width + 1)
    return cells[:, 1:], cells[:, 0]


def longs(numbers: np.ndarray) -> pa.Array:
    """As longs; what is beyond a long becomes the greatest one."""
    return pa.array(np.minimum(numbers, LONGEST).astype(np.int64), pa.int64())


def comma_joined(numbers: np.ndarray) -> str:
    return ",".join(str(int(n)) for n in numbers.ravel())
