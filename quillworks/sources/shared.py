"""Folders that the driver and all executors share, and tables stored there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Spark's setting that a finished query's shuffle files are deleted, not kept until the driver's next collection.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under spark.checkpoint.dir. Where that is unset: a temporary one in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='spark-runs-')}")
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table's writer has left its mark of success."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in a folder of its own and read back: it is computed once, and lineage ends there. What it was
    shuffled by goes from the disks when it is written."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
