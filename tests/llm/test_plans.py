"""What plans must not do, whatever Spark takes the sizes for."""

from pyspark.sql import functions as F
from quillworks.llm import simhash


def test_replicas_are_never_broadcast(spark, tmp_path):
    """60 replicas of a fingerprint follow a small table: as one broadcast they would fill the driver."""
    spark.range(1_000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/prints")
    text = simhash.links(spark.read.parquet(f"{tmp_path}/prints"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text
