"""Rows dealt over tasks by the work they are, not by their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tasks_of(spark: SparkSession) -> int:
    """Four tasks a core."""
    return 4 * spark.sparkContext.defaultParallelism


def dealt(df: DataFrame, *keys) -> DataFrame:
    """``df`` over four tasks a core, by ``keys`` if any.  A small file comes in one partition, and shuffles of narrow rows are
    joined into few by their bytes; where a row is much work, that leaves cores idle."""
    return df.repartition(tasks_of(df.sparkSession), *keys)
