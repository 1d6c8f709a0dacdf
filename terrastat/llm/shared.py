"""Helpers that the operators of this subpackage share: shared scratch space and column idioms."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

ROW_GROUP_BYTES = 16 << 20  # a writer holds a row group: with the default of 128 MB each task's takes that of the heap

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: spark.checkpoint.dir; where that is unset the
    warehouse, or in a local session, which has one machine only, a temporary folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrastat-") if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir"))
        root = sc.getCheckpointDir()
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/terrastat/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.  With
    ``batch_rows`` its Python workers get Arrow batches of so many rows, for the time of the write: batches of whole
    texts take memory on both sides."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if batch_rows:
            spark.conf.set(key, str(batch_rows))
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


FEW = 4_000_000  # rows of two numbers that are broadcast at most: 64 MB


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text hash are not among ``gone``'s (``doc_id, text_hash``); nulls match nulls.
    Where few rows go, no text is shuffled."""
    gone = materialise(gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "gone")
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left_anti")


@atexit.register
def _remove_scratch() -> None:
    for spark, path in _scratch:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: S112  the session may be gone, and with it the cluster's folder
            continue


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  Texts of one byte a character take the fast built-in, which equals it there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
