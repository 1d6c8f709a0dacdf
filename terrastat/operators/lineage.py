"""Written tables that cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, the warehouse, or in a local session a temporary folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        local = sc.master == "local" or sc.master.startswith("local[")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrastat-") if local else spark.conf.get("spark.sql.warehouse.dir"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that a loop's plan does not grow and lost executors cost
    nothing of earlier rounds.  The tables go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/terrastat/cut-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: S112  the session may be gone, and with it the cluster's folder
            continue
