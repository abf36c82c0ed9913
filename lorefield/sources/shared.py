"""The folder that all machines of a cluster share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; on a single machine without one, a temporary one."""
    return f"{_root(spark)}/sink-{uuid.uuid4().hex}"


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    set_dir = context._jsc.sc().getCheckpointDir()
    root = context.getConf().get("spark.checkpoint.dir") or (set_dir.get() if set_dir.isDefined() else None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="lorefield-")
    if not set_dir.isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once, with its lineage cut."""
    _root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once, as compressed columns whose size a later join knows."""
    path = f"{shared_root(df.sparkSession)}/rows.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
