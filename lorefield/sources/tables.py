"""Named access to the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import stored

#: Bytes of input for each core from which a scan keeps all cores busy by itself.
DEAL_BYTES = 64 << 20
#: Smaller tables are read faster than they are dealt out.
DEAL_LEAST = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_table(spark: SparkSession, sf_dir: str, name: str, key: str, once: bool = False) -> DataFrame:
    """A table for expressions that cost far more than moving a row.

    Files with less than DEAL_BYTES for each core, perhaps of a single row group, would keep few of
    them busy, so their rows are dealt out by ``key``; larger (and tiny) tables stay where they are.
    With ``once``, what is dealt out is stored, for jobs that read it several times.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not DEAL_LEAST <= held < cores * DEAL_BYTES:
        return df
    return stored(df.repartition(cores, key)) if once else df.repartition(cores, key)
