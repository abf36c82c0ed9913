"""Conversion of what is new in a growing folder, by a stream that ends when it has caught up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def convert_new(spark: SparkSession, source: str, schema: str, sink: str, progress: str, key: str, order: str, convert: Callable[[DataFrame], DataFrame], files_a_batch: int = 1000) -> DataFrame:
    """Converts rows of ``source`` whose key the sink does not hold; the sink afterwards.

    ``progress`` remembers the files that are done, so each is read once however often this
    runs.  Of rows of one key the first by ``order`` in a batch is converted, later batches
    skip it.  A batch writes a folder that its number names and looks at the folders before
    only, so one that is done again after a failure gives the same rows once.
    """

    def add(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        held = _held(spark, sink, number)
        if held is not None:
            new = new.join(held.select(key), key, "left_anti")
        convert(new).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(source)
    query = rows.writeStream.foreachBatch(add).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)


def _held(spark: SparkSession, sink: str, number: int) -> DataFrame | None:
    """Rows of the batches before."""
    if number == 0:
        return None
    return spark.read.parquet(sink).where(F.col("batch") < number)
