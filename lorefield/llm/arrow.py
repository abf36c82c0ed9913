"""Small helpers for operators that run as ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that an operator holds as Python strings at a time.
BLOCK_CHARS = 4 << 20
#: Bytes of an Arrow batch between the JVM and Python at most, but for a single longer row.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on bytes in an Arrow batch to BATCH_BYTES; a lower one stays.

    The default of 64 MB is held several times over, on both sides of the pipe.
    """
    bound = str(spark.conf.get(_BATCH_CONF)).lower().removesuffix("b")
    if not bound.isdigit() or not 0 < int(bound) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def blocks(batches: Iterable[pa.RecordBatch], text_at: int = 1) -> Iterator[list[pa.Array]]:
    """Column slices of the batches, each with about ``BLOCK_CHARS`` bytes of text at most.

    A single longer text makes a block of its own.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(text_at)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + (n or 0) > BLOCK_CHARS:
                yield [c.slice(start, i - start) for c in batch.columns]
                start, held = i, 0
            held += n or 0
        if start < len(sizes):
            yield [c.slice(start) for c in batch.columns]


def map_carrying(df: DataFrame, run, schema: str, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``run`` over id, text and the carried columns, which come back in one struct ``carried``."""
    small_batches(df.sparkSession)
    named = [F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)]
    extra = "".join(f", carry{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *named).mapInArrow(run, schema + extra).withColumnRenamed("id", id_col)
    if carry:
        out = out.withColumn("carried", F.struct(*(F.col(f"carry{k}").alias(c) for k, c in enumerate(carry)))).drop(*(f"carry{k}" for k in range(len(carry))))
    return out
