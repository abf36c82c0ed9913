"""Column functions from plain Python ones, one Arrow batch at a time; for what built-in expressions cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

#: Bytes of an Arrow batch between the JVM and Python at most, but for a single longer row.
BATCH_BYTES = 8 << 20
#: Bytes of a batch that are Python objects at a time.
PIECE_BYTES = 1 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on bytes in an Arrow batch to BATCH_BYTES; a lower one stays.

    The default of 64 MB is held several times over by each worker, and what is made of it as well.
    """
    bound = str(spark.conf.get(_BATCH_CONF)).lower().removesuffix("b")
    if not bound.isdigit() or not 0 < int(bound) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, of about ``most`` bytes each."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def per_value(f: Callable, kind: str = "string"):
    """``f`` over one or more columns, row by row within a batch; a null argument gives null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    def applied(*columns):
        if session := SparkSession.getActiveSession():
            small_batches(session)
        return pandas_udf((one, two, three)[len(columns) - 1], kind)(*columns)

    return applied
