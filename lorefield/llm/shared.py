"""The shared folder, and joins that a hot key cannot overload."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds one row in this many; there are never more such keys.
HOT_SHARE = 1000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one all machines share (``spark.checkpoint.dir``).

    Only where a session of one machine has none, as in tests, is a temporary one set.
    """
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
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
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row for each of ``keys``), both sides without null keys.

    Groups of at least 1/HOT_SHARE of the rows number HOT_SHARE at most, so they are
    broadcast, and their rows go to no common task: ``spread`` deals them out.
    ``groups`` is read twice and should be materialised.
    """
    total = groups.agg(F.sum(size_col)).first()[0] or 0
    is_hot = F.col(size_col) * HOT_SHARE >= F.lit(max(total, 1)) if total > 100 * HOT_SHARE else F.lit(False)
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(is_hot).select(*keys, *(F.col(c).alias(f"hot_{c}") for c in values), F.lit(True).alias("is_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    dealt = F.xxhash64(spread, F.monotonically_increasing_id())  # the place too: a third of the rows may have one id
    marked = marked.withColumn("deal", F.when(F.col("is_hot"), F.pmod(dealt, F.lit(1 << 30)) + 1).otherwise(0))
    rest = groups.where(~is_hot).withColumn("deal", F.lit(0).cast("bigint"))
    joined = marked.withColumn("deal", F.col("deal").cast("bigint")).join(rest, [*keys, "deal"], "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"hot_{c}"), F.col(c)).alias(c) for c in values))
