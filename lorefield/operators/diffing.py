"""Snapshot and baseline differences, fingerprints, and idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change``: added, removed, modified or unchanged, by one full outer join."""
    b = before.select(key, F.col(digest).alias("was"))
    a = after.select(key, F.col(digest).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified").otherwise("unchanged")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def stable_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(value), 1, 10))


def fingerprint(text: Column) -> Column:
    """Sixteen hex digits over the text without its machine-written lines."""
    return F.substring(F.sha2(F.regexp_replace(text, r"(?md)^(updated|generated):.*\n?", ""), 256), 1, 16)
