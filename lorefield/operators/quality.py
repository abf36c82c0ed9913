"""Constraint gates: one wide projection of booleans, unpivoted to a row for each failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate_columns(df: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """``key`` and a boolean for each check; a check that cannot be decided fails."""
    return df.select(key, *(F.coalesce(test, F.lit(False)).alias(name) for name, test in checks.items()))


def issues(checked: DataFrame, names: list[str], key: str) -> DataFrame:
    """``key, code`` for each check that fails, without joining or scanning again."""
    failed = F.array_compact(F.array(*(F.when(~F.col(n), F.lit(n)) for n in names)))
    return checked.select(key, F.explode(failed).alias("code"))
