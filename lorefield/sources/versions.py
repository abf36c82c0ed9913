"""Tables as numbered versions: a version is there when its files are committed, and the greatest one counts.

Nothing that readers use is ever overwritten or deleted, so a writer that stops half-way
leaves the table as it was, and a reader never meets a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What a committer leaves behind when all files of a job are in place.
COMMITTED = "_SUCCESS"


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_committed(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, f"{path}/{COMMITTED}")
    return fs.exists(place)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    fs, place = _at(spark, folder)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and is_committed(spark, f"{folder}/{n}"))


def last_claim(spark: SparkSession, folder: str) -> int:
    """The greatest number that a writer has taken; 0 without any."""
    fs, place = _at(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return max((int(n[6:]) for n in names if n.startswith("claim=")), default=0)


def claim(spark: SparkSession, folder: str) -> int:
    """A version number that no other writer has: the file that names it can be created once only."""
    fs, place = _at(spark, folder)
    fs.mkdirs(place)
    number = last_claim(spark, folder) + 1
    while not _created(spark, f"{folder}/claim={number:010d}"):
        number += 1
    return number


def _created(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return not fs.exists(place) and fs.createNewFile(place)


def publish(rows: DataFrame, folder: str) -> int:
    """Writes ``rows`` as the next version; readers see it when its job has committed."""
    number = claim(rows.sparkSession, folder)
    rows.write.parquet(f"{folder}/v={number:010d}")
    return number


def read_version(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The version with that number, or the greatest one that is committed."""
    number = versions(spark, folder)[-1] if number is None else number
    return spark.read.parquet(f"{folder}/v={number:010d}")
