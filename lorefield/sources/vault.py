"""Files of a vault: inventory, Markdown, JSON and YAML sources."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("/.git/", "/__pycache__/", "/node_modules/", "/.venv/", "/venv/")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, suffix, size, modified`` of all files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.col("path")
    kept = files.where(~F.exists(F.array(*map(F.lit, SKIPPED)), lambda s: F.contains(path, s)))
    return kept.select("path", F.regexp_extract(path, "([^/]*)$", 1).alias("name"), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text, non_utf8`` of Markdown files; bytes that are not UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    raw = F.col("content").cast("string")
    return files.select("path", F.make_valid_utf8(raw).alias("text"), (~F.is_valid_utf8(raw)).alias("non_utf8"))


def json_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One row for each JSON file, with its path; the key of an annotation is the path with double underscores."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes ``path, text`` rows as UTF-8 files below a folder that all machines see; their number.

    A file appears whole, by renaming; a task that is done again writes the same files.
    """
    root = folder.removeprefix("file://")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
                os.replace(part, target)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    names = rows.columns
    return rows.select(*(F.col(c).cast("string") for c in names[:2])).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0
