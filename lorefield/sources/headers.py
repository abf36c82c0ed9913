"""A source of file headers: a bounded number of bytes of each Markdown file, with filters on paths inside the source.

The filters are options.  ``pushFilters`` of a Python source would change the reader that a
DataFrame keeps, so that a second query over the same DataFrame met the filters of the first.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read of each file at most.
HEADER_BYTES = 65_536
#: Folders that are not looked into (fixed values).
SKIPPED = {".git", "__pycache__", "node_modules", ".venv", "venv"}
#: Files of one task, and rows of one Arrow batch.
FILES_PER_TASK, ROWS_PER_BATCH = 2_000, 64

SCHEMA = "path string, name string, size bigint, header binary"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class HeaderReader(DataSourceReader):
    """Lists the files once on the driver, by name alone; tasks open those that the filters leave."""

    def __init__(self, root: str, pattern: str, inside: str):
        self.root, self.pattern, self.inside = root, pattern, inside

    def _wanted(self, path: str) -> bool:
        return fnmatchcase(os.path.basename(path), self.pattern) and self.inside in path

    def partitions(self) -> list[Files]:
        if os.path.isfile(self.root):
            found = [self.root]
        else:
            found = []
            for folder, inner, names in os.walk(self.root):
                inner[:] = sorted(d for d in inner if d not in SKIPPED)
                found += (os.path.join(folder, n) for n in names)
        paths = sorted((p for p in found if self._wanted(p)), key=str.lower)
        return [Files(paths[i : i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(partition.paths), ROWS_PER_BATCH):
            rows = []
            for path in partition.paths[i : i + ROWS_PER_BATCH]:
                with open(path, "rb", buffering=0) as f:
                    rows.append((path, os.path.basename(path), os.fstat(f.fileno()).st_size, read_header(f)))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary()))], ["path", "name", "size", "header"])


def read_header(f, n: int = HEADER_BYTES) -> bytes:
    """The first ``n`` bytes; an unbuffered file may give fewer at a time."""
    got = b""
    while len(got) < n and (more := f.read(n - len(got))):
        got += more
    return got


class HeaderSource(DataSource):
    """``spark.read.format("markdown_headers").option("pattern", "*.pdf.md").option("inside", "/2024/").load(folder)``.

    Files whose name does not fit the pattern, or whose path does not hold ``inside``, are
    not opened.  The folder is one that the driver and all tasks see under its path, as a
    vault on a shared file system.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options["path"].removeprefix("file://"), self.options.get("pattern", "*.md"), self.options.get("inside", ""))


def headers(spark: SparkSession, folder: str, pattern: str = "*.md", inside: str = "") -> DataFrame:
    """``path, name, size, header`` of the Markdown files below a folder."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format(HeaderSource.name()).option("pattern", pattern).option("inside", inside).load(folder)


def import_sidecars(files: DataFrame) -> DataFrame:
    """Imports that can be repaired, by name and header: ``path, text`` (bytes that are no UTF-8 become U+FFFD).

    Names end in ``.pdf.md`` (not ``.raw.md``), or the front matter says what the page is derived from.
    """
    text = F.make_valid_utf8(F.col("header").cast("string"))
    name = F.lower("name")
    front = F.regexp_extract(text, r"(?s)\A\x{FEFF}?---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    derived = F.btrim(F.regexp_extract(front, r"(?md)^derived_from_import:[ \t]*(.*)$", 1), F.lit(" \"'"))
    wanted = (name.endswith(".pdf.md") & ~name.endswith(".raw.md")) | (derived != "")
    return files.select("path", "name", "size", text.alias("text")).where(wanted)
