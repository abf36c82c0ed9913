"""Pages brought in line with a ranking, by a journal that a second run completes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import claim, is_committed, last_claim, read_version, versions

PAGES = "path string, type_id string, text string"
STORE = "type_id string, fingerprint string"
ARCHIVE = "name string, copy int, text string"
PHASES = ("plan", "parked", "pages", "archive", "store")


def page_print(text: Column) -> Column:
    """Sixteen hex digits over a page without its own fingerprint line."""
    return F.substring(F.sha2(F.regexp_replace(text, r"(?md)^generated_fingerprint:\s*.*\n?", ""), 256), 1, 16)


def refreshed(text: Column, rank: Column, count: Column) -> Column:
    """A page that people wrote, with the rank and the number of papers of its front matter brought up to date."""
    number = lambda key, value: lambda t: F.regexp_replace(t, rf"(?md)^{key}:[ \t]*\d+[ \t]*$", F.concat(F.lit(f"{key}: "), value.cast("string")))
    return number("paper_count", count)(number("rank", rank)(text))


def plan_actions(pages: DataFrame, store: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is to happen: a row for each page, and one for each wanted type that no page of a person holds.

    ``pages``: ``path, type_id, text`` (no type: unscoped); ``store``: the fingerprints of
    pages that were made, by type; ``wanted``: ``type_id, rank, paper_count, path, body``.
    A page is made if its fingerprint is the one in the store.  Of pages of one type one a
    person wrote is kept before one that was made, then the later path; it moves to the
    path of its rank.  Made pages are replaced or deleted, pages of people archived.

    Returns ``action, path, target, type_id, text, fingerprint``.
    """
    known = pages.join(store, "type_id", "left").withColumn("made", F.coalesce(page_print(F.col("text")) == F.col("fingerprint"), F.lit(False))).drop("fingerprint")
    best = known.where("type_id is not null").groupBy("type_id").agg(F.max_by("path", F.struct(~F.col("made"), "path")).alias("best"))
    ranked = wanted.select("type_id", "rank", "paper_count", F.col("path").alias("target"), "body").where("paper_count > 0")
    held = known.join(best, "type_id", "left").join(ranked.drop("body"), "type_id", "left").withColumn("kept", F.coalesce(F.col("path") == F.col("best"), F.lit(False)))
    gone = F.when(F.col("made"), "delete").otherwise("archive")
    is_wanted = F.col("target").isNotNull()
    action = F.when(~F.col("kept") | ~is_wanted, gone).when(F.col("made"), "delete").otherwise("migrate")
    moved = held.select(
        action.alias("action"), "path", F.when(action == "migrate", F.col("target")).alias("target"), "type_id",
        F.when(action == "migrate", refreshed(F.col("text"), F.col("rank"), F.col("paper_count"))).otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("fingerprint"),
    )
    own = held.where(F.col("kept") & ~F.col("made")).select("type_id")
    written = ranked.join(own, "type_id", "left_anti").select(F.lit("write").alias("action"), F.lit(None).cast("string").alias("path"), "target", "type_id", F.col("body").alias("text"), page_print(F.col("body")).alias("fingerprint"))
    return moved.unionByName(written)


class Reconciler:
    """The tables ``pages``, ``store`` and ``archive`` in a folder, and a journal of runs over them.

    A run writes its plan first, then what it parks, then each table as it will be, all
    below a folder of the run; tables are those of the last run whose last phase is
    committed.  A run that stops leaves the tables as they were.  The next call completes it:
    phases that are committed stand, the others are done from the plan *as it was written*,
    so that the result is the one of a run that was never stopped.  All files stay; nothing
    is deleted that a crash could leave missing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def seed(self, pages: DataFrame, store: DataFrame) -> None:
        """The tables before the first run."""
        number = claim(self.spark, self.folder)
        tables = {"pages": pages, "archive": self.spark.createDataFrame([], ARCHIVE), "store": store}
        for name in PHASES[2:]:
            tables[name].write.parquet(self._path(number, name))

    def _path(self, number: int, phase: str) -> str:
        return f"{self.folder}/v={number:010d}" if phase == PHASES[-1] else f"{self.folder}/run={number:010d}/{phase}"

    def table(self, name: str, number: int | None = None) -> DataFrame:
        """A table after the last complete run; the last phase is the version that readers look for."""
        number = versions(self.spark, self.folder)[-1] if number is None else number
        return read_version(self.spark, self.folder, number) if name == PHASES[-1] else self.spark.read.parquet(self._path(number, name))

    def open_run(self) -> int | None:
        """A run with a plan that is not complete."""
        done = max(versions(self.spark, self.folder), default=0)
        return next((n for n in range(last_claim(self.spark, self.folder), done, -1) if is_committed(self.spark, self._path(n, "plan"))), None)

    def run(self, wanted: DataFrame, before: Callable[[str], None] = lambda phase: None) -> dict[str, DataFrame]:
        """Completes a run that was stopped, or makes one towards ``wanted``; the tables afterwards.

        ``before`` is called before each phase with its name, for tests that stop a run.
        """
        last = versions(self.spark, self.folder)[-1]
        number = self.open_run() or claim(self.spark, self.folder)
        tables = {name: self.table(name, last) for name in PHASES[2:]}
        phases: dict[str, Callable[[], DataFrame]] = {
            "plan": lambda: plan_actions(tables["pages"], tables["store"], wanted),
            "parked": lambda: plan.where("action in ('migrate', 'archive')"),
            "pages": lambda: parked.where("action = 'migrate'").unionByName(plan.where("action = 'write'")).select(F.col("target").alias("path"), "type_id", "text"),
            "archive": lambda: tables["archive"].unionByName(self._archived(parked, tables["archive"])),
            "store": lambda: plan.where("action = 'write'").select("type_id", "fingerprint"),
        }
        for phase, rows in phases.items():
            path = self._path(number, phase)
            if not is_committed(self.spark, path):
                before(phase)
                rows().write.mode("overwrite").parquet(path)  # what a stopped phase left was seen by nobody
            if phase == "plan":
                plan = self.spark.read.parquet(path)
            elif phase == "parked":
                parked = self.spark.read.parquet(path)
        return {name: self.table(name, number) for name in PHASES[2:]} | {"plan": plan}

    @staticmethod
    def _archived(parked: DataFrame, archive: DataFrame) -> DataFrame:
        """Archived pages by file name; a name that the archive has gets the next copy."""
        name = F.regexp_extract("path", "([^/]*)$", 1)
        held = archive.groupBy("name").agg(F.count("*").cast("int").alias("copy"))
        rows = parked.where("action = 'archive'").select(name.alias("name"), "text")
        return rows.join(held, "name", "left").select("name", F.coalesce("copy", F.lit(0)).alias("copy"), "text")
