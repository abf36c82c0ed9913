"""Decisions about imported files, and what is read out of pages and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .records import normal_path


def repair_actions(files: DataFrame, overwrite: bool = False, include_verified: bool = False) -> DataFrame:
    """``path, status, reason`` of each file of ``path, text``: what a repair of the folder would do.

    Files that are no Markdown, that a person has verified, or that have a summary beside
    them are skipped, for the first of these reasons.  Summaries are found by one equi join.
    """
    summary = F.regexp_replace("path", r"\.[^./]*$", "-repair-summary.md")
    made = files.select(F.col("path").alias("summary"), F.lit(True).alias("is_made")).distinct()
    rows = files.withColumn("summary", summary).join(made, "summary", "left")
    markdown = F.lower("path").endswith(".md") & ~F.col("path").endswith("-repair-summary.md")
    verified = F.coalesce(X.field(F.col("text"), "verify_status") == "verified", F.lit(False))
    held = F.coalesce("is_made", F.lit(False)) & F.lit(not overwrite) & ~(verified & F.lit(include_verified))
    reason = F.when(~markdown, "not-repairable-markdown").when(verified & F.lit(not include_verified), "verify-status-verified").when(held, "repair-summary-exists").otherwise("")
    return rows.select("path", F.when(reason == "", "converted").otherwise("skipped").alias("status"), reason.alias("reason"))


def front_matter_action(path: Column, text: Column, readable: Column, apply: bool = False, include_raw: bool = False) -> Column:
    """What putting front matter before an import comes to; what is there is never overwritten."""
    name = F.lower(path)
    supported = (name.endswith(".pdf.md") & ~name.endswith(".raw.md")) | (name.endswith(".raw.md") & F.lit(include_raw))
    return (
        F.when(~supported, "skipped_unsupported").when(~readable, "error").when(X.front_matter(text).isNotNull(), "skipped_existing_frontmatter").otherwise("updated" if apply else "would_update")
    )


def source_mismatches(annotations: DataFrame, papers: DataFrame) -> DataFrame:
    """``stem, annotation_source, manifest_path`` where both are given and differ after normalisation."""
    both = annotations.select("stem", F.col("source").alias("annotation_source")).join(papers.select("stem", F.col("path").alias("manifest_path")), "stem")
    given = (F.coalesce("annotation_source", F.lit("")) != "") & (F.coalesce("manifest_path", F.lit("")) != "")
    return both.where(given & (normal_path(F.col("annotation_source")) != normal_path(F.col("manifest_path"))))


def text_lengths(md: Column) -> tuple[Column, Column]:
    """Characters of trimmed paragraphs and table cells, and the number of images."""
    lines = F.transform(F.split(md, "\n"), lambda v: F.btrim(v))
    cells = lambda v: F.aggregate(F.split(v, r"\|"), F.lit(0).cast("bigint"), lambda n, c: n + F.char_length(F.btrim(c)))
    rule = lambda v: v.rlike(r"^\|[\s:|-]*\|$")
    total = F.aggregate(lines, F.lit(0).cast("bigint"), lambda n, v: n + F.when(rule(v), 0).when(v.startswith("|"), cells(v)).otherwise(F.char_length(v)))
    return total, F.regexp_count(md, F.lit(r"!\[[^\]]*\]\("))


def risk_line(code: Column, **details: Column) -> Column:
    """A risk as ``code (key=value, …)``, without what is null."""
    said = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in details.items()))
    return F.when(said == "", code).otherwise(F.concat(code, F.lit(" ("), said, F.lit(")")))
