"""Checks of edited imports: counts by file, totals with a verdict, and the file to look at first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .risks import metadata


def file_results(docs: DataFrame, risks: DataFrame, skipped: Column, limit: int = 8) -> DataFrame:
    """``doc_id, path, skipped, errors, warnings`` of every file, with samples of each (``code`` or ``code:line``).

    Files that a person has verified are skipped and count for nothing.  The window keeps
    ``limit`` risks of each severity before any is gathered, however many a file has.
    """
    files = docs.select("doc_id", "path", skipped.alias("skipped"))
    known = risks.join(F.broadcast(metadata(docs.sparkSession).select("code", "severity")), "code")  # a row for each code
    told = known.select("doc_id", F.when(F.col("severity") == "error", "error").otherwise("warning").alias("level"), F.concat_ws(":", "code", F.col("line_no").cast("string")).alias("named"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "level").orderBy("named"))
    counted = lambda level: F.count_if(F.col("level") == level).alias(f"{level}s")
    sample = lambda level: F.array_join(F.sort_array(F.collect_list(F.when((F.col("level") == level) & (F.col("nth") <= limit), F.col("named")))), ",").alias(f"{level}_sample")
    # counts and samples in one grouping: risks that are asked for twice are found twice
    grouped = told.withColumn("nth", nth).groupBy("doc_id").agg(counted("error"), counted("warning"), sample("error"), sample("warning"))
    joined = files.join(grouped, "doc_id", "left")
    number = lambda c: F.when(F.col("skipped"), 0).otherwise(F.coalesce(c, F.lit(0))).alias(c)
    text = lambda c: F.when(F.col("skipped"), "").otherwise(F.coalesce(c, F.lit(""))).alias(c)
    return joined.select("doc_id", "path", "skipped", number("errors"), number("warnings"), text("error_sample"), text("warning_sample"))


def totals(results: DataFrame) -> DataFrame:
    """One row: files scanned, checked and skipped, errors and warnings, and the verdict."""
    summed = results.agg(
        F.count("*").alias("scanned"), F.count_if(~F.col("skipped")).alias("checked"), F.count_if("skipped").alias("skipped"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
    )
    return summed.select("*", (F.col("errors") == 0).alias("ok"), F.when(F.col("errors") == 0, "review passed").otherwise("review failed").alias("label"))


def recommended(results: DataFrame) -> DataFrame:
    """The checked file with the most errors, then warnings; of equals the first path."""
    return results.where(~F.col("skipped")).orderBy(F.desc("errors"), F.desc("warnings"), "path").limit(1).select("path", "errors", "warnings")


def pair_answers(files: DataFrame, markers: str) -> DataFrame:
    """Question and answer files of one stem: ``stem, question, answer, extra``.

    A file name that holds a marker (a pattern) is an answer; its stem is the name without
    it.  Files are first brought to a row for each stem and role, so a stem with many files
    makes no pairs but one; ``extra`` counts the files beyond the first of each role.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z.]+$", ""), markers, "")
    rows = files.select(F.concat(F.regexp_extract("path", "^(.*/)?", 0), stem).alias("stem"), name.rlike(markers).alias("is_answer"), "path")
    by_role = rows.groupBy("stem").agg(F.min(F.when(~F.col("is_answer"), F.col("path"))).alias("question"), F.min(F.when(F.col("is_answer"), F.col("path"))).alias("answer"), F.count("*").alias("n"))
    both = by_role.where(F.col("question").isNotNull() & F.col("answer").isNotNull())
    return both.select("stem", "question", "answer", (F.col("n") - 2).alias("extra"))
