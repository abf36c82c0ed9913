"""How far a course is: stages that its files allow, and coverage of types by papers, pages and the guide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import PACK

# Files and folders of a course's preparation, by what they stand for.
FILES = {"standard": "quality-standard.md", "manifest": "manifest.json", "map": "source-map.json", "gold": "gold-sample-task.json", "taxonomy": "taxonomy.json"}
FOLDERS = {"cards": ("paper-cards", ".json"), "dives": ("试卷精析", ".md"), "analysis": ("分析", ".md"), "dossiers": ("type-dossiers", ".json"), "briefs": ("题型备课卡", ".md"), "types": ("题型解析", ".md")}


def _within(folder: str, suffix: str) -> Column:
    """A file right in a folder, with that suffix."""
    return F.col("path").rlike(rf"\A\Q{folder}\E/[^/]+\Q{suffix}\E\z")


def stages(files: DataFrame) -> DataFrame:
    """``course`` and whether each of eight stages can begin, from ``course, path`` of its files.

    One aggregate with a flag for each kind of file; the stages are built on the flags, some
    on earlier stages.
    """
    flags = {**{k: F.col("path") == v for k, v in FILES.items()}, **{k: _within(*v) for k, v in FOLDERS.items()}, **{f"pack{i}": F.col("path") == name for i, name in enumerate(PACK)}}
    has = files.groupBy("course").agg(*(F.bool_or(test).alias(k) for k, test in flags.items()))
    c, every = F.col, lambda *names: reduce(lambda a, b: a & b, map(F.col, names))
    told = has.select(
        "course", "types", c("standard"), every("manifest", "map").alias("source_map"), c("gold"), every("dives", "cards").alias("paper_v0"), every("taxonomy", "analysis").alias("known"),
        every("dossiers", "briefs").alias("dossier"), every("types", *(f"pack{i}" for i in range(len(PACK)))).alias("final"),
    )
    return told.select(
        "course", "standard", "source_map", every("standard", "source_map", "gold").alias("gold_sample"), "paper_v0", every("paper_v0", "known").alias("synthesis"),
        every("known", "dossier").alias("type_dossier"), every("dossier", "types").alias("type_analysis_sample"), "final",
    )


def cross_validate(papers: DataFrame, taxonomy: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """Gaps between four entities: ``course, issue, name``.

    ``papers``: ``course, stem, type_id`` (null where a paper has no types); ``taxonomy``,
    ``pages`` and ``links`` (of the guide): ``course, type_id``.  All four become rows of one
    table that is grouped once by course and name: types that papers have and the taxonomy
    lacks, known types of papers without a page or a link, pages of no such type, and papers
    without types.  Where a course has no guide, links are not asked for.
    """
    marked = lambda df, kind, name, test=F.lit(True): df.where(test).select("course", F.col(name).alias("name"), F.lit(kind).alias("kind"))
    rows = reduce(DataFrame.unionByName, [
        marked(papers, "annotated", "type_id", F.col("type_id").isNotNull()), marked(papers, "bare", "stem", F.col("type_id").isNull()), marked(taxonomy, "known", "type_id"), marked(pages, "page", "type_id"), marked(links, "link", "type_id"),
    ])
    has = {k: F.bool_or(F.col("kind") == k).alias(k) for k in ("annotated", "known", "page", "link")}
    # a paper's stem may be the name of a type, so papers are a group of their own
    each = rows.groupBy("course", (F.col("kind") == "bare").alias("is_paper"), "name").agg(*has.values())
    guides = links.select("course").distinct().withColumn("guide", F.lit(True))
    used = F.col("annotated") & F.col("known")
    issues = F.array_compact(F.array(
        F.when(F.col("is_paper"), "paper-without-types"), F.when(F.col("annotated") & ~F.col("known"), "unknown-type"), F.when(used & ~F.col("page"), "missing-page"),
        F.when(F.col("page") & ~used, "orphan-page"), F.when(used & ~F.col("link") & F.coalesce("guide", F.lit(False)), "not-in-guide"),
    ))
    return each.join(guides, "course", "left").select("course", F.explode_outer(issues).alias("issue"), "name").where(F.col("issue").isNotNull())


def coverage_totals(courses: DataFrame, issues: DataFrame) -> DataFrame:
    """``course, issue, n``: gaps by course and kind, and by course alone (``all``), in one pass of grouping sets; courses without any have 0."""
    counted = issues.groupingSets([["course", "issue"], ["course"]], "course", "issue").agg(F.count("*").alias("n"), F.grouping("issue").alias("over_all"))
    told = counted.select("course", F.when(F.col("over_all") == 1, "all").otherwise(F.col("issue")).alias("issue"), "n")
    clean = courses.select("course").distinct().join(told.select("course"), "course", "left_anti").select("course", F.lit("all").alias("issue"), F.lit(0).cast("bigint").alias("n"))
    return told.unionByName(clean)
