"""The page of an exam type as it is first made, from a row of the census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# What stands below the census's figures.
OUTLINE = "\n\n## 方法提纲\n\n- _(fill by review-coach)_\n\n## 易错点\n\n- _(fill by review-coach)_\n\n## 练习目标\n\n- [ ] 重做一道高频真题\n- [ ] 不看笔记复述核心方法\n"


def quoted(value: Column) -> Column:
    """A YAML string in double quotes."""
    return F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))


def ranked_types(instances: DataFrame, must_know: float) -> DataFrame:
    """``type_id, rank, paper_count, question_count, rate, must_know, papers, path`` from ``type_id, paper`` of each question.

    Questions are counted by type and paper first; what a window then ranks are types.
    """
    by_paper = instances.groupBy("type_id", "paper").agg(F.count("*").alias("n"))
    total = by_paper.select("paper").distinct().agg(F.count("*").alias("total"))
    types = by_paper.groupBy("type_id").agg(F.count("*").alias("paper_count"), F.sum("n").alias("question_count"), F.sort_array(F.collect_list("paper")).alias("papers"))
    rated = types.crossJoin(F.broadcast(total)).withColumn("rate", F.col("paper_count") / F.col("total")).drop("total")  # one row
    ranked = rated.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("paper_count"), F.desc("question_count"), "type_id")))
    path = F.concat(F.lit("analysis/"), F.lpad(F.col("rank").cast("string"), 2, "0"), F.lit("-"), X.slug(F.col("type_id")), F.lit(".md"))
    return ranked.select("*", (F.col("rate") >= must_know).alias("must_know"), path.alias("path"))


def type_page(course: str, scope: str) -> Column:
    """The text of the page of a row of `ranked_types`; links go from the page to its papers."""
    said = F.concat(F.lit("共 "), F.col("paper_count").cast("string"), F.lit(" 份试卷；详见 题型频率统计.md"))
    name, rank = F.col("type_id"), F.col("rank").cast("string")
    links = F.array_join(F.transform("papers", lambda p: F.concat(F.lit("- [卷 "), p.cast("string"), F.lit("](../papers/"), p.cast("string"), F.lit(".md)"))), "\n")
    front = {
        "type": F.lit("exam-type-analysis"), "course": quoted(F.lit(course)), "exam_scope": quoted(F.lit(scope)), "exam_type_id": quoted(X.slug(name)), "exam_type_name": quoted(name), "rank": rank,
        "paper_count": F.col("paper_count").cast("string"), "must_know": F.col("must_know").cast("string"), "quality": F.lit("draft"), "status": F.lit("active"), "source_summary": quoted(said),
    }
    lines = [F.lit("---"), *(F.concat(F.lit(f"{k}: "), v) for k, v in front.items()), F.lit("---"), F.lit(""), F.concat(F.lit("# "), F.lpad(rank, 2, "0"), F.lit(" · "), name), F.lit("\n## 普查信号\n")]
    lines += [
        F.concat(F.lit("- 出现率："), X.percent(F.col("rate")), F.lit("（"), F.col("paper_count").cast("string"), F.lit(" 份试卷）")), F.concat(F.lit("- 标注题量："), F.col("question_count").cast("string")),
        F.concat(F.lit("- 必掌握："), F.when(F.col("must_know"), "是").otherwise("否")), F.concat(F.lit("\n## 来源依据\n\n- "), said, F.lit("\n")), F.when(links == "", "- （暂无试卷命中）").otherwise(links),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit(OUTLINE))
