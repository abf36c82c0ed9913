"""Frequency census: presence of types in papers, rates, ranks, pairs, bindings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MUST_KNOW = 0.6


def type_frequency(presence: DataFrame, paper: str, type_: str, count: str, threshold: float = MUST_KNOW) -> DataFrame:
    """Papers and questions of each type, its appearance rate over all annotated papers, and its rank.

    ``presence`` has one row for each paper and type.  The rank window runs over types
    only, after aggregation.
    """
    stats = presence.groupBy(F.col(type_).alias("type_id")).agg(F.count("*").alias("paper_count"), F.sum(count).alias("question_count"))
    papers = presence.agg(F.count_distinct(paper).alias("annotated"))
    rate = F.col("paper_count") / F.col("annotated")
    order = W.orderBy(F.desc("paper_count"), F.desc("question_count"), "type_id")
    return stats.crossJoin(F.broadcast(papers)).select(F.row_number().over(order).alias("rank_no"), "type_id", "paper_count", "question_count", rate.alias("appearance_rate"), (rate >= threshold).alias("must_know"))


def cooccurrence(presence: DataFrame, paper: str, type_: str) -> DataFrame:
    """How many papers hold both types of each unordered pair."""
    left = presence.select(F.col(paper).alias("p"), F.col(type_).alias("left_type")).distinct()
    right = left.withColumnRenamed("left_type", "right_type")
    return left.join(right, "p").where("left_type < right_type").groupBy("left_type", "right_type").agg(F.count("*").alias("papers"))


def question_count(present: Column, value: Column) -> Column:
    """Absent counts as one; anything but a positive whole number counts as none."""
    return F.when(~present, F.lit(1)).when(value.rlike("^[1-9][0-9]*$"), value.cast("int")).otherwise(F.lit(0))


def confidence(present: Column, value: Column) -> Column:
    """Absent is high; null and blank are invalid; so is what is no known level."""
    low = F.lower(F.btrim(value))
    return F.when(~present, F.lit("high")).when(low.isin("high", "medium", "low"), low).otherwise(F.lit("invalid"))


def canonical_groups(sources: DataFrame, key: str, path: str, problem_rank: Column, answer_rank: Column, role: str) -> DataFrame:
    """One row for each group of sources: the best problem and answer source, roles, and whether roles clash."""
    best = lambda rank: F.min_by(path, F.struct(rank, F.col(path)))
    count_of = lambda r: F.count_if(F.col(role) == r)
    return sources.groupBy(key).agg(
        best(problem_rank).alias("problem_source"), best(answer_rank).alias("answer_source"), F.count("*").alias("source_count"),
        F.array_join(F.sort_array(F.collect_set(role)), ",").alias("roles"),
        ((F.count("*") > 1) & ((count_of("problem") > 1) | (count_of("combined") > 1) | (count_of("unknown") > 1))).alias("ambiguous"),
    )


def bind_cascade(papers: DataFrame, annotations: DataFrame, tiers: list[tuple[str, str]]) -> DataFrame:
    """Binds annotations to papers by the first of several key pairs that matches.

    Tiers run from strict to loose; what a tier binds is out of the later ones.  A
    paper that a tier matches with several annotations is ambiguous and bound to
    none; an annotation goes to its first paper in ``seq`` order.  Equal to binding
    paper by paper where tiers do not compete for one annotation.
    """
    open_papers, open_notes, parts = papers, annotations, []
    for tier, (paper_key, note_key) in enumerate(tiers, 1):
        hits = open_papers.select("paper", "seq", F.col(paper_key).alias("k")).where("k is not null").join(open_notes.select("note", F.col(note_key).alias("k")), "k")
        hits = hits.withColumn("n", F.count("*").over(W.partitionBy("paper"))).withColumn("turn", F.row_number().over(W.partitionBy("note").orderBy("seq")))
        bound = hits.select("paper", F.when((F.col("n") == 1) & (F.col("turn") == 1), F.col("note")).alias("note"), F.when(F.col("n") > 1, "ambiguous").when(F.col("turn") > 1, "taken").otherwise("bound").alias("state"), F.lit(tier).alias("tier"))
        bound = bound.groupBy("paper", "state", "tier").agg(F.min("note").alias("note"))
        parts.append(bound)
        open_papers = open_papers.join(bound.select("paper"), "paper", "left_anti")
        open_notes = open_notes.join(bound.where("state = 'bound'").select("note"), "note", "left_anti")
    missing = open_papers.select("paper", F.lit("missing").alias("state"), F.lit(0).alias("tier"), F.lit(None).cast(annotations.schema["note"].dataType).alias("note"))
    out = missing
    for part in parts:
        out = out.unionByName(part)
    return out


# Marks of roles in file names, taken out in this order, and roles by what they are good for.
ROLE_MARKS = ["试卷含答案复习版", "试题含答案复习版", "试卷含答案", "试题含答案", "试卷及答案复习版", "试题及答案复习版", "试卷答案复习版", "试卷及答案", "试题及答案", "试卷答案", "答案复习版", "试卷复习版", "试题复习版", "复习版", "答案", "试卷", "试题"]
COMBINED_MARKS = ["试卷及答案", "试题及答案", "试卷答案", "试卷含答案", "试题含答案"]
PROBLEM_ORDER = ["problem", "combined", "problem_review", "answer_review", "answer", "unknown"]
ANSWER_ORDER = ["combined", "answer_review", "answer", "problem_review", "problem", "unknown"]


def sidecar_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?:\.pdf)?\.md$", "")


def canonical_stem(stem: Column) -> Column:
    for mark in ROLE_MARKS:
        stem = F.replace(stem, F.lit(mark), F.lit(""))
    return F.btrim(stem, F.lit(" _-—·.。"))


def source_role(stem: Column) -> Column:
    """Problem, answer, both, and whether for review, by marks in the name."""
    has = lambda *marks: reduce(lambda a, b: a | b, (F.contains(stem, F.lit(m)) for m in marks))
    return F.when(has(*COMBINED_MARKS), "combined").when(has("答案"), F.when(has("复习版"), "answer_review").otherwise("answer")).when(has("试卷") & has("复习版"), "problem_review").when(has("试卷", "试题"), "problem").otherwise("unknown")


def counted(fields: Column, key: str) -> Column:
    """Questions of a type in the JSON object of an annotation: 1 where the key is missing, 0 for what is no whole number over 0.

    A number may be written with a zero fraction, a text may not.
    """
    value = F.try_variant_get(F.try_parse_json(fields), f"$.{key}", "variant")
    kind, text = F.schema_of_variant(value), F.btrim(F.try_variant_get(value, "$", "string"))
    number = F.try_variant_get(value, "$", "double")
    numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    whole = F.when(numeric & (number > 0) & (number == F.floor(number)), number.cast("bigint")).when((kind == "STRING") & text.rlike(r"^[1-9][0-9]*$"), text.try_cast("bigint"))
    return F.when(~F.array_contains(F.json_object_keys(fields), key), F.lit(1)).otherwise(F.coalesce(whole, F.lit(0)))
