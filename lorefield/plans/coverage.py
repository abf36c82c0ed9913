"""Stages and coverage of courses whose files and types are those of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.coverage import FILES, FOLDERS, coverage_totals, cross_validate, stages
from ..operators.pages import PACK
from ..sources.tables import table
from .cases import sql_literal
from .registry import register

#: Files that a document may add to its course, each for one bit of a number that its id gives.
PATHS = [*FILES.values(), *(f"{folder}/x{suffix}" for folder, suffix in FOLDERS.values()), *PACK]
NUMBER = "(doc_id * 7919 + 12345) % 1048576"
COURSE = "concat(source, '-', cast(doc_id // 60 as string))"
VAULT = f"f as (select {COURSE} course, unnest(list_filter([{', '.join(f'case when ({NUMBER} // {1 << k}) % 2 = 1 then {sql_literal(p)} end' for k, p in enumerate(PATHS))}, '{next(iter(FOLDERS.values()))[0]}/deep/x.json', 'other.md'], lambda x: x is not null)) path from documents)"


def _has(*paths: str) -> str:
    return " and ".join(f"bool_or(path = {sql_literal(p)})" for p in paths)


def _numbered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    course = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 60).cast("string"))
    return docs.select("doc_id", course.alias("course"), F.expr(NUMBER).alias("number"))


@register("qc_stage_ready", f"""with {VAULT}, h as (select course, {_has(FILES["standard"])} standard, {_has(FILES["manifest"], FILES["map"])} source_map, {_has(FILES["gold"])} gold, {_has("试卷精析/x.md", "paper-cards/x.json")} paper_v0,
 {_has(FILES["taxonomy"], "分析/x.md")} known, {_has("type-dossiers/x.json", "题型备课卡/x.md")} dossier, {_has("题型解析/x.md")} types, {_has("题型解析/x.md", *PACK)} final from f group by 1)
select course, standard, source_map, standard and source_map and gold gold_sample, paper_v0, paper_v0 and known synthesis, known and dossier type_dossier, dossier and types type_analysis_sample, final from h""")
def qc_stage_ready(spark, sf_dir):
    """Eight stages of each course, by the files that its documents add."""
    own = [F.when(F.shiftright("number", k).bitwiseAND(1) == 1, p) for k, p in enumerate(PATHS)]
    deep = F.lit(next(iter(FOLDERS.values()))[0] + "/deep/x.json")  # not right in the folder
    files = _numbered(spark, sf_dir).select("course", F.explode(F.array_compact(F.array(*own, deep, F.lit("other.md")))).alias("path"))
    return stages(files)


#: Types are numbers from 0 to 11; bits of a document's number say where its type is found.
ENTITIES = f"""e as (select doc_id, {COURSE} course, concat('t', cast(doc_id % 12 as string)) type_id, {NUMBER} n from documents),
 papers as (select course, concat('p', cast(doc_id as string)) stem, case when n // 4 % 4 > 0 then type_id end type_id from e), taxonomy as (select course, type_id from e where n // 16 % 4 > 0),
 pages as (select course, type_id from e where n // 64 % 4 > 0), links as (select course, type_id from e where n // 256 % 4 > 1),
 k as (select course, type_id as name, bool_or(a) a, bool_or(t) t, bool_or(p) p, bool_or(l) l from (select course, type_id, true a, false t, false p, false l from papers where type_id is not null union all select course, type_id, false, true, false, false from taxonomy
  union all select course, type_id, false, false, true, false from pages union all select course, type_id, false, false, false, true from links) group by 1, 2),
 i as (select course, 'paper-without-types' issue, stem as name from papers where type_id is null union select course, 'unknown-type', name from k where a and not t union select course, 'missing-page', name from k where a and t and not p
  union select course, 'orphan-page', name from k where p and not (a and t) union select course, 'not-in-guide', name from k where a and t and not l and course in (select course from links))"""


def _issues(spark, sf_dir):
    rows = _numbered(spark, sf_dir).withColumn("type_id", F.concat(F.lit("t"), (F.col("doc_id") % 12).cast("string")))
    part = lambda k: F.shiftright("number", k).bitwiseAND(3)
    papers = rows.select("course", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("stem"), F.when(part(2) > 0, F.col("type_id")).alias("type_id"))
    return rows, cross_validate(papers, rows.where(part(4) > 0).select("course", "type_id"), rows.where(part(6) > 0).select("course", "type_id"), rows.where(part(8) > 1).select("course", "type_id"))


@register("qc_cross", f"with {ENTITIES} select course, issue, name from i")
def qc_cross(spark, sf_dir):
    """Gaps between papers, taxonomy, pages and guide, by name."""
    return _issues(spark, sf_dir)[1]


@register("qc_cross_totals", f"with {ENTITIES} select course, issue, count(*) n from i group by 1, 2 union all select e.course, 'all', count(distinct (i.issue, i.name)) filter (i.issue is not null) from e left join i using (course) group by 1")
def qc_cross_totals(spark, sf_dir):
    """How many gaps of each kind a course has, and in all."""
    rows, issues = _issues(spark, sf_dir)
    return coverage_totals(rows, issues)
