"""Path family: a file inventory is made from ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths as P
from ..sources.tables import table
from .registry import register

#: A path for each document; the folder and suffix follow from the id.
PATH_SQL = """concat(case doc_id % 9 when 0 then 'scripts/' when 1 then 'feedback/raw/' when 2 then 'references/imports/' when 3 then 'courses/la/notes/' when 4 then 'courses/la/labs/' when 5 then 'homework/' when 6 then 'courses/la/reviews/' when 7 then 'tasks/weekly/' else 'semesters/2026/' end,
 source, '/', cast(doc_id as string), case doc_id % 7 when 0 then '.pdf' when 1 then '.pdf.md' when 2 then '-repair-summary.md' when 3 then '.sync-conflict-1.md' when 4 then '.PNG' when 5 then '/__pycache__/x.pyc' else '.md' end)"""
PATHS = f"paths as (select doc_id, {PATH_SQL} path, n_chars * 600 size from documents)"
GROUP_SQL = "case " + " ".join(f"when {' or '.join(f'''contains(path, '{n}')''' for n in needles)} then '{name}'" for name, needles in P.GROUPS) + " else 'ops' end"
HELD_SQL = f"case when contains(path, '.sync-conflict-') then 'sync-conflict file' when contains(path, '__pycache__/') then 'generated cache' when ends_with(path, '.pdf') then 'binary source document' when ends_with(path, '.PNG') then 'binary media asset' when size > {P.LARGE_BYTES} then 'large file' end"


def inventory(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH_SQL).alias("path"), (F.col("n_chars") * 600).alias("size"))


@register("cls_git_group", f"with {PATHS} select doc_id, {GROUP_SQL} grp from paths")
def cls_git_group(spark, sf_dir):
    return inventory(spark, sf_dir).select("doc_id", P.group(F.col("path")).alias("grp"))


@register("cls_hold_back", f"with {PATHS} select doc_id, {HELD_SQL} reason from paths")
def cls_hold_back(spark, sf_dir):
    return inventory(spark, sf_dir).select("doc_id", P.hold_back(F.col("path"), F.col("size")).alias("reason"))


@register("agg_hold_counts", f"with {PATHS}, h as (select {HELD_SQL} reason from paths) select reason, count(*) n from h where reason is not null group by 1")
def agg_hold_counts(spark, sf_dir):
    return inventory(spark, sf_dir).select(P.hold_back(F.col("path"), F.col("size")).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@register("agg_group_paths", f"with {PATHS} select {GROUP_SQL} grp, count(*) n, min(path) first_path, max(path) last_path from paths group by 1")
def agg_group_paths(spark, sf_dir):
    return inventory(spark, sf_dir).groupBy(P.group(F.col("path")).alias("grp")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@register("agg_binary_zones", f"with {PATHS} select array_to_string(string_split(path, '/')[1:2], '/') zone, count(*) n, string_agg(distinct lower(regexp_extract(path, '(\\.[^./]+)$', 1)), ',' order by lower(regexp_extract(path, '(\\.[^./]+)$', 1))) suffixes from paths where ends_with(path, '.pdf') or ends_with(path, '.PNG') group by 1")
def agg_binary_zones(spark, sf_dir):
    zone = F.substring_index("path", "/", 2)
    return inventory(spark, sf_dir).where(P.suffix(F.col("path")).isin(*P.BINARY)).groupBy(zone.alias("zone")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(P.suffix(F.col("path")))), ",").alias("suffixes"))


@register("agg_large_files", f"with {PATHS}, u as (select path, size, 'worktree' src from paths union all select path, size + doc_id % 3 - 1, 'index' from paths) select path, max(size) size from u group by 1 having max(size) > 1000000")
def agg_large_files(spark, sf_dir):
    tree = inventory(spark, sf_dir)
    both = tree.select("path", "size").union(tree.select("path", F.col("size") + F.col("doc_id") % 3 - 1))
    return both.groupBy("path").agg(F.max("size").alias("size")).where("size > 1000000")


@register("cls_review_file", f"with {PATHS} select doc_id, case when ends_with(path, '-repair-summary.md') then '归档' when ends_with(lower(path), '.pdf.md') or ends_with(lower(path), '.raw.md') then '文本' when lower(regexp_extract(path, '(\\.[^./]+)$', 1)) in ('.pdf', '.png') then '试卷' end folder from paths")
def cls_review_file(spark, sf_dir):
    return inventory(spark, sf_dir).select("doc_id", P.review_folder(F.col("path")).alias("folder"))


@register("fn_chunk_pages", "with p as (select doc_id, cast(ceil(n_chars / 100.0) as bigint) pages from documents) select doc_id, cast(unnest(range(1, greatest(pages, 1) + 1, 20)) as bigint) first_page, pages from p")
def fn_chunk_pages(spark, sf_dir):
    pages = F.ceil(F.col("n_chars") / 100)
    return table(spark, sf_dir, "documents").select("doc_id", pages.alias("pages")).select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest("pages", F.lit(1).cast("bigint")), F.lit(20).cast("bigint"))).alias("first_page"), "pages")


@register("scan_tree", f"with {PATHS} select path from paths where not contains(path, '__pycache__/') and not contains(path, '/node_modules/')")
def scan_tree(spark, sf_dir):
    return inventory(spark, sf_dir).where(~P.contains_any(F.col("path"), ["__pycache__/", "/node_modules/"])).select("path")


@register("scan_glob_papers", f"with {PATHS} select path from paths where ends_with(path, '.pdf.md')")
def scan_glob_papers(spark, sf_dir):
    return inventory(spark, sf_dir).where(F.col("path").endswith(".pdf.md")).select("path")


@register("scan_inputs_patterns", f"with {PATHS} select path from paths where regexp_matches(path, '\\.pdf$|\\.PNG$|^tasks/')")
def scan_inputs_patterns(spark, sf_dir):
    return inventory(spark, sf_dir).where(F.col("path").rlike(r"\.pdf$|\.PNG$|^tasks/")).select("path")


@register("fn_norm_path", f"with {PATHS} select doc_id, regexp_replace(replace(concat('./', replace(path, '/', chr(92))), chr(92), '/'), '^(\\./)+', '') norm from paths")
def fn_norm_path(spark, sf_dir):
    odd = F.concat(F.lit("./"), F.replace("path", F.lit("/"), F.lit("\\")))
    return inventory(spark, sf_dir).select("doc_id", F.regexp_replace(F.replace(odd, F.lit("\\"), F.lit("/")), r"^(\./)+", "").alias("norm"))


@register("list_children", f"with {PATHS} select regexp_replace(path, '/[^/]*$', '') dir, count(*) n, min(path) first_child from paths group by 1")
def list_children(spark, sf_dir):
    return inventory(spark, sf_dir).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.count("*").alias("n"), F.min("path").alias("first_child"))
