"""Decisions about imports over sidecars, and fields, lengths and lines read out of them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import imports as I
from ..operators import risks as R
from ..sources.sidecars import SIDECARS_CTE, risky_sidecars, sidecars
from ..sources.tables import table
from .registry import register
from .risks import RISKS

#: Sidecars as files of a folder: some are text, some have a summary beside them.
FOLDER = SIDECARS_CTE + """, files as (select doc_id, case when doc_id % 7 = 0 then replace(path, '.md', '.txt') else path end path, md from sidecars
 union all select doc_id, regexp_replace(case when doc_id % 7 = 0 then replace(path, '.md', '.txt') else path end, '\\.[^./]*$', '-repair-summary.md'), '# Summary' from sidecars where doc_id % 3 = 0)"""


def _folder(spark, sf_dir):
    own = sidecars(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.replace("path", F.lit(".md"), F.lit(".txt"))).otherwise(F.col("path")).alias("path"), F.col("md").alias("text"))
    beside = own.where("doc_id % 3 = 0").select("doc_id", F.regexp_replace("path", r"\.[^./]*$", "-repair-summary.md").alias("path"), F.lit("# Summary").alias("text"))
    return own.unionByName(beside)


@register("inc_repair_one", f"""with {FOLDER}, s as (select path, case when not ends_with(path, '.md') or ends_with(path, '-repair-summary.md') then 'not-repairable-markdown' when doc_id % 5 = 0 then 'verify-status-verified' when doc_id % 3 = 0 then 'repair-summary-exists' else '' end reason from files)
select path, case when reason = '' then 'converted' else 'skipped' end status, reason from s""")
def inc_repair_one(spark, sf_dir):
    return I.repair_actions(_folder(spark, sf_dir).select("path", "text"))


@register("agg_frontmatter_actions", f"""with {SIDECARS_CTE}, a as (select replace(path, '.pdf.md', case doc_id % 4 when 0 then '.pdf.raw.md' when 1 then '.md' else '.pdf.md' end) path, case when doc_id % 4 in (0, 1) then 'skipped_unsupported' when doc_id % 11 = 0 then 'error' when doc_id % 3 = 0 then 'skipped_existing_frontmatter' else 'would_update' end act from sidecars)
select act, count(*) n, min(path) first_path from a group by 1""")
def agg_frontmatter_actions(spark, sf_dir):
    """How many files of each bucket, and the first; every third sidecar keeps its front matter, every eleventh is not readable."""
    k = F.col("doc_id")
    path = F.replace("path", F.lit(".pdf.md"), F.when(k % 4 == 0, ".pdf.raw.md").when(k % 4 == 1, ".md").otherwise(".pdf.md"))
    text = F.when(k % 3 == 0, F.col("md")).otherwise(F.concat(F.lit("\n"), "md"))
    rows = sidecars(spark, sf_dir).select(path.alias("path"), text.alias("text"), (k % 11 != 0).alias("readable"))
    return rows.groupBy(I.front_matter_action(F.col("path"), F.col("text"), F.col("readable")).alias("act")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@register("join_source_mismatch", "select concat('p', cast(doc_id as string)) stem, concat('x/p', cast(doc_id as string), '.md') annotation_source, concat('papers\\p', cast(doc_id as string), '.md') manifest_path from documents where doc_id % 5 = 3")
def join_source_mismatch(spark, sf_dir):
    """Annotations name their source in five ways, one of them another file; a null or an empty source is none."""
    k, text = F.col("doc_id"), F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    stem, name = F.concat(F.lit("p"), text), F.concat(F.lit("p"), text, F.lit(".md"))
    source = F.when(k % 5 == 0, F.concat(F.lit("./papers/"), name)).when(k % 5 == 1, F.concat(F.lit("papers\\"), name)).when(k % 5 == 2, F.lit("")).when(k % 5 == 3, F.concat(F.lit("x/"), name))
    return I.source_mismatches(docs.select(stem.alias("stem"), source.alias("source")), docs.select(stem.alias("stem"), F.concat(F.lit("papers\\"), name).alias("path")))


TYPE_PAGES = "select doc_id, concat('pages/', cast(doc_id as string), '.md') path, case when doc_id % 9 = 8 then text else concat('---', chr(10), 'type: exam-type-analysis', chr(10), 'exam_type_id: ', case when doc_id % 2 = 0 then concat('\"t', cast(doc_id // 4 as string), '\"') else concat('t', cast(doc_id // 4 as string)) end, chr(10), '---', chr(10), text) end md from documents"


def _type_pages(spark, sf_dir):
    """Pages with ``page_type`` and ``type_id`` of their front matter, null without one."""
    number = F.concat(F.lit("t"), F.floor(F.col("doc_id") / 4).cast("string"))
    kind = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    md = F.when(F.col("doc_id") % 9 == 8, F.col("text")).otherwise(F.concat(F.lit("---\ntype: exam-type-analysis\nexam_type_id: "), kind, F.lit("\n---\n"), "text"))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("pages/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), md.alias("md"))
    front = F.regexp_extract("md", r"(?s)\A\x{FEFF}?---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    value = lambda name: F.nullif(F.btrim(F.regexp_extract(front, rf"(?md)^{name}:[ \t]*(.*)$", 1), F.lit(" \"'")), F.lit(""))
    return pages.select("doc_id", "path", value("type").alias("page_type"), value("exam_type_id").alias("type_id"))


@register("fm_type_fields", f"with p as ({TYPE_PAGES}) select doc_id, case when starts_with(md, '---') then 'exam-type-analysis' end page_type, case when starts_with(md, '---') then concat('t', cast(doc_id // 4 as string)) end type_id from p")
def fm_type_fields(spark, sf_dir):
    return _type_pages(spark, sf_dir).select("doc_id", "page_type", "type_id")


@register("idx_skeletons_by_type", f"with p as ({TYPE_PAGES}), t as (select path, concat('t', cast(doc_id // 4 as string)) type_id from p where starts_with(md, '---')) select type_id, path, row_number() over (partition by type_id order by path) nth, count(*) over (partition by type_id) pages from t")
def idx_skeletons_by_type(spark, sf_dir):
    """Pages of each type in the order of their paths; rows, so that a type with many pages makes no long list."""
    held = _type_pages(spark, sf_dir).where("type_id is not null").select("type_id", "path")
    pages = held.groupBy("type_id").agg(F.count("*").alias("pages"))
    return held.withColumn("nth", F.row_number().over(W.partitionBy("type_id").orderBy("path"))).join(pages, "type_id").select("type_id", "path", "nth", "pages")


@register("agg_doc_text_len", f"""with {SIDECARS_CTE}, l as (select doc_id, trim(unnest(string_split(concat(md, '![a](b.png) ![](c)'), chr(10)))) line from sidecars),
 n as (select doc_id, sum(case when regexp_matches(line, '^\\|[\\s:|-]*\\|$') then 0 when starts_with(line, '|') then list_sum(list_transform(string_split(line, '|'), lambda c: length(trim(c)))) else length(line) end) chars from l group by 1)
select doc_id, cast(chars as bigint) chars, len(regexp_extract_all(concat(md, '![a](b.png) ![](c)'), '!\\[[^\\]]*\\]\\(')) images from n join sidecars using (doc_id)""")
def agg_doc_text_len(spark, sf_dir):
    total, images = I.text_lengths(F.concat("md", F.lit("![a](b.png) ![](c)")))
    return sidecars(spark, sf_dir).select("doc_id", total.alias("chars"), images.alias("images"))


@register("fn_risk_summary", f"with {RISKS} select doc_id, concat(code, ' (severity=', severity, case when line_no is null then '' else concat(', line=', cast(line_no as string)) end, ')') line from risks join meta using (code)")
def fn_risk_summary(spark, sf_dir):
    known = F.broadcast(R.metadata(spark).select("code", "severity"))  # a row for each code
    return R.detect(risky_sidecars(spark, sf_dir)).join(known, "code").select("doc_id", I.risk_line(F.col("code"), severity=F.col("severity"), line=F.col("line_no")).alias("line"))
