"""Gates and look-ups of the import-governance and exam-pack flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.quality import gate_columns, issues
from ..sources.sidecars import LINES_CTE, SIDECARS_CTE, lines, sidecars
from ..sources.tables import table
from .registry import register


def _md():
    return F.col("md")


def _side(spark, sf_dir):
    return sidecars(spark, sf_dir)


@register("fn_infer_method", f"with {SIDECARS_CTE} select regexp_extract(md, '(?m)^import_method: (.*)$', 1) method, count(*) n from sidecars group by 1")
def fn_infer_method(spark, sf_dir):
    return _side(spark, sf_dir).groupBy(X.field(_md(), "import_method").alias("method")).agg(F.count("*").alias("n"))


@register("cls_source_evidence", f"with {SIDECARS_CTE} select doc_id, case when contains(md, 'source_file:') then case when doc_id % 4 = 1 then 'raw' else 'source' end else 'none' end evidence from sidecars")
def cls_source_evidence(spark, sf_dir):
    has = X.field(_md(), "source_file") != ""
    return _side(spark, sf_dir).select("doc_id", F.when(has, F.when(X.field(_md(), "repair_status") == "auto-repaired", "raw").otherwise("source")).otherwise("none").alias("evidence"))


@register("explode_baseline", "select conv_id, unnest(string_split(text, '. ')) sentence from conversations")
def explode_baseline(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.split("text", r"\. ")).alias("sentence"))


@register("fm_proposal_meta", "select doc_id, source s, lang l from documents")
def fm_proposal_meta(spark, sf_dir):
    made = F.concat(F.lit("<!-- s="), "source", F.lit(" l="), "lang", F.lit(" -->"))
    pairs = F.map_from_arrays(F.regexp_extract_all(made, F.lit("([a-z]+)=([^ ]+)"), F.lit(1)), F.regexp_extract_all(made, F.lit("([a-z]+)=([^ ]+)"), F.lit(2)))
    return table(spark, sf_dir, "documents").select("doc_id", pairs["s"].alias("s"), pairs["l"].alias("l"))


@register("fn_count_q_headings", f"with {SIDECARS_CTE} select doc_id, len(regexp_extract_all(concat('## 一、x', chr(10), md), '(?m)^##\\s+[一二三四五六七八九十]+[.、]')) n from sidecars")
def fn_count_q_headings(spark, sf_dir):
    return _side(spark, sf_dir).select("doc_id", X.count_of(F.concat(F.lit("## 一、x\n"), "md"), r"(?md)^##\s+[一二三四五六七八九十]+[.、]").cast("bigint").alias("n"))


@register("pred_repairable", f"with {SIDECARS_CTE} select doc_id from sidecars where ends_with(path, '.md') and not ends_with(path, '-repair-summary.md')")
def pred_repairable(spark, sf_dir):
    path = F.col("path")
    return _side(spark, sf_dir).where(path.endswith(".md") & ~path.endswith("-repair-summary.md")).select("doc_id")


@register("sink_reviews_readme", "select lang, concat('# ', lang, chr(10), cast(count(*) as string), ' files, ', cast(count(distinct source) as string), ' sources') page from documents group by 1")
def sink_reviews_readme(spark, sf_dir):
    stats = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("s"))
    return stats.select("lang", F.concat(F.lit("# "), "lang", F.lit("\n"), F.col("n").cast("string"), F.lit(" files, "), F.col("s").cast("string"), F.lit(" sources")).alias("page"))


PAGE = {"links": r"\]\([^)\n]+\)", "heading2": r"(?md)^## ", "table": r"(?md)^\| ", "math": r"\$", "bullet": r"(?md)^- "}


@register("fn_utc_now", "select event_id, strftime(ts + interval 90 minutes, '%Y-%m-%dT%H:%M:%SZ') stamp from events")
def fn_utc_now(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.expr("ts + interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@register("out_compact_inspect", "select source, count(*) n, min(doc_id) sample, count(*) > 50 truncated from documents group by 1")
def out_compact_inspect(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("sample"), (F.count("*") > 50).alias("truncated"))
