"""Smaller operators of the import, census and feedback flows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import diffing as D
from ..sources.headers import HEADER_BYTES, headers, import_sidecars
from ..sources.shared import shared_root
from ..sources.sidecars import LINES_CTE, SIDECARS_CTE, lines, sidecars
from ..sources.tables import table
from ..sources.vault import write_files
from .registry import register


def _md():
    return F.col("md")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


#: Files of documents: imports, raw ones, and pages that may say what they are derived from; each holds its text four times.
VAULT_FILES = """select doc_id, concat(source, '/', cast(doc_id as string), case doc_id % 4 when 0 then '.pdf.md' when 1 then '.pdf.raw.md' else '.md' end) as path,
 concat('---', chr(10), case when doc_id % 4 = 2 then concat('derived_from_import: ', cast(doc_id as string), chr(10)) else '' end, 'source_file: ', source, chr(10), '---', chr(10), text, text, text, text) md from documents"""


@register("scan_import_sidecars", f"""with f as ({VAULT_FILES}) select path, cast(octet_length(encode(md)) as bigint) size, least(octet_length(encode(md)), 65536) header_bytes, sha256(substr(md, 1, 16000)) head from f where doc_id % 4 in (0, 2)""")
def scan_import_sidecars(spark, sf_dir):
    """Imports of a vault by name and header: of each file 65,536 bytes are read at most."""
    folder = shared_root(spark)
    files = spark.sql(VAULT_FILES.replace("from documents", "from {docs}"), docs=table(spark, sf_dir, "documents"))
    write_files(files.select("path", "md"), folder)
    found = import_sidecars(headers(spark, folder))
    inner = F.substring(F.col("path"), F.length(F.lit(folder.removeprefix("file://"))) + 2, F.lit(1 << 20))
    return found.select(inner.alias("path"), "size", F.least(F.col("size"), F.lit(HEADER_BYTES)).cast("int").alias("header_bytes"), F.sha2(F.encode(F.substring("text", 1, 16000), "UTF-8"), 256).alias("head"))


@register("scan_sidecars", f"with {SIDECARS_CTE} select path, regexp_replace(path, '\\.pdf\\.md$', '.raw.md') raw_path from sidecars")
def scan_sidecars(spark, sf_dir):
    return sidecars(spark, sf_dir).where(F.col("path").endswith(".pdf.md")).select("path", F.regexp_replace("path", r"\.pdf\.md$", ".raw.md").alias("raw_path"))


@register("scan_nonempty_md", f"with {SIDECARS_CTE} select doc_id from sidecars where length(trim(md)) > 0 and not ends_with(path, 'README.md')")
def scan_nonempty_md(spark, sf_dir):
    return sidecars(spark, sf_dir).where((F.char_length(F.trim("md")) > 0) & ~F.col("path").endswith("README.md")).select("doc_id")


@register("src_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def src_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("src_feedback", f"with {SIDECARS_CTE} select doc_id, regexp_extract(md, '(?m)^repair_status: (.*)$', 1) status from sidecars where starts_with(md, '---')")
def src_feedback(spark, sf_dir):
    return sidecars(spark, sf_dir).where(X.front_matter(_md()).isNotNull()).select("doc_id", X.field(_md(), "repair_status").alias("status"))


@register("fm_quality", f"with {SIDECARS_CTE} select doc_id, array_to_string(regexp_extract_all(string_split(md, concat(chr(10), '---', chr(10)))[1], '(?m)^([A-Za-z_]\\w*):', 1), ',') names from sidecars")
def fm_quality(spark, sf_dir):
    return sidecars(spark, sf_dir).select("doc_id", F.array_join(F.regexp_extract_all(X.front_matter(_md()), F.lit(r"(?md)^([A-Za-z_]\w*):"), F.lit(1)), ",").alias("names"))


@register("pred_verified", "select doc_id, doc_id % 5 = 0 verified from documents")
def pred_verified(spark, sf_dir):
    return sidecars(spark, sf_dir).select("doc_id", (F.try_element_at(X.front_matter_map(_md()), F.lit("verify_status")) == "verified").alias("verified"))


@register("fn_path_equiv", "select doc_id, ends_with(concat('a/b/', source, '/', cast(doc_id as string)), concat('/', source, '/', cast(doc_id as string))) equivalent from documents")
def fn_path_equiv(spark, sf_dir):
    tail = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    whole = F.concat(F.lit("a/b/"), tail)
    return _docs(spark, sf_dir).select("doc_id", ((whole == tail) | F.endswith(whole, F.concat(F.lit("/"), tail))).alias("equivalent"))


@register("fn_md_cell_simple", "select conv_id, turn, replace(replace(text, '|', concat(chr(92), '|')), chr(10), '<br>') cell from conversations")
def fn_md_cell_simple(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(F.replace("text", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")).alias("cell"))


@register("fn_norm_scalar", "select doc_id, source plain from documents")
def fn_norm_scalar(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.scalar(F.concat(F.lit('k:  "'), "source", F.lit('"  # note'))).alias("plain"))


@register("fn_table_cols", f"with {LINES_CTE} select doc_id, line_no, len(line) - len(replace(line, '|', '')) - 1 n_cols from lines where starts_with(line, '| ')")
def fn_table_cols(spark, sf_dir):
    rows = lines(sidecars(spark, sf_dir).select("doc_id", "md")).where(F.startswith("line", F.lit("| ")))
    return rows.select("doc_id", "line_no", (X.count_of(F.col("line"), r"(?<!\\)\|") - 1).cast("bigint").alias("n_cols"))


@register("lkp_skeleton", "select d.doc_id, f.first_page from documents d join (select lang, min(doc_id) first_page from documents group by 1) f on d.lang = f.lang")
def lkp_skeleton(spark, sf_dir):
    first = _docs(spark, sf_dir).groupBy("lang").agg(F.min("doc_id").alias("first_page"))  # a row for each type
    return _docs(spark, sf_dir).select("doc_id", "lang").join(first, "lang").select("doc_id", "first_page")


@register("fn_infer_source", f"with {SIDECARS_CTE} select doc_id, regexp_extract(md, '(?m)^source_file: src/([^/]*)/', 1) inferred, case when contains(md, 'mineru') then 'ocr' else 'local' end method from sidecars")
def fn_infer_source(spark, sf_dir):
    return sidecars(spark, sf_dir).select("doc_id", F.regexp_extract("md", "(?md)^source_file: src/([^/]*)/", 1).alias("inferred"), F.when(_md().contains("mineru"), "ocr").otherwise("local").alias("method"))


@register("sample_limits", "with r as (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) rn from documents) select source, doc_id from r where rn <= 8")
def sample_limits(spark, sf_dir):
    rn = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return _docs(spark, sf_dir).withColumn("rn", rn).where("rn <= 8").select("source", "doc_id")


@register("plan_output_path", f"with {SIDECARS_CTE} select doc_id, concat('out/', regexp_replace(path, '\\.pdf\\.md$', ''), '.md') target from sidecars")
def plan_output_path(spark, sf_dir):
    return sidecars(spark, sf_dir).select("doc_id", F.concat(F.lit("out/"), F.regexp_replace("path", r"\.pdf\.md$", ""), F.lit(".md")).alias("target"))


@register("fmt_exam_line", "select o_orderkey, concat('- ', cast(cast(o_orderdate as date) as string), ' exam ', o_orderpriority) line from orders")
def fmt_exam_line(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("- "), F.col("o_orderdate").cast("date").cast("string"), F.lit(" exam "), "o_orderpriority").alias("line"))
