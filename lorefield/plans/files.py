"""Readers of PDF and Office files over files made of ``documents``, and sinks that write."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python import pieces, small_batches
from ..sources.office import SHEET_ROWS, convert
from ..sources.pdf import make_pdf, pdf_pages
from ..sources.shared import shared_root
from ..sources.tables import table
from ..sources.versions import publish, read_version
from .registry import register

#: Lines of a page of the files made here.
PAGE_LINES = 40
#: Lines of each text that a file can show: no empty ones, no control characters.
LINES_SQL = "list_filter(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', ' ', 'g'), chr(10)), lambda x: trim(x) <> '')"
LINES = f"lines as (select doc_id, lang, list_transform({LINES_SQL}, lambda x: trim(x)) l from documents)"


def _lines():
    clean = F.split(F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f\x7f]", " "), "\n")
    return F.transform(F.filter(clean, lambda x: F.trim(x) != ""), lambda x: F.trim(x))


def _made(spark, sf_dir, suffix: str, build) -> DataFrame:
    """``path, content``: a file for each document with a line, from its lines."""

    def run(batches):
        for piece in pieces(batches):
            ids, lines = (c.to_pylist() for c in piece.columns)
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}{suffix}" for i in ids]), pa.array([build(i, ls) for i, ls in zip(ids, lines)], pa.binary())], ["path", "content"])

    small_batches(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", _lines().alias("l")).where(F.size("l") > 0)
    return rows.mapInArrow(run, "path string, content binary")


def _pdf(doc_id: int, lines: list[str]) -> bytes:
    return make_pdf(f"Doc {doc_id}", [lines[k : k + PAGE_LINES] for k in range(0, len(lines), PAGE_LINES)])


PAGES = f"{LINES}, pages as (select doc_id, l, unnest(range(1, cast(ceil(len(l) / {PAGE_LINES}.0) as bigint) + 1)) page from lines where len(l) > 0), t as (select doc_id, cast(page as int) page, array_to_string(l[(page - 1) * {PAGE_LINES} + 1:page * {PAGE_LINES}], chr(10)) body from pages)"


def _id(path: str = "path"):
    return F.regexp_extract(path, "([0-9]+)", 1).cast("bigint").alias("doc_id")


@register("src_pdf_text", f"with {PAGES} select doc_id, string_agg(concat('## Page ', cast(page as string), chr(10), chr(10), body), concat(chr(10), chr(10)) order by page) md from t group by 1")
def src_pdf_text(spark, sf_dir):
    """A Markdown page for each file, with a heading for each of its pages."""
    part = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), "text")
    pages = pdf_pages(_made(spark, sf_dir, ".pdf", _pdf)).select("path", "page", part.alias("part"))
    whole = pages.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page", "part"))).alias("parts"))
    return whole.select(_id(), F.array_join("parts.part", "\n\n").alias("md"))


@register("src_pdf_pymupdf", f"with {PAGES} select doc_id, page, body from t where page in (1, 3)")
def src_pdf_pymupdf(spark, sf_dir):
    """The text of selected pages, here ``1,3``."""
    return pdf_pages(_made(spark, sf_dir, ".pdf", _pdf)).where(F.col("page").isin(1, 3)).select(_id(), "page", F.col("text").alias("body"))


@register("src_pdf_meta", f"with {PAGES} select doc_id, cast(max(page) as int) pages, concat('Doc ', cast(doc_id as string)) title, true sized from t group by doc_id")
def src_pdf_meta(spark, sf_dir):
    found = pdf_pages(_made(spark, sf_dir, ".pdf", _pdf)).where("page = 1")
    return found.select(_id(), "pages", "title", (F.col("size") > F.char_length("text")).alias("sized"))


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _docx(doc_id: int, lines: list[str]) -> bytes:
    p = lambda x, style="": f"<w:p>{style}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
    head = p(f"Doc {doc_id}", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>')
    grid = "<w:tbl>" + "".join(f"<w:tr><w:tc>{p(a)}</w:tc><w:tc>{p(b)}</w:tc></w:tr>" for a, b in (("id", "lines|n"), (str(doc_id), str(len(lines))))) + "</w:tbl>"
    return _zip({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{head}{"".join(map(p, lines))}{grid}</w:body></w:document>'})


def _pptx(doc_id: int, lines: list[str]) -> bytes:
    body = lambda x: f"<p:txBody><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:txBody>"
    return _zip({f"ppt/slides/slide{k}.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{body(f"Part {k}")}{body(x)}</p:sld>' for k, x in enumerate(lines, 1)})


def _xlsx(doc_id: int, lines: list[str]) -> bytes:
    rows = "".join(f'<row><c r="A{k}"><v>{k}</v></c><c r="B{k}" t="inlineStr"><is><t>{escape(x)}</t></is></c><c r="D{k}"><f>A{k}+1</f></c></row>' for k, x in enumerate(lines, 1))
    return _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="One"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"})


@register("src_docx", f"with {LINES} select doc_id, concat('# Doc ', cast(doc_id as string), chr(10), chr(10), array_to_string(l, concat(chr(10), chr(10))), chr(10), chr(10), '| id | lines\\|n |', chr(10), '| --- | --- |', chr(10), '| ', cast(doc_id as string), ' | ', cast(len(l) as string), ' |') md from lines where len(l) > 0")
def src_docx(spark, sf_dir):
    return convert(_made(spark, sf_dir, ".docx", _docx)).select(_id(), "md")


@register("src_pptx", f"with {LINES}, s as (select doc_id, unnest(l) x, generate_subscripts(l, 1) k from lines where len(l) > 0) select doc_id, string_agg(concat('## Slide ', cast(k as string), ': Part ', cast(k as string), chr(10), chr(10), x), concat(chr(10), chr(10)) order by k) md from s group by 1")
def src_pptx(spark, sf_dir):
    return convert(_made(spark, sf_dir, ".pptx", _pptx)).select(_id(), "md")


@register("src_xlsx", f"with {LINES}, s as (select doc_id, unnest(l[1:{SHEET_ROWS}]) x, generate_subscripts(l[1:{SHEET_ROWS}], 1) k from lines where len(l) > 0), r as (select doc_id, k, concat('| ', cast(k as string), ' | ', replace(x, '|', '\\|'), ' |  | =A', cast(k as string), '+1 |') line from s) select doc_id, concat('## One', chr(10), chr(10), max(line) filter (k = 1), chr(10), '| --- | --- | --- | --- |', coalesce(chr(10) || string_agg(line, chr(10) order by k) filter (k > 1), '')) md from r group by 1")
def src_xlsx(spark, sf_dir):
    return convert(_made(spark, sf_dir, ".xlsx", _xlsx)).select(_id(), "md")


# --------------------------------------------------------------------------
# sinks that write


def write_missing(rows: DataFrame, folder: str, key: str) -> DataFrame:
    """Adds the rows whose key the folder does not hold yet; the folder afterwards.

    Running it again adds nothing.  Files appear when the job commits, all or none.  Runs
    must follow one another: two at once could add a key twice.
    """
    spark = rows.sparkSession
    try:
        held = spark.read.parquet(folder).select(key)
        rows = rows.join(held, key, "left_anti")
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


@register("sink_idempotent", "select doc_id, case when doc_id % 2 = 0 then 'first' else 'second' end made_by from documents")
def sink_idempotent(spark, sf_dir):
    folder, docs = shared_root(spark), table(spark, sf_dir, "documents").select("doc_id")
    write_missing(docs.where("doc_id % 2 = 0").withColumn("made_by", F.lit("first")), folder, "doc_id")
    write_missing(docs.withColumn("made_by", F.lit("second")), folder, "doc_id")
    return write_missing(docs.withColumn("made_by", F.lit("third")), folder, "doc_id")


def replace_table(rows: DataFrame, folder: str) -> DataFrame:
    """Replaces a table as a whole: readers find the old version or the new one, never none."""
    return read_version(rows.sparkSession, folder, publish(rows, folder))


def current_table(spark: SparkSession, folder: str) -> DataFrame:
    return read_version(spark, folder)


@register("sink_atomic", "select doc_id, 'new' state from documents")
def sink_atomic(spark, sf_dir):
    folder, docs = shared_root(spark), table(spark, sf_dir, "documents").select("doc_id")
    replace_table(docs.withColumn("state", F.lit("old")), folder)
    try:  # a job that fails leaves the table that was there
        replace_table(docs.withColumn("state", F.raise_error(F.lit("stop")).cast("string")), folder)
    except Exception as e:
        if "stop" not in str(e) or current_table(spark, folder).where("state <> 'old'").count():
            raise
    return replace_table(docs.withColumn("state", F.lit("new")), folder)


@register("sink_json", "select doc_id, concat('{', chr(10), '  \"doc_id\": ', cast(doc_id as string), ',', chr(10), '  \"source\": \"', source, '\",', chr(10), '  \"tags\": [', chr(10), '    \"', lang, '\"', chr(10), '  ]', chr(10), '}', chr(10)) json from documents")
def sink_json(spark, sf_dir):
    """Records as files have them: two blanks of indentation, a line feed at the end."""
    record = F.to_json(F.struct("doc_id", "source", F.array("lang").alias("tags")), {"pretty": "true"})
    spaced = F.regexp_replace(F.regexp_replace(record, '" : ', '": '), r"\[ (.*) \]", "[\n    $1\n  ]")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(spaced, F.lit("\n")).alias("json"))
