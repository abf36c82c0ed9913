"""Markdown sidecars made from ``documents``.

The test tables hold no Markdown, so the same expression builds a sidecar for each
document in Spark and in the oracle: front matter, headings, page markers, task
lines, a table and mathematics that the detectors fire on, and the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dealt_table, table

#: One SQL expression that both engines understand.
SIDECAR_SQL = """concat(
 '---', chr(10), 'source_file: src/', source, '/', cast(doc_id as string), '.pdf', chr(10),
 'import_method: ', case when doc_id % 3 = 0 then 'mineru-agent-v1' else 'pymupdf' end, chr(10),
 'language: ', case when doc_id % 11 = 0 then 'zh' else lang end, chr(10),
 'repair_status: ', case doc_id % 4 when 0 then 'raw' when 1 then 'auto-repaired' when 2 then 'repaired' else 'reviewed' end, chr(10),
 'verify_status: ', case when doc_id % 5 = 0 then 'verified' else 'unverified' end, chr(10),
 case when doc_id % 6 = 0 then concat('repair_risk: needs-human-review', chr(10)) else '' end,
 '---', chr(10), chr(10), '# Doc ', cast(doc_id as string), chr(10), chr(10), 'Page 1', chr(10), chr(10),
 '- Due: ', case when doc_id % 7 = 0 then '' else concat('2026-0', cast(1 + doc_id % 9 as string), '-1', cast(doc_id % 10 as string)) end, chr(10),
 '- Area: ', case doc_id % 4 when 0 then 'exam' when 1 then 'reading' when 2 then 'inbox' else 'homework' end, chr(10),
 '- Priority: ', case doc_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end, chr(10), chr(10),
 '#Broken heading', chr(10), '-  Bullet', chr(10), chr(10), '## Next section ........ 4', chr(10), chr(10), chr(10),
 case when doc_id % 2 = 0 then concat('$ x = ', cast(doc_id as string), ' $', chr(10)) else concat('$y = 1', chr(10)) end,
 case when doc_id % 8 = 0 then concat('\\\\left( a \\\\right) \\\\left[ b', chr(10)) else '' end,
 case when doc_id % 9 = 0 then concat('value \\\\nonumber', chr(10)) else '' end,
 text, chr(10), chr(10), '## Page 2', chr(10), chr(10), '| a | b |', chr(10), '| --- | --- |', chr(10), '| 1 | ', cast(doc_id % 10 as string), ' |', chr(10),
 '[card](cards/', source, '.md)', chr(10))"""

#: The sidecar as a common table expression of an oracle: ``sidecars(doc_id, source, path, md)``.
SIDECARS_CTE = "sidecars as (select doc_id, source, concat('imports/', source, '/', cast(doc_id as string), '.pdf.md') path, " + SIDECAR_SQL.replace("\\\\", "\\") + " md from documents)"


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, path, md``."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("imports/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf.md"))
    return docs.select("doc_id", "source", path.alias("path"), F.expr(SIDECAR_SQL).alias("md"))


#: The same with money signs of the text replaced, so that only the mathematics above is mathematics.
RISKY_SQL = SIDECAR_SQL.replace("\n text,", "\n replace(text, '$', '¤'),")
RISKY_CTE = SIDECARS_CTE.replace("\n text,", "\n replace(text, '$', '¤'),")


def risky_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, path, md``: sidecars whose defects are known."""
    docs = dealt_table(spark, sf_dir, "documents", "doc_id")
    path = F.concat(F.lit("imports/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf.md"))
    return docs.select("doc_id", "source", path.alias("path"), F.expr(RISKY_SQL).alias("md"))


def lines(docs: DataFrame, text_col: str = "md") -> DataFrame:
    """One row for each line: ``line_no`` from 1 and ``line``; other columns stay."""
    keep = [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


LINES_CTE = SIDECARS_CTE + """,
 split_lines as (select doc_id, path, string_split(md, chr(10)) parts from sidecars),
 lines as (select doc_id, path, cast(unnest(range(1, len(parts) + 1)) as int) line_no, unnest(parts) line from split_lines)"""
