"""Lookups of queue items, sections and repeated errors over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lookups import compare_errors, find_items, select_sections
from ..sources.sidecars import LINES_CTE, sidecars
from ..sources.tables import table
from .registry import register

#: Queue items of documents: every eleventh id is no file name, every thirteenth path leaves the vault; pairs share a relative path.
ITEMS = """select case when doc_id % 11 = 10 then concat('a/', cast(doc_id as string)) else concat('item-', cast(doc_id as string)) end id,
 case when doc_id % 13 = 12 then concat('/other/', cast(doc_id as string), '.pdf.md') else concat('/vault/', source, '/', cast(doc_id as string), '.pdf.md') end path,
 concat('notes/', cast(case when doc_id % 10 = 9 then doc_id - 1 else doc_id end as string), '.pdf.md') relative_path from documents"""
REQUESTS = """select doc_id request, case doc_id % 4 when 0 then case when doc_id % 11 = 10 then concat('a/', cast(doc_id as string)) else concat('item-', cast(doc_id as string)) end
 when 1 then case when doc_id % 13 = 12 then concat('/other/', cast(doc_id as string), '.pdf.md') else concat('/vault/', source, '/', cast(doc_id as string), '.pdf.md') end
 when 2 then concat('notes/', cast(doc_id as string), '.pdf.md') else concat('none-', cast(doc_id as string)) end as key from documents"""


@register("lkp_queue_item", f"""with i as ({ITEMS}), r as ({REQUESTS}), m as (select r.request, r.key, i.id, i.path from r left join i on r.key = i.id
 union select r.request, r.key, i.id, i.path from r join i on r.key = i.path union select r.request, r.key, i.id, i.path from r join i on r.key = i.relative_path),
 g as (select request, key, count(path) n, min(id) id, min(path) path from m group by 1, 2),
 s as (select *, case when n = 0 then 'not-found' when n > 1 then 'ambiguous' when contains(id, '/') then 'unsafe-id' when not starts_with(path, '/vault/') then 'outside-root' else 'found' end state from g)
select request, key, case when state = 'found' then id end item, state from s""")
def lkp_queue_item(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items, requests = (spark.sql(q.replace("from documents", "from {docs}"), docs=docs) for q in (ITEMS, REQUESTS))
    return find_items(requests, items, F.lit("/vault"))


HEADING = "^#{1,3} "


@register("sel_sections", f"""with {LINES_CTE}, h as (select doc_id, line_no, row_number() over (partition by doc_id order by line_no) nth, lead(line_no) over (partition by doc_id order by line_no) nxt from lines where regexp_matches(line, '{HEADING}')),
 t as (select doc_id, max(line_no) total from lines group by 1), s as (select h.doc_id, concat('s', cast(nth as string)) section_id, line_no start_line, coalesce(nxt - 1, total) end_line from h join t using (doc_id)),
 q as (select doc_id, unnest(['s1', 's2', 's99', 'lines 3-9', 'line:' || cast(1 + doc_id % 40 as string), 'lines-20..30', 'x 1-2']) selector from sidecars),
 k as (select q.doc_id, q.selector, case when s.section_id is not null then 'section' when regexp_matches(selector, '^lines?[-: ]') then 'lines' else 'unknown' end kind,
  coalesce(s.start_line, try_cast(regexp_extract(selector, '^lines?[-: ]([0-9]+)', 1) as int)) start_line, coalesce(s.end_line, try_cast(regexp_extract(selector, '([0-9]+)$', 1) as int)) end_line from q left join s on s.doc_id = q.doc_id and s.section_id = q.selector)
select k.doc_id, selector, kind, case when kind <> 'unknown' then k.start_line end start_line, case when kind <> 'unknown' then k.end_line end end_line, count(s.doc_id) met
from k left join s on s.doc_id = k.doc_id and kind <> 'unknown' and k.start_line <= s.end_line and k.end_line >= s.start_line group by all""")
def sel_sections(spark, sf_dir):
    """Sections of sidecars by id, ranges of their lines, and selectors that name nothing."""
    docs = sidecars(spark, sf_dir)
    parts = F.split("md", "\n")
    heads = F.array_compact(F.transform(parts, lambda line, i: F.when(line.rlike(HEADING), i + 1)))
    spans = F.transform(heads, lambda at, i: F.struct(F.concat(F.lit("s"), (i + 1).cast("string")).alias("section_id"), at.cast("int").alias("start_line"), F.coalesce(F.get(heads, i + 1) - 1, F.size(parts)).cast("int").alias("end_line")))
    sections = docs.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*")
    wanted = F.array(*map(F.lit, ["s1", "s2", "s99", "lines 3-9"]), F.concat(F.lit(" line:"), (F.col("doc_id") % 40 + 1).cast("string")), F.lit("lines-20..30"), F.lit("x 1-2"), F.lit("s1 "))
    return select_sections(sections, docs.select("doc_id", F.explode(wanted).alias("selector")))


@register("inc_baseline", """with e as (select conv_id, unnest(string_split(regexp_replace(text, '[.!?]+', ' ', 'g'), ' ')) word from conversations),
 b as (select word, count(*) n from e where conv_id % 3 <> 0 and word <> '' group by 1), a as (select word, count(*) n from e where conv_id % 3 <> 1 and word <> '' group by 1)
select coalesce(a.word, b.word) word, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) as new, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) cleared, least(coalesce(a.n, 0), coalesce(b.n, 0)) unchanged from a full join b on a.word = b.word""")
def inc_baseline(spark, sf_dir):
    """Words of two overlapping sets of conversations stand for errors of two checks, most of them repeated."""
    words = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.split(F.regexp_replace("text", "[.!?]+", " "), " ")).alias("word")).where("word <> ''")
    return compare_errors(words.where("conv_id % 3 <> 0"), words.where("conv_id % 3 <> 1"), "word")
