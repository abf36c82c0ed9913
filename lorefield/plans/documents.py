"""Document family: front matter, lines, sections, as-of pages, range and interval joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.sidecars import LINES_CTE, SIDECARS_CTE, lines, sidecars
from ..sources.tables import table
from .registry import register


@register("fm_governance", f"with {SIDECARS_CTE} select doc_id, regexp_extract(md, '(?m)^import_method: (.*)$', 1) import_method, regexp_extract(md, '(?m)^language: (.*)$', 1) language, nullif(regexp_extract(md, '(?m)^repair_risk: (.*)$', 1), '') repair_risk from sidecars")
def fm_governance(spark, sf_dir):
    fields = sidecars(spark, sf_dir).select("doc_id", X.front_matter_map(F.col("md")).alias("fm"))
    return fields.select("doc_id", *(F.try_element_at("fm", F.lit(k)).alias(k) for k in ("import_method", "language", "repair_risk")))


@register("fm_has", f"with {SIDECARS_CTE} select doc_id, starts_with(md, concat('---', chr(10))) has_fm, starts_with(substr(md, 5), '---') body_fm from sidecars")
def fm_has(spark, sf_dir):
    return sidecars(spark, sf_dir).select("doc_id", X.front_matter(F.col("md")).isNotNull().alias("has_fm"), X.front_matter(F.substring("md", 5, 1 << 30)).isNotNull().alias("body_fm"))


@register("fm_scalar_field", f"with {SIDECARS_CTE} select doc_id, regexp_extract(md, '(?m)^repair_status: (.*)$', 1) repair_status, regexp_extract(md, '(?m)^verify_status: (.*)$', 1) verify_status from sidecars")
def fm_scalar_field(spark, sf_dir):
    return sidecars(spark, sf_dir).select("doc_id", X.field(F.col("md"), "repair_status").alias("repair_status"), X.field(F.col("md"), "verify_status").alias("verify_status"))


@register("md_title", f"with {SIDECARS_CTE} select doc_id, concat('Doc ', cast(doc_id as string)) title from sidecars")
def md_title(spark, sf_dir):
    return sidecars(spark, sf_dir).select("doc_id", X.title(F.col("md"), F.col("path")).alias("title"))


@register("md_detail", f"with {SIDECARS_CTE} select doc_id, trim(regexp_extract(md, '(?m)^- Area: (.*)$', 1)) area, trim(regexp_extract(md, '(?m)^- Due: (.*)$', 1)) due from sidecars")
def md_detail(spark, sf_dir):
    return sidecars(spark, sf_dir).select("doc_id", X.detail(F.col("md"), "AREA").alias("area"), X.detail(F.col("md"), "due").alias("due"))


@register("fn_headings", f"with {SIDECARS_CTE} select doc_id, array_to_string(regexp_extract_all(md, '(?m)^#{{1,6}} +(.+)$', 1), '|') headings from sidecars")
def fn_headings(spark, sf_dir):
    found = F.regexp_extract_all("md", F.lit("(?md)^#{1,6} +(.+)$"), F.lit(1))
    return sidecars(spark, sf_dir).select("doc_id", F.array_join(found, "|").alias("headings"))


@register("scan_lines", f"with {LINES_CTE} select doc_id, line_no, line from lines")
def scan_lines(spark, sf_dir):
    return lines(sidecars(spark, sf_dir).select("doc_id", "md")).select("doc_id", "line_no", "line")


def _sections(df):
    """Sections begin at level-two headings; each ends before the next; at most 24 count."""
    starts = df.where(F.col("line").rlike("^## ")).select("doc_id", F.col("line_no").alias("start_line"), F.substring("line", 4, 1 << 20).alias("title"))
    order = W.partitionBy("doc_id").orderBy("start_line")
    placed = starts.withColumn("seq", F.row_number().over(order)).withColumn("end_line", F.coalesce(F.lead("start_line").over(order) - 1, F.lit(2147483647)))
    return placed.where("seq <= 24")


SECTIONS = """heads as (select doc_id, line_no start_line, substr(line, 4) title, row_number() over (partition by doc_id order by line_no) seq, lead(line_no) over (partition by doc_id order by line_no) nxt from lines where starts_with(line, '## ')),
 sections as (select doc_id, cast(seq as int) seq, start_line, cast(coalesce(nxt - 1, 2147483647) as int) end_line, title from heads where seq <= 24)"""


@register("lead_section_end", f"with {LINES_CTE}, {SECTIONS} select doc_id, seq, start_line, end_line, title from sections")
def lead_section_end(spark, sf_dir):
    return _sections(lines(sidecars(spark, sf_dir).select("doc_id", "md"))).select("doc_id", "seq", "start_line", "end_line", "title")


@register("join_section_range", f"with {LINES_CTE}, {SECTIONS}, odd as (select doc_id, line_no from lines where (len(line) - len(replace(line, '$', ''))) % 2 = 1) select o.doc_id, o.line_no, s.seq, s.title from odd o left join sections s on o.doc_id = s.doc_id and o.line_no between s.start_line and s.end_line")
def join_section_range(spark, sf_dir):
    all_ = lines(sidecars(spark, sf_dir).select("doc_id", "md"))
    odd = all_.where(X.count_of(F.col("line"), "\\$") % 2 == 1).select("doc_id", "line_no")
    return odd.alias("o").join(_sections(all_).alias("s"), F.expr("o.doc_id = s.doc_id and o.line_no between s.start_line and s.end_line"), "left").select("o.doc_id", "o.line_no", "s.seq", "s.title")


@register("join_page_asof", f"""with {LINES_CTE}, m as (select doc_id, line_no, line, try_cast(nullif(regexp_extract(line, '^(?:## )?Page ([0-9]+)$', 1), '') as int) page from lines)
select doc_id, line_no, last_value(page ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) page from m where true qualify (len(line) - len(replace(line, '$', ''))) % 2 = 1""")
def join_page_asof(spark, sf_dir):
    """A document's lines and markers stay in its row; only the lines asked for become rows."""
    page = lambda x: F.nullif(F.regexp_extract(x, "^(?:## )?Page ([0-9]+)$", 1), F.lit("")).try_cast("int")
    rows = sidecars(spark, sf_dir).select("doc_id", F.split("md", "\n").alias("rows"))
    marks = F.filter(F.transform("rows", lambda x, i: F.struct(i.alias("at"), page(x).alias("page"))), lambda m: m["page"].isNotNull())
    odd = F.array_compact(F.transform("rows", lambda x, i: F.when(X.count_of(x, "\\$") % 2 == 1, i)))
    hits = rows.select("doc_id", marks.alias("marks"), F.explode(odd).alias("at"))
    return hits.select("doc_id", (F.col("at") + 1).alias("line_no"), F.try_element_at(F.filter("marks", lambda m: m["at"] <= F.col("at")), F.lit(-1))["page"].alias("page"))


@register("last_marker_carry", "select event_id, user_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) last_signup from events")
def last_marker_carry(spark, sf_dir):
    seen = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    marker = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(marker, ignorenulls=True).over(seen).alias("last_signup"))


@register("join_interval_overlap", f"""with {LINES_CTE}, {SECTIONS}, c as (select doc_id, 20 + doc_id % 10 a, 24 + doc_id % 17 b from documents)
select c.doc_id, c.a, c.b, coalesce(s.title, concat('lines-', cast(a as string), '-', cast(b as string))) section from c left join sections s on c.doc_id = s.doc_id and c.a <= s.end_line and c.b >= s.start_line""")
def join_interval_overlap(spark, sf_dir):
    docs = sidecars(spark, sf_dir).select("doc_id", "md")
    changed = docs.select("doc_id", (20 + F.col("doc_id") % 10).alias("a"), (24 + F.col("doc_id") % 17).alias("b"))
    hit = changed.alias("c").join(_sections(lines(docs)).alias("s"), F.expr("c.doc_id = s.doc_id and c.a <= s.end_line and c.b >= s.start_line"), "left")
    return hit.select("c.doc_id", "c.a", "c.b", F.coalesce("s.title", F.concat(F.lit("lines-"), F.col("c.a").cast("string"), F.lit("-"), F.col("c.b").cast("string"))).alias("section"))


@register("fn_visible_text", "select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) visible from pages")
def fn_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.visible_html(F.col("html")).alias("visible"))


@register("src_md_block", f"with {LINES_CTE} select doc_id, regexp_extract(line, '^\\[([^\\]]*)\\]\\(([^)]*)\\)$', 1) title, regexp_extract(line, '^\\[([^\\]]*)\\]\\(([^)]*)\\)$', 2) target from lines where regexp_matches(line, '^\\[[^\\]]*\\]\\([^)]*\\)$')")
def src_md_block(spark, sf_dir):
    pattern = r"^\[([^\]]*)\]\(([^)]*)\)$"
    hit = lines(sidecars(spark, sf_dir).select("doc_id", "md")).where(F.col("line").rlike(pattern))
    return hit.select("doc_id", F.regexp_extract("line", pattern, 1).alias("title"), F.regexp_extract("line", pattern, 2).alias("target"))


@register("fn_table_cells", f"with {LINES_CTE} select doc_id, line_no, array_to_string(list_transform(string_split(substr(line, 2, length(line) - 2), '|'), lambda x: trim(x)), ';') cells from lines where starts_with(line, '| ')")
def fn_table_cells(spark, sf_dir):
    rows = lines(sidecars(spark, sf_dir).select("doc_id", "md")).where(F.startswith("line", F.lit("| ")))
    inner = F.replace(F.regexp_replace("line", r"^\||\|$", ""), F.lit("\\|"), F.lit("\u0001"))
    cells = F.transform(F.split(inner, r"\|"), lambda c: F.replace(F.trim(c), F.lit("\u0001"), F.lit("|")))
    return rows.select("doc_id", "line_no", F.array_join(cells, ";").alias("cells"))


@register("fn_fenced_block", "select doc_id, repeat('`', cast(greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1) as int)) fence from documents")
def fn_fenced_block(spark, sf_dir):
    runs = F.transform(F.regexp_extract_all("text", F.lit("`+"), F.lit(0)), lambda x: F.char_length(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)).alias("fence"))


@register("fn_excerpt", "select doc_id, case when length(text) > 120 then concat(substr(text, 1, 120), '...') else text end excerpt from documents")
def fn_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.char_length("text") > 120, F.concat(F.left("text", F.lit(120)), F.lit("..."))).otherwise(F.col("text")).alias("excerpt"))


@register("fn_page_selection", "with p as (select o_orderkey, o_orderkey % 7 + 1 a, o_orderkey % 7 + 1 + o_orderkey % 4 b, o_orderkey % 20 + 9 c from orders) select o_orderkey, cast(unnest(list_distinct(list_concat(range(a, b + 1), [c]))) as int) page from p")
def fn_page_selection(spark, sf_dir):
    k = F.col("o_orderkey")
    made = F.concat((k % 7 + 1).cast("string"), F.lit("-"), (k % 7 + 1 + k % 4).cast("string"), F.lit(","), (k % 20 + 9).cast("string"))
    part = lambda p: F.sequence(F.substring_index(p, "-", 1).cast("int"), F.substring_index(p, "-", -1).cast("int"))
    pages = F.array_distinct(F.flatten(F.transform(F.split(made, ","), part)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(pages).alias("page"))
