"""Risk family: detectors, roll-ups, scores, routing; and deterministic repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python import per_value
from ..operators import mathscan as M
from ..operators import repair as P
from ..operators import risks as R
from ..sources.sidecars import RISKY_CTE, SIDECARS_CTE, risky_sidecars, sidecars
from ..sources.tables import table
from .cases import cases, dealt, sql_literal
from .registry import register

#: What is known of the defects that each sidecar has: the rules worked out for the lines it is made of.
RISKS = RISKY_CTE + r""",
 m as (select doc_id, md, 23 + case when doc_id % 6 = 0 then 1 else 0 end l1, length(md) - position(concat(chr(10), '---', chr(10)) in md) - 4 body from sidecars),
 risks as (
  select doc_id, 'inline-math-delimiter-space' code, l1 line_no from m where doc_id % 2 = 0
  union all select doc_id, 'math-dollar-odd-line', l1 from m where doc_id % 2 = 1
  union all select doc_id, 'math-dollar-unbalanced', null from m where doc_id % 2 = 1
  union all select doc_id, 'latex-left-right-unbalanced', null from m where doc_id % 8 = 0
  union all select doc_id, 'legacy-repaired-unverified', null from m where doc_id % 4 = 2 and doc_id % 5 <> 0
  union all select doc_id, 'frontmatter-repair-risk', null from m where doc_id % 6 = 0
  union all select doc_id, 'low-cjk-density', null from m where doc_id % 11 = 0 and body > 2000),
 meta(code, severity, actionability, pts, seq) as (values
  ('inline-math-delimiter-space', 'error', 'localized-render-repair', 160, 9), ('math-dollar-odd-line', 'error', 'localized-render-repair', 120, 13),
  ('math-dollar-unbalanced', 'warning', 'inspect-local-snippets-only', 20, 12), ('latex-left-right-unbalanced', 'error', 'localized-render-repair', 120, 4),
  ('legacy-repaired-unverified', 'warning', 'metadata-governance', 30, 16), ('frontmatter-repair-risk', 'warning', 'human-review-required', 30, 17),
  ('low-cjk-density', 'warning', 'inspect-local-snippets-only', 30, 14)),
 points as (select doc_id, cast(sum(pts) as bigint) score from risks join meta using (code) group by 1)"""


def _risks(spark, sf_dir):
    return R.detect(risky_sidecars(spark, sf_dir))


def _records(spark, sf_dir):
    return R.records(_risks(spark, sf_dir))


@register("risk_detectors", f"with {RISKS} select doc_id, cast(line_no as int) line_no, code, severity from risks join meta using (code)")
def risk_detectors(spark, sf_dir):
    known = F.broadcast(R.metadata(spark).select("code", "severity"))  # a row for each code
    return _risks(spark, sf_dir).join(known, "code").select("doc_id", "line_no", "code", "severity")


@register("agg_affected_lines", f"with {RISKS} select doc_id, code, 1 \"count\", coalesce(cast(line_no as string), '') sample, false truncated from risks")
def agg_affected_lines(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", "code", "count", F.array_join(F.col("sample").cast("array<string>"), ",").alias("sample"), "truncated")


@register("agg_merge_risks", f"with {RISKS}, twice as (select *, 'scan' told_by from risks union all select *, 'import' from risks where doc_id % 3 = 0) select doc_id, code, count(*) n, max(told_by) told_by from twice group by 1, 2")
def agg_merge_risks(spark, sf_dir):
    """Records of two scanners merged by code: counts add up, what the first one said stays."""
    scanned, imported = (F.struct(F.lit(k).alias("seq"), F.lit(name).alias("told_by")) for k, name in enumerate(("scan", "import")))
    told = F.when(F.col("doc_id") % 3 == 0, F.array(scanned, imported)).otherwise(F.array(scanned))
    both = _risks(spark, sf_dir).select("doc_id", "code", F.inline(told))  # texts are read once for both
    return both.groupBy("doc_id", "code").agg(F.count("*").alias("n"), F.min_by("told_by", "seq").alias("told_by"))


@register("agg_severity", f"with {RISKS} select doc_id, max(case severity when 'error' then 3 when 'warning' then 2 else 1 end) worst from risks join meta using (code) group by 1")
def agg_severity(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("doc_id").agg(F.max(R.severity_rank(F.col("severity"))).alias("worst"))


@register("agg_risk_score", f"with {RISKS} select doc_id, score from points")
def agg_risk_score(spark, sf_dir):
    each = R.points(F.col("severity"), F.col("actionability"), F.col("code"))
    return _records(spark, sf_dir).groupBy("doc_id").agg(F.sum(each).alias("score"))


@register("agg_primary_risk", "select doc_id, case when doc_id % 2 = 0 then 'inline-math-delimiter-space' else 'math-dollar-odd-line' end primary_risk from documents")
def agg_primary_risk(spark, sf_dir):
    return R.primary(_records(spark, sf_dir))


#: Records of made-up documents: codes in the order in which they are told, and the one that comes first.
PRIMARY = [
    (["unicode-escape", "legacy-repaired-unverified"], "legacy-repaired-unverified"),
    (["math-dollar-unbalanced", "low-cjk-density"], "low-cjk-density"),  # not a guess
    (["question-heading-promoted", "control-character"], "control-character"),  # more local
    (["math-dollar-odd-line", "latex-array-column-mismatch"], "latex-array-column-mismatch"),
    (["latex-math-span-brace-unbalanced", "inline-math-delimiter-space"], "inline-math-delimiter-space"),  # equal: the first told
    (["unicode-escape"], "unicode-escape"),
    (["mojibake-replacement-char", "ocr-symbol-garbage", "non-utf8-import"], "mojibake-replacement-char"),
]


@register("agg_primary_of_equals", "select doc_id, list_value(" + ", ".join(sql_literal(x) for _, x in PRIMARY) + f")[doc_id % {len(PRIMARY)} + 1] primary_risk from documents")
def agg_primary_of_equals(spark, sf_dir):
    told = dealt([",".join(codes) for codes, _ in PRIMARY])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(told, ",")).alias("code"))
    return R.primary(rows.join(F.broadcast(R.metadata(spark)), "code"))


@register("agg_blocking", f"with {RISKS} select doc_id, count(*) n, count(*) n_lines from risks where code in ('inline-math-delimiter-space', 'math-dollar-odd-line', 'latex-left-right-unbalanced') group by 1")
def agg_blocking(spark, sf_dir):
    docs = risky_sidecars(spark, sf_dir)
    return blocking_lines(R.detect(docs), docs)


def blocking_lines(risks, docs):
    """Blocking defects, and all lines they are on; for a defect of a whole document its first telling line."""
    blocking = R.records(risks).where(F.col("code").isin(*R.BLOCKING))
    lines = F.array_union("lines", F.array_compact(F.array(F.col("at") + 1)))
    rows = placed(blocking.select("doc_id", "code", "count", "lines"), docs).select("doc_id", "count", lines.alias("lines"))
    return rows.groupBy("doc_id").agg(F.sum("count").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("lines")))).cast("bigint").alias("n_lines"))


# A line that tells of each defect.
TELLING = {
    "mojibake-replacement-char": r"�", "unicode-escape": r"\\u[0-9a-fA-F]{4}", "latex-nonumber": r"\\nonumber\b", "latex-binom-fragment": r"\\binom\b",
    "latex-left-right-unbalanced": r"\\(?:left|right)\b", "latex-array-column-mismatch": r"\\begin\{array\}",
    "latex-math-span-brace-unbalanced": r"(?<!\\)(?<!\$)\$(?!\$).*?(?<!\\)(?<!\$)\$(?!\$)", "latex-array-wrapper-malformed": r"\\begin\{array\}\s*\{[^}]*\}\s*\{",
    "obsidian-inline-array-render-risk": r"(?<!\\)\$.*\\begin\{(?:array|matrix|[pbvBV]?matrix)\}.*(?<!\\)\$", "display-math-delimiter-not-standalone": r"(?<!\\)\$\$",
    "inline-math-delimiter-space": r"(?<!\\)(?<!\$)\$(?!\$)\s|\s(?<!\\)(?<!\$)\$(?!\$)", "math-dollar-unbalanced": r"\$", "math-dollar-odd-line": r"\$",
    "lossy-ocr-placeholder": r"□", "question-heading-promoted": r"^##\s+[一二三四五六七八九十]+[\.、]", "answer-missing-question-stem": r"^\s*(?:解|证明|答)[:：]",
    "control-character": r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "ocr-symbol-garbage": r"\\boxplus|\\neg\s*\\neg|\\\s+Y(?:\s+Y)+",
    "legacy-repaired-unverified": r"^repair_status:\s*repaired\b", "frontmatter-repair-risk": r"^repair_risk:\s*needs-human-review\b", "non-utf8-import": r"�",
}


def placed(codes, docs):
    """``codes`` (``doc_id, code`` and others) with the text and ``at``, the place of the first line that tells of the defect; null without one."""
    rows = F.split("md", "\n")
    first_line = lambda pattern: F.get(F.array_compact(F.transform(rows, lambda x, i: F.when(x.rlike(pattern), i))), F.lit(0))
    first = F.lit(None).cast("int")
    for code, pattern in TELLING.items():
        first = F.when(F.col("code") == code, first_line(pattern)).otherwise(first)
    return codes.join(docs.select("doc_id", "md"), "doc_id", "left").withColumn("at", first)


def snippets(codes, docs):
    """``doc_id, code, line, excerpt``: the first line that tells of a defect, with two lines before and after."""
    begin = F.greatest(F.col("at") - 2, F.lit(0))
    excerpt = F.array_join(F.slice(F.split("md", "\n"), begin + 1, F.col("at") + 3 - begin), "\n")
    found = F.when(F.col("at").isNotNull(), F.struct((F.col("at") + 1).alias("line"), excerpt.alias("excerpt")))
    # outer, as the optimizer would otherwise look for the lines twice, to leave out what has none before
    return placed(codes, docs).select("doc_id", "code", F.explode_outer(F.array(found)).alias("f")).where("f is not null").select("doc_id", "code", "f.line", "f.excerpt")


@register("risk_snippets", f"""with {RISKS}, told as (select doc_id, code, case code when 'latex-left-right-unbalanced' then l1 + 1 when 'legacy-repaired-unverified' then 5 when 'frontmatter-repair-risk' then 7 else l1 end line from risks join m using (doc_id) where code <> 'low-cjk-density')
select doc_id, code, cast(line as int) line, array_to_string(string_split(md, chr(10))[greatest(line - 2, 1):line + 2], chr(10)) excerpt from told join m using (doc_id)""")
def risk_snippets(spark, sf_dir):
    docs = risky_sidecars(spark, sf_dir)
    return snippets(_risks(spark, sf_dir).select("doc_id", "code").distinct(), docs)


@register("agg_repair_scope", f"with {RISKS} select doc_id, 'single-section' scope from documents")
def agg_repair_scope(spark, sf_dir):
    docs = risky_sidecars(spark, sf_dir)
    blocking = _records(spark, sf_dir).where(F.col("code").isin(*R.BLOCKING)).groupBy("doc_id").agg(F.sum("count").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    rows = docs.join(blocking, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("lines", F.array().cast("array<int>")).alias("lines"), R.section_starts(F.col("md")).alias("starts"))
    sections = F.transform("lines", lambda x: R.section_of(F.col("starts"), x))
    return rows.select("doc_id", R.scope(F.col("n"), F.col("lines"), sections).alias("scope"))


@cases("agg_repair_scopes", [
    ("# a\nx\n## b\ny", "2", 1, "single-section"), ("# a\nx\n## b\ny", "2,4", 2, "widened"), ("x\n# a", "1", 1, "blocked"), ("x\n# a\ny", "1,3", 2, "widened"),
    ("# a", "", 0, "metadata-or-nonblocking"), ("一、甲\nx\n二、乙\ny\n(3) 丙\nz", "1,2", 2, "single-section"), ("第1题\n1. a\nb\n第2、c", "3,2", 2, "single-section"),
    ("\n".join(f"# h{i}" for i in range(30)), "26", 1, "blocked"), ("# a\nx", "", 1, "blocked"),
])
def scope_of_text(md, lines, blocking):
    numbers = F.transform(F.filter(F.split(lines, ","), lambda x: x != ""), lambda x: x.cast("int"))
    sections = F.transform(numbers, lambda x: R.section_of(R.section_starts(md), x))
    return R.scope(blocking, numbers, sections)


@register("topk_queue", f"with {RISKS} select doc_id, score from points order by score desc, doc_id limit 50")
def topk_queue(spark, sf_dir):
    return agg_risk_score(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(50)


@register("topk_next_repairable", f"with {RISKS} select p.doc_id, score from points p join m using (doc_id) where not contains(md, 'verify_status: verified') order by score desc, doc_id limit 1")
def topk_next_repairable(spark, sf_dir):
    open_ = risky_sidecars(spark, sf_dir).where(X.field(F.col("md"), "verify_status") != "verified").select("doc_id")
    return agg_risk_score(spark, sf_dir).join(open_, "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(1)


@register("cls_evidence", f"""with {RISKS}, c as (select doc_id, list(distinct code) codes from risks group by 1)
select doc_id, case when list_contains(codes, 'low-cjk-density') then 'semantic-text-repair' when doc_id % 2 = 0 then 'format-only' else 'format-only' end "class",
 case when list_contains(codes, 'low-cjk-density') and doc_id % 4 <> 1 then 'vision-assisted' else 'text-only' end "mode",
 case when list_contains(codes, 'low-cjk-density') and doc_id % 4 <> 1 and doc_id % 10 = 3 then 'requires-vision-evidence' else '' end blocked from c""")
def cls_evidence(spark, sf_dir):
    """Raw imports exist for every fourth sidecar, sources for nine in ten, paired sidecars for none."""
    codes = _risks(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
    record = R.evidence(F.col("codes"), F.col("doc_id") % 4 == 1, F.col("doc_id") % 10 != 3, F.lit(False))
    return codes.select("doc_id", record.alias("r")).select("doc_id", "r.*")


@cases("cls_evidence_table", [
    ("unicode-escape", False, False, False, "metadata-only|text-only|"), ("legacy-repaired-unverified,frontmatter-repair-risk", True, True, True, "metadata-only|text-only|"),
    ("answer-missing-question-stem", False, False, True, "answer-paper-crosscheck|text-only|"), ("answer-missing-question-stem", False, True, False, "answer-paper-crosscheck|vision-assisted|"),
    ("answer-missing-question-stem,low-cjk-density", False, False, False, "answer-paper-crosscheck|vision-assisted|requires-vision-evidence"),
    ("low-cjk-density", True, False, False, "semantic-text-repair|text-only|"), ("mojibake-replacement-char,latex-nonumber", False, True, False, "semantic-text-repair|vision-assisted|"),
    ("ocr-symbol-garbage", False, False, True, "semantic-text-repair|vision-assisted|requires-vision-evidence"), ("latex-nonumber,math-dollar-odd-line", False, False, False, "format-only|text-only|"),
    ("math-dollar-odd-line", False, True, False, "requires-ocr|ocr-assisted|"), ("math-dollar-odd-line", True, True, False, "unrecoverable-with-current-evidence|text-only|unrecoverable-with-current-evidence"),
])
def evidence_of(codes, raw, source, paired):
    r = R.evidence(F.split(codes, ","), raw, source, paired)
    return F.concat_ws("|", r["class"], r["mode"], r["blocked"])


@register("set_blocking_codes", f"with {RISKS} select doc_id, string_agg(distinct code, ',' order by code) codes from risks where code in ('latex-left-right-unbalanced', 'math-dollar-odd-line', 'inline-math-delimiter-space') group by 1")
def set_blocking_codes(spark, sf_dir):
    found = _risks(spark, sf_dir).groupBy("doc_id").agg(F.array_intersect(F.sort_array(F.collect_set("code")), F.array(*map(F.lit, R.BLOCKING))).alias("codes"))
    return found.where(F.size("codes") > 0).select("doc_id", F.array_join("codes", ",").alias("codes"))


@register("set_risk_codes", f"with {RISKS} select doc_id, string_agg(distinct code, ',' order by code) codes from risks group by 1")
def set_risk_codes(spark, sf_dir):
    return _risks(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))


@register("agg_risk_count", f"with {RISKS} select doc_id, code, 1 n from risks")
def agg_risk_count(spark, sf_dir):
    """The recorded count, or the number of lines, and one at least."""
    return _records(spark, sf_dir).select("doc_id", "code", F.greatest(F.coalesce(F.nullif("count", F.lit(0)), F.size("sample")), F.lit(1)).alias("n"))


@register("agg_risk_lines", f"with {RISKS} select doc_id, code, cast(line_no as string) line_nos from risks where line_no is not null")
def agg_risk_lines(spark, sf_dir):
    hit = _risks(spark, sf_dir).where("line_no is not null").groupBy("doc_id", "code").agg(F.array_sort(F.collect_set("line_no")).alias("l"))
    return hit.select("doc_id", "code", F.array_join(F.col("l").cast("array<string>"), ",").alias("line_nos"))


@register("risk_metadata", f"with {RISKS} select code, severity, actionability from meta")
def risk_metadata(spark, sf_dir):
    seen = _risks(spark, sf_dir).select("code").distinct()
    return R.metadata(spark).join(seen, "code", "left_semi").select("code", "severity", "actionability")


@register("qc_import_check", f"""with {RISKS}, f as (select doc_id, case when doc_id % 3 = 0 then l1 else 2 end focus from m where doc_id % 5 <> 0)
select f.doc_id, count(*) filter (code in ('inline-math-delimiter-space', 'math-dollar-odd-line') and line_no = focus) + count(*) filter (code = 'latex-left-right-unbalanced') blocking,
 count(*) filter (code in ('inline-math-delimiter-space', 'math-dollar-odd-line') and line_no <> focus) out_of_focus,
 count(*) filter (code not in ('inline-math-delimiter-space', 'math-dollar-odd-line', 'latex-left-right-unbalanced')) warnings from f join risks using (doc_id) group by 1""")
def qc_import_check(spark, sf_dir):
    """Blocking and other defects of files that are not verified; defects outside the lines in focus do not block."""
    docs = risky_sidecars(spark, sf_dir).where(X.field(F.col("md"), "verify_status") != "verified")
    first = F.get(F.array_compact(F.transform(F.split("md", "\n"), lambda x, i: F.when(x.contains("$"), i + 1))), F.lit(0))
    focus = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, first).otherwise(2).alias("focus"))
    found = R.detect(docs).join(focus, "doc_id")
    blocks = F.col("code").isin(*R.BLOCKING)
    inside = F.col("line_no").isNull() | (F.col("line_no") == F.col("focus"))
    return found.groupBy("doc_id").agg(F.count_if(blocks & inside).alias("blocking"), F.count_if(blocks & ~inside).alias("out_of_focus"), F.count_if(~blocks).alias("warnings"))


@register("risk_left_right", f"with {SIDECARS_CTE} select doc_id, len(regexp_extract_all(md, '\\\\left\\b')) n_left, len(regexp_extract_all(md, '\\\\right\\b')) n_right from sidecars where len(regexp_extract_all(md, '\\\\left\\b')) <> len(regexp_extract_all(md, '\\\\right\\b'))")
def risk_left_right(spark, sf_dir):
    both = sidecars(spark, sf_dir).select("doc_id", X.count_of(F.col("md"), r"\\left\b").cast("bigint").alias("n_left"), X.count_of(F.col("md"), r"\\right\b").cast("bigint").alias("n_right"))
    return both.where("n_left <> n_right")


@register("risk_low_cjk", f"with {RISKS} select doc_id from risks where code = 'low-cjk-density'")
def risk_low_cjk(spark, sf_dir):
    return risky_sidecars(spark, sf_dir).where(R.low_cjk(F.col("md"), X.front_matter_map(F.col("md")))).select("doc_id")


@register("fn_mojibake", "with t as (select doc_id, regexp_replace(text, '\\s', '', 'g') x from documents), m as (select doc_id, length(x) n, len(regexp_extract_all(x, '[\u0080-ÿ‘-‰�]')) hits, len(regexp_extract_all(x, '[\u4e00-\u9fff]')) cjk from t) select doc_id, case when n = 0 then 0.0 else round_even(cast(hits as double) / n, 4) end mojibake_ratio, case when n = 0 then 0.0 else round_even(cast(cjk as double) / n, 4) end cjk_ratio, n >= 200 and cast(hits as double) / nullif(n, 0) >= 0.15 and cast(cjk as double) / nullif(n, 0) <= 0.01 suspect from m")
def fn_mojibake(spark, sf_dir):
    bare = F.regexp_replace("text", "\\s", "")
    m = table(spark, sf_dir, "documents").select("doc_id", F.char_length(bare).alias("n"), X.count_of(bare, "[\u0080-ÿ‘-‰�]").alias("hits"), X.count_of(bare, "[\u4e00-\u9fff]").alias("cjk"))
    ratio = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n"))
    shown = lambda c: F.coalesce(F.bround(ratio(c), 4), F.lit(0.0))
    return m.select("doc_id", shown("hits").alias("mojibake_ratio"), shown("cjk").alias("cjk_ratio"), ((F.col("n") >= 200) & (ratio("hits") >= 0.15) & (ratio("cjk") <= 0.01)).alias("suspect"))


@register("fn_formula_density", "select doc_id, cast(len(regexp_extract_all(text, '[∀-⋿∫∑∏√∞≈≠≤≥±∂∇α-ωΑ-Ω]')) as double) / greatest(length(text), 1) density from documents")
def fn_formula_density(spark, sf_dir):
    hits = X.count_of(F.col("text"), "[∀-⋿∫∑∏√∞≈≠≤≥±∂∇α-ωΑ-Ω]")
    return table(spark, sf_dir, "documents").select("doc_id", (hits.cast("double") / F.greatest(F.char_length("text"), F.lit(1))).alias("density"))


@cases("fix_repair_text", [
    ("Page 3\n#Broken", "\n# Broken"), ("  Page 12  \nPage x", "\nPage x"), ("## ok", "## ok"), ("# # two", "## two"), ("#  #  # three", "### three"), ("##Tight", "## Tight"),
    ("# Title ..... 14", "# Title"), ("## Title   7", "## Title"), ("# Title 7", "# Title 7"), ("a\n\n\n\nb", "a\n\nb"), ("-   x\n*  y\n- z", "- x\n- y\n- z"), ("text - x", "text - x"),
    ("import_method: mineru-agent-v1\n\\dot{3} \\dot{x}", "import_method: mineru-agent-v1\n3 \\dot{x}"), ("import_method: pymupdf\n\\dot{3}", "import_method: pymupdf\n\\dot{3}"),
    ("import_method: mineru-agent-v1\n$$ a $$\n\n$$b$$\n$$ c $$\nend", "import_method: mineru-agent-v1\n$$a b c$$\nend"),
])
def repaired(text):
    return P.repair(text)


def _rule(name: str):
    rule = dict(M.NOISE_RULES)[name]
    return per_value(lambda x: "{1}:{0}".format(*rule(x)))


@cases("fix_ocr_dot", [(r"\dot{3}+\dot {=}", "2:3+="), (r"\dot{\lambda}x", "1:\\lambdax"), (r"\dot{x}", "0:\\dot{x}"), (r"\dot{12}", "0:\\dot{12}"), (r"\dot{ - }", "1:-"), (r"\dot{\pi}", "0:\\dot{\\pi}"), ("none", "0:none")])
def dot_noise(x):
    return _rule("dot")(x)


@cases("fix_ocr_mathrm", [(r"a\mathrm{ ~ }b", "1:ab"), (r"\mathrm{~.~}", "1:."), (r"\mathrm{\tiny ~}", "1:"), (r"\mathrm{rank}", "0:\\mathrm{rank}"), (r"\mathrm{}x", "1:x"), (r"\mathrm{?!}", "1:?!")])
def mathrm_noise(x):
    return _rule("mathrm")(x)


@cases("fix_ocr_overset", [(r"\overset{}{A}", "1:A"), (r"\stackrel{\cdot}{B}", "1:B"), (r"\overset{n}{ }", "1:n"), (r"\overset{def}{=}", "0:\\overset{def}{=}"), (r"\overset{ } {C} \stackrel{}{D}", "2:C D")])
def overset_noise(x):
    return _rule("overset")(x)


@cases("fix_ocr_texttt", [(r"\texttt{\textbf{#}:}", "1:□"), (r"\texttt { \textbf { # } } x", "1:□ x"), (r"\sharp a", "1:□ a"), (r"\sharpen", "0:\\sharpen"), (r"\\sharp", "0:\\\\sharp"), (r"\texttt{code}", "0:\\texttt{code}")])
def texttt_noise(x):
    return _rule("texttt")(x)


@cases("fix_ocr_dollars", [
    ("$$ a $$\n$$ b $$\n$$ c $$\n", "2:$$a b c$$\n"), ("$$a$$\n\n$$b$$\n\n$$c$$\nx", "4:$$a b c$$\nx"), ("$$a$$\n$$b$$\nx", "0:$$a$$\n$$b$$\nx"), ("$$a$$\n\n$$b$$\nx", "0:\n$$a$$\n$$b$$\nx"),
    ("x\n\n$$a$$\n$$b$$\n$$c$$\n", "3:x\n$$a b c$$\n"), ("$$\na\n$$\n", "0:$$\na\n$$\n"), ("plain", "0:plain"),
])
def dollar_runs(x):
    return _rule("dollars")(x)


@cases("fix_inline_array", [
    (r"so $\begin{array}{c} 1 \end{array}$ holds", "so\n\n$$\n\\begin{array}{c} 1 \\end{array}\n$$\n\nholds"), (r"$\begin{pmatrix} 1 \end{pmatrix}$", "$$\n\\begin{pmatrix} 1 \\end{pmatrix}\n$$"),
    (r"a $\begin{matrix}1\end{matrix}$ and $\begin{matrix}2\end{matrix}$", "a\n\n$$\n\\begin{matrix}1\\end{matrix}$ and $\\begin{matrix}2\\end{matrix}\n$$"), (r"$x$", None), (r"\$\begin{array}\$", None), ("", None),
])
def inline_array(line):
    return per_value(lambda x: None if (new := M.display_of_matrix(x)) is None else "\n".join(new))(line)


@cases("fix_display_delim", [("see $$x$$ now", "see\n$$\nx\n$$\nnow"), ("$$x", "$$\nx"), ("$$", None), ("$$$$", None), ("no math", None), ("a $$", "a\n$$"), ("$$ x $$", "$$\nx\n$$")])
def display_delim(line):
    return per_value(lambda x: None if (new := M.display_alone(x)) is None else "\n".join(new))(line)


@cases("fix_delim_space", [
    ("$ x = A^{-1}b $", "$x = A^{-1}b$"), ("$x$ and $ y_1 $", "$x$ and $y_1$"), ("$ 12 $", None), ("$ 3 apples $", None), ("$ words only $", None), ("$x$", None), (r"\$ x = 1 \$", None), ("$$ x = 1 $$", None), ("$ 中 $", "$中$"), ("$ sin x$", "$sin x$"),
])
def delim_space(line):
    return per_value(lambda x: None if (new := M.tight_inline(x)) is None else "\n".join(new))(line)


@cases("fix_first_applicable", [
    ("a\n$ x = 1 $\nb $$y$$", "a\n$x = 1$\nb\n$$\ny\n$$\n|2:inline-math-delimiter-space,3:display-math-delimiter-not-standalone"),
    (r"$\begin{array}{c}1\end{array}$ $ x = 1 $", "$$\n\\begin{array}{c}1\\end{array}\n$$\n\n$ x = 1 $\n|1:obsidian-inline-array-render-risk"), ("a\r\nb\n\n", "a\nb\n|"), ("", "\n|"),
])
def first_applicable(text):
    def run(x):
        fixed, changes = M.repair_section(x)
        return fixed + "|" + ",".join(f"{n}:{c}" for n, c in changes)

    return per_value(run)(text)


@register("fix_frontmatter", "select doc_id, concat('---', chr(10), 'source: ', source, chr(10), '---', chr(10), chr(10), text) fixed from documents")
def fix_frontmatter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.ensure_front_matter(F.col("text"), F.concat(F.lit("source: "), "source")).alias("fixed"))


@cases("fix_govern", [
    ("---\nrepair_status: raw\n---\nbody", False, "---\nrepair_status: auto-repaired\nverify_status: unverified\n---\nbody"),
    ("---\na: 1\nverify_status: verified\n---\nrepair_status: x", False, "---\na: 1\nverify_status: unverified\nrepair_status: auto-repaired\n---\nrepair_status: x"),
    ("---\na: 1\n---\n", True, "---\na: 1\nrepair_status: auto-repaired\nverify_status: unverified\nrepair_risk: needs-human-review\n---\n"),
    ("---\nrepair_risk: needs-human-review\nb: 2\n---\n", False, "---\nb: 2\nrepair_status: auto-repaired\nverify_status: unverified\n---\n"),
    ("---\nrepair_risk: other\n---\n", False, "---\nrepair_risk: other\nrepair_status: auto-repaired\nverify_status: unverified\n---\n"),
    ("---\na: 1\n---\n## Source\n- Repair status: raw\n## Next\n- Repair status: raw\n", False, "---\na: 1\nrepair_status: auto-repaired\nverify_status: unverified\n---\n## Source\n- Repair status: auto-repaired\n## Next\n- Repair status: raw\n"),
])
def governed(text, needs_review):
    return P.govern(text, needs_review)


HASH = P.span_hash(["b"])


@cases("fix_apply_spans", [
    ("a\nb\nc\n", '[[2, 2, null, "B"]]', "a\nB\nc\n"), ("a\nb\nc", '[[1, 1, null, "x\\ny"], [3, 3, null, "z"]]', "x\ny\nb\nz\n"), ("a\nb\nc\n", f'[[2, 2, "{HASH}", "B"]]', "a\nB\nc\n"),
    ("a\nb\nc\n", '[[2, 2, "0000", "B"]]', None), ("a\nb\nc\n", '[[1, 2, null, "x"], [2, 3, null, "y"]]', None), ("a\n\nb\n", '[[1, 2, null, "x"]]', "x\n\nb\n"), ("a\r\nb\r\n", '[[1, 1, null, "x"]]', "x\nb\n"), ("a\n", '[[2, 2, null, "x"]]', None),
])
def spans_applied(text, spans):
    return per_value(P.apply_spans)(text, spans)


@cases("diff_ranges", [("a\nb\nc", "a\nB\nc", "2-2"), ("a\nb", "a\nb", ""), ("a\nb", "a\nx\nb", "2-2"), ("a\nb\nc\nd", "a\nd", "2-3"), ("a\nb\nc\nd\ne", "A\nb\nc\nd\nE", "1-1,5-5"), ("", "x", "1-1"), ("a", "", "1-1")])
def ranges(before, after):
    return per_value(P.changed_ranges)(before, after)


@cases("risk_review", [
    ("1. a\n\n2. b", "1. a\n\n2. b", ""), ("1. a\n\n2. b", "1. a\n2. b", "markdown-paragraph-boundary-regression"), ("1. a\n2. b", "1. a", "question-number-count-decreased,question-number-missing"),
    ("1. a\n2. b", "1. a\n3. b", "question-number-missing"), ("x" * 50, "xx", "replacement-body-erased"), ("a", r"\begin{array}{c} a", "latex-environment-unbalanced"), ("---\nlong: front matter of some length\n---\nab", "ab", ""),
    ("[a long link text](x) <b>bold</b>", "a long link text bold", ""), ("一、甲\n\n二、乙", "一、甲\nx\n二、乙", "markdown-paragraph-boundary-regression"),
])
def reviewed(before, after):
    return per_value(P.review)(before, after)


@cases("fn_score_noise", [
    ("plain", "0,0,0,0,0,0"), (r"\binom{n} \dot{x} \sharp", "1,1,1,0,0,0"), (r"\mathrm{~.~} \overset{}{A} \stackrel{\a}{b}", "0,0,0,1,2,0"), ("$$ x $\n$$y$\n$$z$$", "0,0,0,0,0,2"), (r"\dot{1} \dot {2} \binom{a}{b}", "0,2,0,0,0,0"),
])
def score_noise(text):
    return per_value(lambda x: ",".join(map(str, M.noise_left(x).values())))(text)


@cases("fn_brace_balance", [("{a}{b}", None), ("{a", "missing-close-brace"), ("a}", "extra-close-brace"), ("}{", "extra-close-brace"), (r"\{a", None), ("", None), ("{{a}", "missing-close-brace")])
def brace_balance(body):
    return per_value(M.brace_fault)(body)


@cases("risk_control_characters", [
    ("plain\ttext\n", ""), ("a\u200bb", "1:U+200B"), ("\u202ea\u202c", "0:U+202E,2:U+202C"), ("a\r\nb", ""), ("a\rb", "1:U+000D"), ("x\x07\x9f", "1:U+0007,2:U+009F"), ("\ufeffa\u00ad", "0:U+FEFF,2:U+00AD"),
])
def control_characters(text):
    """Control, bidirectional and zero-width characters with their places; a tab and a line feed are none."""
    chars = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "")
    bad = F.transform(chars, lambda c, i: F.when(c.rlike(r"[\p{Cc}\p{Cf}&&[^\t\n]]"), F.concat(i.cast("string"), F.lit(":U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))))
    return F.array_join(F.array_compact(bad), ",")


@cases("risk_answer_stem", [
    ("x答案.pdf.md", "解：x", True), ("x答案.pdf.md", "1. 题\n解：x", False), ("x答案.pdf.md", "已知 a\n证明：x", False), ("x.pdf.md", "解：x", False), ("解析.md", "无解", False), ("x答案.md", "求下列矩阵的特征值\n答: x", False), ("x答案.md", "答：求矩阵", True),
], "boolean")
def answer_stem(path, md):
    return F.array_contains(R.document_codes(path, md, F.lit(False)), "answer-missing-question-stem")


@cases("risk_document_codes", [
    ("---\nrepair_status: repaired\n---\n", "legacy-repaired-unverified"), ("---\nrepair_status: Repaired\nverify_status: VERIFIED\n---\n", ""), ("---\nrepair_risk: 'needs-human-review'\n---\n", "frontmatter-repair-risk"),
    ("---\nlanguage: zh\nimport_method: pymupdf\n---\n" + "a" * 2001, "low-cjk-density"), ("---\nlanguage: zh\nimport_method: pymupdf\n---\n" + "a" * 2001 + "中", ""), ("---\nocr_language: CN\n---\n" + "a" * 2001, ""),
    ("---\nlanguage: zh\nimport_method: pdf\n---\n" + "a" * 2001 + "\n## Imported Content\nb", ""), ("\\sharp", "lossy-ocr-placeholder"), ("repair_status: repaired", ""),
])
def codes_of_document(md):
    return F.array_join(F.array_sort(R.document_codes(F.lit("a.md"), md, F.lit(False))), ",")


@cases("pred_question_stem", [
    ("1. 求值\n解：x", True), ("解：x\n1. 求值", False), ("---\na: 1\n---\n第2、证\n答：y", True), ("一) x", True), ("plain words", False), ("计算下列概率", True), ("求\n解", False), ("", False), ("试证明 x", True),
], "boolean")
def question_stem(md):
    return R.has_question_stem(md)
