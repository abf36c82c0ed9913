"""Risk records of imported Markdown: a long table of (document, code, line), and what follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .mathscan import scan

# Code, severity, confidence, actionability and kind of safe fix, in the order in which risks are told.
METADATA = [
    ("mojibake-replacement-char", "warning", "medium", "inspect-local-snippets-only", "no-automatic-fix"),
    ("unicode-escape", "info", "high", "safe-autofix", "decode-yaml-unicode-escapes"),
    ("latex-nonumber", "warning", "medium", "inspect-local-snippets-only", "no-automatic-fix"),
    ("latex-binom-fragment", "warning", "medium", "inspect-local-snippets-only", "no-automatic-fix"),
    ("latex-left-right-unbalanced", "error", "high", "localized-render-repair", "prefer-display-math-and-structural-array-rewrite"),
    ("latex-array-layout-uncertain", "warning", "low", "manual-render-check", "none"),
    ("latex-array-column-mismatch", "error", "high", "localized-render-repair", "align-array-column-spec-with-row-cells"),
    ("obsidian-inline-array-render-risk", "error", "high", "localized-render-repair", "convert-long-inline-array-to-display-math"),
    ("display-math-delimiter-not-standalone", "error", "high", "localized-render-repair", "put-display-math-delimiters-on-standalone-lines"),
    ("inline-math-delimiter-space", "error", "high", "localized-render-repair", "trim-inline-math-delimiter-adjacent-space"),
    ("latex-math-span-brace-unbalanced", "error", "high", "localized-render-repair", "repair-local-math-span-brace-structure"),
    ("latex-array-wrapper-malformed", "error", "high", "localized-render-repair", "repair-array-wrapper"),
    ("math-dollar-unbalanced", "warning", "low", "inspect-local-snippets-only", "do-not-debug-detector"),
    ("math-dollar-odd-line", "error", "medium", "localized-render-repair", "repair-one-line-inline-math-boundary"),
    ("low-cjk-density", "warning", "medium", "inspect-local-snippets-only", "no-automatic-fix"),
    ("non-utf8-import", "warning", "medium", "inspect-local-snippets-only", "no-automatic-fix"),
    ("legacy-repaired-unverified", "warning", "high", "metadata-governance", "mark-auto-repaired-unverified"),
    ("frontmatter-repair-risk", "warning", "high", "human-review-required", "preserve-risk-marker"),
    ("question-heading-promoted", "warning", "medium", "local-format-repair", "demote-promoted-question-heading"),
    ("control-character", "warning", "high", "localized-text-repair", "replace-control-character-with-source-grounded-token"),
    ("ocr-symbol-garbage", "warning", "medium", "inspect-local-snippets-only", "no-automatic-fix"),
    ("answer-missing-question-stem", "warning", "medium", "paired-paper-crosscheck", "requires-source-or-paired-sidecar"),
    ("lossy-ocr-placeholder", "warning", "medium", "inspect-local-snippets-only", "no-automatic-fix"),
]
BLOCKING = [
    "math-dollar-odd-line", "latex-left-right-unbalanced", "latex-array-column-mismatch", "latex-math-span-brace-unbalanced",
    "latex-array-wrapper-malformed", "obsidian-inline-array-render-risk", "display-math-delimiter-not-standalone", "inline-math-delimiter-space",
]
SEMANTIC = ["mojibake-replacement-char", "low-cjk-density", "lossy-ocr-placeholder", "non-utf8-import", "ocr-symbol-garbage"]
FORMAT = [
    "unicode-escape", "question-heading-promoted", "control-character", "latex-nonumber", "latex-binom-fragment", "latex-left-right-unbalanced",
    "latex-array-column-mismatch", "latex-math-span-brace-unbalanced", "latex-array-wrapper-malformed", "obsidian-inline-array-render-risk",
    "display-math-delimiter-not-standalone", "inline-math-delimiter-space", "math-dollar-unbalanced",
]
HEURISTIC = ["math-dollar-unbalanced", "math-dollar-heuristic-suspect"]
HARMLESS = ["unicode-escape", "legacy-repaired-unverified", "frontmatter-repair-risk"]
EXTRA = ["obsidian-inline-array-render-risk", "display-math-delimiter-not-standalone", "inline-math-delimiter-space", "latex-array-column-mismatch"]
PRIORITY = {
    "obsidian-inline-array-render-risk": 5, "display-math-delimiter-not-standalone": 5, "inline-math-delimiter-space": 5, "latex-array-column-mismatch": 4,
    "latex-math-span-brace-unbalanced": 5, "latex-array-wrapper-malformed": 5, "latex-left-right-unbalanced": 3, "math-dollar-odd-line": 2,
}
LINE_PATTERNS = {
    "question-heading-promoted": r"^##\s+[一二三四五六七八九十]+[\.、]",
    "control-character": r"[\x00-\x08\x0b\x0c\x0e-\x1f]",
    "ocr-symbol-garbage": r"\\boxplus|\\neg\s*\\neg|\\\s+Y(?:\s+Y)+",
}
#: Whatever the case; the sign of Kelvin has a k as its small letter.
CJK_LANGUAGES = r"(?i)\A(?:ch|cn|zh|zh-cn|zh_hans|zh-hans|cj[k\u212A]|中文)\z"
LANGUAGE_KEYS = ["language", "source_language", "document_language", "ocr_language", "import_language"]
SOLUTION_LEAD = r"(?md)^\s*(?:解|证明|答)[:：]"
STEMS = [
    r"(?md)^\s*(?:#{1,3}\s*)?(?:第?\s*)?(?:[一二三四五六七八九十]+|[0-9]+)[\.、．)]\s*\S+",
    r"(?:题干|已知|求证|本题|试证明)",
    r"(?:求|计算)[^。\n]{0,80}(?:值|解|概率|面积|体积|矩阵|特征|导数|积分)",
]
ANSWER_NAMES = "答案|参考答案|解析"


def has_question_stem(md: Column) -> Column:
    """Whether a question stands before the first solution, within 3,000 characters where there is none."""
    body = X.body(md)
    before = F.when(body.rlike(SOLUTION_LEAD), F.element_at(F.split(body, SOLUTION_LEAD, 2), 1)).otherwise(F.substring(body, 1, 3000))
    return reduce(lambda a, b: a | b, (before.rlike(p) for p in STEMS))


def low_cjk(md: Column, front: Column) -> Column:
    """A long import that is said to be Chinese and holds no Chinese character."""
    said = reduce(lambda a, b: a | b, (F.coalesce(F.try_element_at(front, F.lit(k)).rlike(CJK_LANGUAGES), F.lit(False)) for k in LANGUAGE_KEYS))
    marked = F.split(md, r"(?md)^## Imported Content\s*$", 2)
    body = F.when(F.size(marked) > 1, F.element_at(marked, 2)).otherwise(X.body(md))
    return said & (F.char_length(body) > 2000) & ~body.rlike("[\u4e00-\u9fff]") & md.rlike(r"import_method:\s*(?:mineru|pdf|pymupdf)")


def document_codes(path: Column, md: Column, not_utf8: Column) -> Column:
    """Codes of a whole document, as an array."""
    name = F.regexp_extract(path, "([^/]*)$", 1)

    def told(front: Column) -> Column:
        says = lambda k, v: F.coalesce(F.try_element_at(front, F.lit(k)).rlike(rf"(?i)\A{v}\z"), F.lit(False))  # noqa: E731  whatever the case
        rules = {
            "low-cjk-density": low_cjk(md, front),
            "non-utf8-import": not_utf8,
            "legacy-repaired-unverified": says("repair_status", "repaired") & ~says("verify_status", "verified"),
            "frontmatter-repair-risk": says("repair_risk", "needs-human-review"),
            "answer-missing-question-stem": name.rlike(ANSWER_NAMES) & md.rlike(SOLUTION_LEAD) & ~has_question_stem(md),
            "lossy-ocr-placeholder": F.contains(md, F.lit("\\")) & md.rlike(r"\\texttt\s*\{\s*\\textbf\s*\{\s*#\s*\}\s*:?\s*\}|(?<!\\)\\sharp(?!\w)"),
        }
        return F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in rules.items())))

    return X.let(X.front_matter_map(md), told)


def detect(docs: DataFrame, not_utf8: Column | None = None) -> DataFrame:
    """``doc_id, code, line_no`` of all defects of ``docs`` (``doc_id, path, md``); no line for whole documents.

    Rules that are plain expressions are tested on the whole text first, so only the
    lines of texts that hold a defect become rows; formulas go to the scanner.
    """
    flags = F.lit(False) if not_utf8 is None else not_utf8
    whole = docs.select("doc_id", F.explode_outer(document_codes(F.col("path"), F.col("md"), flags)).alias("code"), F.lit(None).cast("int").alias("line_no")).where(F.col("code").isNotNull())
    any_line = r"(?md)(?=[#\\\x00-\x1f])(?:" + "|".join(f"(?:{p})" for p in LINE_PATTERNS.values()) + ")"  # what they begin with comes first, as nearly all places fail there
    rows = docs.where(F.col("md").rlike(any_line)).select("doc_id", F.posexplode(F.split("md", "\n")).alias("at", "line"))
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(code)) for code, p in LINE_PATTERNS.items())))
    by_line = rows.select("doc_id", F.explode(hits).alias("code"), (F.col("at") + 1).alias("line_no"))
    return whole.union(by_line).union(scan(docs))


def metadata(spark: SparkSession) -> DataFrame:
    """The dimension of codes, with their order."""
    return spark.createDataFrame([(k, *row) for k, row in enumerate(METADATA)], "seq int, code string, severity string, confidence string, actionability string, safe_fix_kind string")


def records(risks: DataFrame, samples: int = 8) -> DataFrame:
    """A record for each document and code: lines counted once, all and some of them, and what is known of the code."""
    lines = F.sort_array(F.collect_set("line_no"))
    rolled = risks.groupBy("doc_id", "code").agg(lines.alias("lines"), F.count_if(F.col("line_no").isNull()).alias("whole"))
    rolled = rolled.select("doc_id", "code", (F.size("lines") + F.col("whole")).cast("int").alias("count"), "lines", F.slice("lines", 1, samples).alias("sample"), (F.size("lines") > samples).alias("truncated"))
    return rolled.join(F.broadcast(metadata(risks.sparkSession)), "code")  # a row for each code


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 3).when(severity == "warning", 2).otherwise(1)


def primary(group: DataFrame) -> DataFrame:
    """``doc_id, primary_risk``: worst, then most local, then most urgent, then not a guess; the first of equals."""
    action = F.when(F.col("actionability") == "localized-render-repair", 3).when(F.col("actionability") == "localized-text-repair", 2).when(F.col("actionability") == "local-format-repair", 1).otherwise(0)
    urgent = reduce(lambda out, kv: F.when(F.col("code") == kv[0], kv[1]).otherwise(out), PRIORITY.items(), F.lit(0))
    order = F.struct(severity_rank(F.col("severity")), action, urgent, (~F.col("code").isin(*HEURISTIC)).cast("int"), -F.col("seq"))
    return group.groupBy("doc_id").agg(F.max_by("code", order).alias("primary_risk"))


def points(severity: Column, actionability: Column, code: Column) -> Column:
    """Points of one record (fixed weights)."""
    base = F.when(severity == "error", 100).when(severity == "warning", 30).otherwise(5)
    local = F.when(actionability.isin("localized-render-repair", "localized-text-repair"), 20).otherwise(0)
    less = F.when(code == "unicode-escape", 20).otherwise(0) + F.when(code.isin(*HEURISTIC), 10).otherwise(0)
    return base + local + F.when(code.isin(*EXTRA), 40).otherwise(0) - less


def evidence(codes: Column, raw: Column, source: Column, paired: Column) -> Column:
    """``class, mode, blocked`` of a repair by its codes and by what evidence exists."""
    has = lambda names: F.size(F.array_intersect(codes, F.array(*map(F.lit, names)))) > 0
    short = "unrecoverable-with-current-evidence"
    record = lambda kind, mode, blocked: F.struct(F.lit(kind).alias("class"), mode.alias("mode"), blocked.alias("blocked"))
    text, none = F.lit("text-only"), F.lit("")
    read = lambda enough: F.when(enough, "text-only").otherwise("vision-assisted")
    stop = lambda enough: F.when(~enough & ~source, "requires-vision-evidence").otherwise("")  # noqa: E731  without a text to read there is nothing to look at
    return (
        F.when(F.size(F.array_except(codes, F.array(*map(F.lit, HARMLESS)))) == 0, record("metadata-only", text, none))
        .when(F.array_contains(codes, "answer-missing-question-stem"), record("answer-paper-crosscheck", read(paired | raw), stop(paired | raw)))
        .when(has(SEMANTIC), record("semantic-text-repair", read(raw), stop(raw)))
        .when(has(FORMAT), record("format-only", text, none))
        .when(source & ~raw, record("requires-ocr", F.lit("ocr-assisted"), none))
        .otherwise(record(short, text, F.lit(short)))
    )


#: First lines of sections (fixed values): headings of levels 1 to 3, and numbered questions.
SECTION_START = r"^\s*(?:#{1,3}\s+\S|(?:#{1,3}\s*)?(?:(?:第\s*)?(?:[一二三四五六七八九十]+|[0-9]+)\s*(?:[\.、．)]|[（(]\s*\d+\s*分\s*[）)]\s*[\.、．:]?)|[（(]\s*[0-9一二三四五六七八九十]+\s*[）)]))"
MAX_SECTIONS = 24


def section_starts(md: Column) -> Column:
    """Line numbers where sections begin, one past the last for the end of those that count."""
    rows = F.transform(F.split(md, "\n"), lambda line, i: F.when(line.rlike(SECTION_START), i + 1))
    return F.slice(F.array_compact(rows), 1, MAX_SECTIONS + 1)


def section_of(starts: Column, line: Column) -> Column:
    """The number of the section that holds a line, from 1; null before the first and after the last that counts."""
    n = F.size(F.filter(starts, lambda s: s <= line))
    return F.when(n.between(1, MAX_SECTIONS), n)


def scope(blocking: Column, lines: Column, sections: Column) -> Column:
    """What a repair has to touch: ``sections`` holds the section of each blocking line, null for none."""
    one = (F.size(lines) > 0) & (F.size(F.array_distinct(sections)) == 1) & ~F.exists(sections, lambda s: s.isNull())
    return F.when(blocking == 0, "metadata-or-nonblocking").when(one, "single-section").when(F.size(lines) > 1, "widened").otherwise("blocked")


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
