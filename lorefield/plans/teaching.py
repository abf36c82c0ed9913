"""Gates over teaching pages, packs and records, on a sound page and on pages with one fault each."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import pages as G
from ..operators import records as R
from ..sources.tables import dealt_table, table
from .cases import cases, dealt, dealt_sql, sql_literal
from .registry import register

# --------------------------------------------------------------------------
# a page that passes, and what breaks it


def _example(n: int) -> str:
    return (
        f"### 例题 {n}（来源：2019 期中 第 {n} 题 · 难度：⭐⭐⭐）\n\n**题目**：求矩阵 A{n} 的秩并说明理由。\n\n看到数值矩阵，先判行变换。\n\n"
        f"完整解析：对 A{n} 做行变换，为什么这么做：行变换不改变秩。\n\n【方法引用】行变换法\n\n验算：代回第 {n} 行。易错：漏行。变式：换列。\n\n"
    )


def _test(n: int) -> str:
    return f"### 自测 {n}（来源：2020 期中 第 {n} 题）\n\n题目：求矩阵 B{n} 的秩并写出最大无关组。\n\n提示：用行变换方法。\n\n"


def _answer(n: int) -> str:
    return f"### 自测 {n} 答案\n\n答案：秩为 {n}，前 {n} 列是最大无关组。\n\n"


PAGE = f"""---
type: exam-type-analysis
course: linear
exam_scope: 期中
exam_type_id: matrix-rank
exam_type_name: 矩阵的秩
rank: 1
paper_count: 3
must_know: true
quality: reviewed
status: active
---

# 矩阵的秩

## 元信息

- 考试频率：高；分值：10；难度：中

## 真卷对应题号

2019 期中 第 3 题

## 考前速记

### 一眼先记住

| 项目 | 内容 |
| --- | --- |
| 秩 | 非零子式的最高阶数 |

### 符号与术语

| 符号 | 含义 |
| --- | --- |
| r(A) | 矩阵的秩 |

### 关键公式表

| 公式 | 用途 |
| --- | --- |
| r(AB) ≤ min(r(A), r(B)) | 乘积的秩 |

### 方法选择

├─ 数值矩阵：行变换
└─ 抽象矩阵：用不等式

## 核心概念

定义：非零子式的最高阶数。参考：线性代数教材 第2章

## 核心方法

适用场景：数值矩阵。

## 零基础先看这里

### 这类题考试到底在考什么

化阶梯形并数非零行。

### 30秒认题

出现秩或无关组字样。

### 2分钟下笔模板

先写 [表达式]，再写 [答案]。

### 不会做时先写什么拿步骤分

先写出秩的定义。

## 例题精讲

{"".join(map(_example, range(1, 6)))}## 自测题

{"".join(map(_test, range(1, 5)))}## 自测答案

{"".join(map(_answer, range(1, 5)))}## 快速得分技巧

| 时间情况 | 策略 | 大约可省 |
| --- | --- | --- |
| 时间充裕 | 完整写出行变换 | 0 分钟 |
| 时间紧张 | 只写阶梯形 | 5 分钟 |
| 完全不会 | 写定义 | 8 分钟 |

## 易错点与检查清单

| 易错点 | 错误做法 | 正确做法 | 原因 |
| --- | --- | --- | --- |
| 列变换 | 混用 | 只用行变换 | 保持解不变 |

最后验算：把结果代回。

## 来源校对说明

已人工核对。
"""


def _changed(*changes: tuple[str, str]) -> str:
    page = PAGE
    for old, new in changes:
        if old not in page:
            raise ValueError(old)
        page = page.replace(old, new)
    return page


LESS = [(_example(n), "") for n in range(2, 6)] + [(_test(n), "") for n in range(2, 5)] + [(_answer(n), "") for n in range(2, 5)]
#: Pages with what the structural gate has to say about them.
STRUCTURE: list[tuple[str, list[str]]] = [
    (PAGE, []),
    (_changed(("## 来源校对说明", "## 说明")), ["required_sections"]),
    (_changed(("出现秩或无关组字样。\n", "")), ["entry_layer"]),
    (_changed((_example(2), _example(2).replace("【方法引用】行变换法", ""))), ["worked_examples", "method_reference"]),
    (_changed((_example(3), _example(3).replace("完整解析：", "略。").replace("，为什么这么做：行变换不改变秩", ""))), ["worked_examples"]),
    (_changed((_answer(4), "### 自测 4 答案\n\n")), ["self_tests"]),
    (_changed(("考试频率", "考试次数")), ["badge"]),
    (_changed(("一眼先记住", "速查")), ["quick_lookup"]),
    (_changed(("符号与术语", "记号"), ("| 符号 |", "| 记号 |")), ["symbols"]),
    (_changed(("易错点", "注意点")), ["required_sections", "pitfalls", "error_comparison"]),
    (_changed(("├─", "-"), ("└─", "-")), ["decision_tree"]),
    (_changed(("关键公式表", "公式")), ["formulas"]),
    (_changed(("验算", "回看")), ["verification_steps", "teaching_scaffolding"]),
    (_changed(("已人工核对。", "{{checked}}")), ["no_placeholders"]),
    (_changed(("已人工核对。", "_(fill by review-coach)_")), ["no_placeholders"]),
    (_changed(("rank: 1\n", "")), ["frontmatter_shape"]),
    (_changed(("status: active\n", "status: active\nextra: 1\n")), ["frontmatter_shape"]),
    (_changed(("status: active\n", "status: active\nsource_summary: x\n")), []),
    (_changed(("| 秩 | 非零子式的最高阶数 |", "| 秩 | 非零子式 | 最高阶数 |")), ["markdown_tables"]),
    (_changed(("| 秩 | 非零子式的最高阶数 |", "| 秩 | 非零子式 \\| 最高阶数 |")), []),
    (_changed(("已人工核对。", "Seeded from papers")), ["chinese_user_facing"]),
    (_changed((_example(1), _example(1).replace("来源：2019 期中 第 1 题 · ", ""))), ["worked_examples", "source_grounding"]),
    (_changed((_test(1), _test(1).replace("提示：", "这是自编题。提示："))), ["source_grounding"]),
    (_changed(("已人工核对。", "> | a | b |")), ["render_safe_markdown"]),
    (_changed(("已人工核对。", "<details>\n$$\nx\n$$\n</details>")), ["render_safe_markdown"]),
    (_changed(("方法选择", "选法"), ("├─", "-")), ["decision_tree", "teaching_scaffolding"]),
    (_changed(("参考：线性代数教材 第2章", "")), ["concept_explanation"]),
    (_changed(("参考：线性代数教材 第2章", "基于考纲整理")), []),
    (_changed(("适用场景：", "场景：")), ["core_methods"]),
    (_changed(("| 时间紧张 | 只写阶梯形 | 5 分钟 |\n| 完全不会 | 写定义 | 8 分钟 |\n", "")), ["scoring_strategy"]),
    (_changed(("| 列变换 | 混用 | 只用行变换 | 保持解不变 |\n", "")), ["error_comparison"]),
    (_changed(("⭐⭐⭐", "中")), ["difficulty_stars"]),
    (_changed((_test(1), _test(1) + "答案：秩为 1，第一列。\n\n")), ["self_test_answer_separation"]),
    (_changed(("[表达式]", "式"), ("[答案]", "答")), ["fill_in_answer_template"]),
    (_changed(*LESS), ["worked_examples", "self_tests", "method_reference", "difficulty_stars"]),
    (_changed(*LESS, ("quality: reviewed", "quality: needs-review"), ("已人工核对。", "证据不足，需人工补充")), []),
    (_changed(*LESS, ("quality: reviewed", "quality: needs-review")), ["worked_examples", "self_tests", "method_reference", "difficulty_stars"]),
]


def type_pages(spark, sf_dir, pages: list[str]):
    """``doc_id, source, md``: a page, and at its end the whole text without signs of markup."""
    rest = F.regexp_replace("text", r"[|`#$>{}\[\]<*_\\]", " ")
    return dealt_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "source", F.concat(dealt(pages), F.lit("\n"), rest).alias("md"))


def _known(rows: list[tuple[str, list[str]]]) -> str:
    values = ", ".join(f"({k}, {sql_literal(c)})" for k, (_, found) in enumerate(rows) for c in found)
    return f"select doc_id, source, code from documents join (values {values}) v(k, code) on doc_id % {len(rows)} = k"


def _structural(spark, sf_dir):
    return G.with_structure(type_pages(spark, sf_dir, [p for p, _ in STRUCTURE]), "md").select("doc_id", "source", "failed")


@register("qc_structural", f"select doc_id, code from ({_known(STRUCTURE)})")
def qc_structural(spark, sf_dir):
    # outer, as the optimizer would otherwise work out the checks twice, to leave out empty arrays before
    return _structural(spark, sf_dir).select("doc_id", F.explode_outer("failed").alias("code")).where(F.col("code").isNotNull())


@register("qc_structural_verdict", f"select doc_id, {dealt_sql(['needs-revision' if found else 'pass' for _, found in STRUCTURE], 'string')} verdict from documents")
def qc_structural_verdict(spark, sf_dir):
    return _structural(spark, sf_dir).select("doc_id", F.when(F.size("failed") == 0, "pass").otherwise("needs-revision").alias("verdict"))


@register("agg_review_totals", f"with f as ({_known(STRUCTURE)}), v as (select doc_id, case when doc_id % 3 = 0 then doc_id in (select doc_id from f where code in ('markdown_tables', 'chinese_user_facing')) else doc_id in (select doc_id from f) end bad from documents) select case when doc_id % 3 = 0 then 'analysis-report' else 'type-analysis' end kind, bad needs_revision, count(*) n from v group by 1, 2")
def agg_review_totals(spark, sf_dir):
    """Pages that pass and pages to revise, by kind; every third page is read as a report, for which two checks count."""
    pages = G.with_structure(type_pages(spark, sf_dir, [p for p, _ in STRUCTURE]), "md")
    kind = F.when(F.col("doc_id") % 3 == 0, "analysis-report").otherwise("type-analysis")
    report = F.when(kind == "analysis-report", F.col("md"))  # null for others, so that no row of theirs is read twice
    failed = F.when(kind == "analysis-report", G.report_codes(report)).otherwise(F.col("failed"))
    return pages.select(kind.alias("kind"), (F.size(failed) > 0).alias("needs_revision")).groupBy("kind", "needs_revision").agg(F.count("*").alias("n"))


COUNTS = [(PAGE, "5,4,5,5"), (_changed(*LESS), "1,1,1,1"), (_changed((_answer(4), "### 自测 4 答案\n\n")), "5,3,5,5"), (_changed((_example(2), _example(2).replace("【方法引用】行变换法", ""))), "4,4,5,4"), (_changed(("⭐⭐⭐", "⭐")), "5,4,5,5"), (_changed(("⭐⭐⭐", "中")), "5,4,0,5"), ("no page", "0,0,0,0")]


@cases("qc_counts", COUNTS)
def page_counts(md):
    """Examples and tests that are filled in, examples with stars, references to methods."""
    return F.concat_ws(",", *(c.cast("string") for c in G.counts(md).values()))


@cases("qc_check_fns", [
    ("has_substance", "## Head\n\n| --- |", False), ("has_substance", "[eight letters](x)", True), ("has_substance", "{{slot}} of a template", False), ("has_substance", "short", False),
    ("concrete_source", "真题", False), ("concrete_source", "**2019 期中**", True), ("concrete_source", "YYYY 第X学期", False), ("concrete_source", "某卷，题号待人工校对", True), ("concrete_source", "ab", False), ("concrete_source", "", False),
    ("has_source", "例题（来源：待补）\nx", False), ("has_source", "例题\n来源: 2021 卷", True), ("frontmatter", "---\ntype: x\n---\n", True), ("frontmatter", PAGE, False), ("evidence_short", "---\nquality: 'needs-review'\n---\n证据不足，需人工补充", True), ("evidence_short", PAGE, False),
    ("mixed", "## 自测题\n答案与解析：这里给出了完整的答案\n## 自测答案\n", True), ("mixed", "## 自测题\n答案：\n## 自测答案\n", False), ("scoring", PAGE, False), ("scoring", "## 快速得分技巧\n时间充裕", True), ("errors", PAGE, False), ("concept", "## 核心概念\n定义：一个很长的定义。见教材", False), ("concept", "定义", True),
], "boolean")
def check_function(name, text):
    tests = {
        "has_substance": G.has_substance(text, 8), "concrete_source": G.concrete_source(text), "has_source": G.has_source(text), "frontmatter": G.frontmatter_faulty(text), "evidence_short": G.evidence_short(text),
        "mixed": G.answers_mixed(text), "scoring": G.scoring_faulty(text), "errors": G.errors_faulty(text), "concept": G.concept_faulty(text),
    }
    return F.coalesce(*(F.when(name == k, test) for k, test in tests.items()))


@cases("qc_analysis", [("| a | b |\n| --- | --- |\n| 1 | 2 |", ""), ("| a | b |\n| --- | --- |\n| 1 | 2 | 3 |", "markdown_tables"), ("| Paper | Format |\n| --- | --- |", "chinese_user_facing"), ("| x | unspecified |", "chinese_user_facing"), ("## Common Pitfalls\n| a |\n| --- | --- |", "markdown_tables,chinese_user_facing")])
def report(md):
    return F.array_join(G.report_codes(md), ",")


@cases("risk_table_pipes", [
    ("| a | b |\n| --- | --- |\n| 1 | 2 |", ""), ("| a | b |\n| --- | --- |\n| 1 | 2 | 3 |\n| 4 |", "3,4"), ("| a | b |\n| --- |\n| 1 |", "2"), ("| a |\n| --- |\n\n| b | c |\n| --- | --- |\n| $|x|$ | 1 |", "6"),
    ("| a \\| b |\n| --- |\n| c \\| d |", ""), ("text | not a table", ""), ("| only a row |", ""), ("| a |\n| --- |\n| 1 |\nend\n| x | y |", ""),
])
def table_pipes(md):
    return G.broken_tables(md)


@cases("qc_missing_markers", [(PAGE, ""), (_changed(("核心概念", "概念")), "核心概念"), (_changed(("30秒认题", "认题"), ("来源校对说明", "说明")), "来源校对说明,30秒认题"), ("{{x}}", ",".join([*G.SECTIONS, *G.ENTRY, "{{template}}"])), ("TODO " + PAGE, "")])
def missing_markers(md):
    wanted = F.array(*map(F.lit, [*G.SECTIONS, *G.ENTRY]))
    lacking = F.filter(wanted, lambda m: ~F.contains(md, m))
    return F.array_join(F.concat(lacking, F.when(md.rlike(r"\{\{[^}]+\}\}"), F.array(F.lit("{{template}}"))).otherwise(F.array().cast("array<string>"))), ",")


# --------------------------------------------------------------------------
# page codes

_A = "type-analysis-"
LONG = "甲" * 250
#: Pages with the page codes that the rules ask for, without the common beginning of their names.
CODES: list[tuple[str, list[str]]] = [
    (PAGE, []),
    (_changed(("exam_type_id: matrix-rank\n", "")), [_A + "missing-type-id"]),
    (_changed(("matrix-rank", "unknown-type")), [_A + "missing-dossier"]),
    (_changed(("type: exam-type-analysis", "type: note")), ["frontmatter-type"]),
    (_changed(("变式：换列。", "")), [_A + "worked-example-missing-transfer"]),
    (_changed(("看到数值矩阵", "对于数值矩阵")), [_A + "worked-example-too-thin"]),
    (_changed(("提示：用", "用")), [_A + "self-test-missing-hint"]),
    (_changed(("用行变换方法", "化阶梯形")), [_A + "self-test-missing-method-link"]),
    (_changed((_test(1), _test(1).replace("2020 期中 第 1 题）", "2019 期中 第 1 题 · 难度：⭐⭐⭐）"))), [_A + "example-selftest-overlap"]),
    (_changed((_example(2), _example(2).replace("2019 期中 第 2 题", "2019 期中 第 1 题"))), [_A + "duplicate-worked-example", _A + "too-few-worked-examples"]),
    (_changed((_test(2), _test(2).replace("2020 期中 第 2 题", "2020 期中 第 1 题"))), [_A + "duplicate-self-test", _A + "too-few-self-tests"]),
    (_changed((_test(2), _test(2).replace("2020 期中 第 2 题", "2020 期中 第 1 题")), ("quality: reviewed", "quality: needs-review")), [_A + "duplicate-self-test"]),
    (_changed(("参考：线性代数教材 第2章", "")), [_A + "missing-textbook-grounding"]),
    (_changed(("参考：线性代数教材 第2章", "参考：教材 §2 行列式")), [_A + "missing-textbook-grounding", _A + "overbroad-textbook-ref"]),
    (_changed(("参考：线性代数教材 第2章", "参考：教材 §2.1 行列式")), []),
    (_changed(("已人工核对。", "详见来源")), [_A + "low-quality-phrase"]),
    (_changed(("已人工核对。", "## 1 为什么")), [_A + "self-question-heading"]),
    (_changed(("**题目**：", "题目摘要：")), [_A + "missing-full-worked-problem"]),
    (_changed((_answer(1), "### 自测 1 答案\n\n答案：按本页模板\n\n")), [_A + "template-self-test-answer"]),
    (_changed((_answer(1), "### 自测 1 答案\n\n答案：按本页模板\n\n"), (_answer(2), "### 自测 2 答案\n\n答案：按本页模板\n\n")), [_A + "template-self-test-answer", _A + "repeated-self-test-answer"]),
    (_changed(("## 自测答案", "## 解答")), [_A + "missing-self-test-answers", _A + "missing-self-test-answer-content"]),
    (_changed(("已人工核对。", "这是模拟题")), [_A + "fabricated-question"]),
    (_changed(("先判行变换", "先看行变换")), [_A + "missing-action-sentence-style"]),
    (_changed(("看到数值矩阵", "看到后根据关键词确定本题属于本题型")), [_A + "template-worked-solution"]),
    (_changed(("2分钟下笔模板", "模板")), [_A + "missing-action-template"]),
    (_changed((_example(1), _example(1).replace("求矩阵 A1 的秩", LONG + "解：秩"))), [_A + "raw-ocr-dump"]),
    (_changed((_example(1), _example(1).replace("**题目**：求矩阵", "**题目**：\n#### 一、计算题\n求矩阵"))), [_A + "heading-only-problem"]),
    (_changed(("行变换不改变秩。", "行变换不改变秩，" + "所以逐行相减直到得到阶梯形" * 5 + "。"), *((f"对 A{n} 做", "对它做") for n in range(1, 6))), [_A + "repeated-worked-solution"]),
    (_changed(("快速得分", "快得"), ("步骤分", "分数")), [_A + "missing-block"]),
    (_changed(("已人工核对。", "TODO")), ["placeholder-content"]),
    (_changed(("已人工核对。", "见 a.json#q1")), ["human-markdown-machine-ref-leak"]),
    (_changed(("已人工核对。", "**Answer****Check**")), ["human-markdown-broken-prose-join"]),
    (_changed(("| 秩 | 非零子式的最高阶数 |", "| 秩 | 非零 | 阶数 |")), ["markdown-table"]),
    (_changed(("已人工核对。", "式 $$ x")), ["render-risk"]),
    (_changed(("已人工核对。", "$ x$ 与 $y$")), ["render-risk"]),
    (_changed(("已人工核对。", "$x$ 与 $y$")), []),
]


@register("qc_type_page", f"select doc_id, code from ({_known(CODES)})")
def qc_type_page(spark, sf_dir):
    known, grounded = F.array(F.lit("matrix-rank")), F.array().cast("array<string>")
    pages = G.with_type_page(type_pages(spark, sf_dir, [p for p, _ in CODES]), "md", known, grounded)
    # outer, as the optimizer would otherwise work out the codes twice, to leave out empty arrays before
    return pages.select("doc_id", F.explode_outer("codes").alias("code")).where(F.col("code").isNotNull())


@register("agg_check_flags", f"""with e as (select doc_id, list(code) codes from ({_known(CODES)}) where code not like '%transfer' and code not like '%method-link' group by 1)
select doc_id, not exists (select 1 from unnest(codes) u(c) where c in ('render-risk', 'markdown-table', 'placeholder-content')) mechanical_ok,
 not exists (select 1 from unnest(codes) u(c) where regexp_matches(c, 'source|ref|card|dossier|taxonomy|manifest')) source_ok, not exists (select 1 from unnest(codes) u(c) where contains(c, 'textbook')) textbook_grounding_ok,
 not exists (select 1 from unnest(codes) u(c) where regexp_matches(c, 'problem|solution|answer|too-thin')) problem_completeness_ok, not exists (select 1 from unnest(codes) u(c) where regexp_matches(c, 'example|self-test|worked')) example_selftest_ok from e""")
def agg_check_flags(spark, sf_dir):
    """Five flags of the pages that have an error; two of the codes are warnings only."""
    found = qc_type_page(spark, sf_dir).where(~F.col("code").rlike("transfer$|method-link$")).groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
    return found.select("doc_id", *(flag.alias(name) for name, flag in R.check_flags(F.col("codes")).items()))


@cases("qc_markdown", [
    ("---\ntype: exam-prep-analysis\n---\nok", ""), ("ok", "frontmatter-type"), ("---\ntype: exam-prep-analysis\n---\n待整理\n|  | ", "placeholder-content"), ("---\ntype: 'exam-prep-analysis'\n---\npaper-card", "human-markdown-machine-ref-leak"),
    ("---\ntype: exam-prep-analysis\n---\n$$\nx\n$$\n$a$", ""), ("---\ntype: exam-prep-analysis\n---\n$$ x $$", "render-risk"), ("---\ntype: exam-prep-analysis\n---\n| a |\n| --- |\n| 1 | 2 |", "markdown-table"), ("---\ntype: exam-prep-analysis\n---\n\\$ 5 and $x$", ""),
])
def markdown(md):
    return F.array_join(G.codes(G.markdown_rules(md, "exam-prep-analysis", True)), ",")


@cases("qc_guide", [("---\ntype: exam-prep-guide\n---\n先读公式总卡", ""), ("---\ntype: exam-prep-guide\n---\n文件与统计", "guide-missing-start-route,guide-artifact-list-only"), ("---\ntype: exam-prep-guide\n---\n1 天路线：统计", "guide-artifact-list-only"), ("从这里开始", "frontmatter-type"), ("---\ntype: exam-prep-guide\n---\n空", "guide-missing-start-route")])
def guide(md):
    return F.array_join(G.guide_codes(md), ",")


@cases("qc_scope", [("期中", "README.md", "见期末公式总卡", "scope-naming-residue"), ("期中", "期末公式总卡.md", "", "scope-naming-residue"), ("期末", "期末公式总卡.md", "期末考试备考指南", ""), ("2024 期中", "备考指南.md", "期中公式总卡", ""), ("期中", "备考指南.md", "期末答题模板速查", "scope-naming-residue")])
def scope_names(scope, name, md):
    return F.array_join(G.scope_codes(scope, name, md), ",")


_AN = "---\ntype: exam-prep-analysis\n---\n"


@cases("qc_analysis_md", [(_AN + "2018-2019 第二学期 试卷 第 3 题，来源：真题，原题", True, ""), (_AN + "原题复现", True, "analysis-missing-human-source-ref,analysis-repeat-claim-missing-source"), (_AN + "无结论", False, ""), (_AN + "相似", False, "analysis-repeat-claim-missing-source"), (_AN + "2019 期中 一.2", True, "")])
def analysis_page(md, has_cards):
    return F.array_join(G.analysis_codes(md, has_cards), ",")


_ST = "---\ntype: exam-prep-quality-standard\n---\n" + " ".join(G.STANDARD)


@cases("qc_standard", [(_ST, ""), (_ST.replace("样板", ""), "quality-standard-missing-rule"), ("样板", "frontmatter-type,quality-standard-missing-rule"), (_ST + " TBD", "placeholder-content")])
def standard(md):
    return F.array_join(G.standard_codes(md), ",")


_DD = "---\ntype: exam-paper-deep-dive\n---\n题号 来源 考点 解法 疑点"


@cases("qc_gold_sample", [(_DD, False, ""), (_DD.replace("疑点", ""), False, "gold-sample-paper-too-thin"), (_DD, True, "paper-deep-dive-missing-cross-paper-backfill"), (_DD + " 跨卷关系", True, ""), ("题号", False, "frontmatter-type,gold-sample-paper-too-thin")])
def gold_sample(md, final):
    return F.array_join(G.deep_dive_codes(md, final), ",")


_GUIDE = "---\ntype: exam-prep-guide\n---\n# 怎么使用这套资料\n[a](题型解析/01.md) 公式总卡.md 答题模板速查.md 考前1小时清单.md\n## 题型优先级\n## 复习时间分配\n"
_CARD = "---\ntype: formula-cheat-sheet\n---\n## 高频公式速查\n| 公式 | 来源 |\n| --- | --- |\n| x | 题型解析/01.md |\n"
_TEMPLATE = "---\ntype: answer-template-quickref\n---\n题型解析/\n## 标准答题模板\n先写 [条件]\n"
_HOUR = "---\ntype: pre-exam-one-hour-checklist\n---\n备考指南.md 公式总卡.md 答题模板速查.md [t](%E9%A2%98%E5%9E%8B%E8%A7%A3%E6%9E%90/01.md)\n60-45 45-30 30-15 15-5 5-0\n- [ ] 看公式\n"


@cases("qc_prep_pack", [
    ("备考指南.md", _GUIDE, ""), ("公式总卡.md", _CARD, ""), ("答题模板速查.md", _TEMPLATE, ""), ("考前1小时清单.md", _HOUR, ""), ("备考指南.md", _GUIDE.replace("公式总卡.md", ""), "备考指南.md:link 公式总卡.md"), ("备考指南.md", _GUIDE.replace("# 题型优先级", "题型优先级"), "备考指南.md:section 题型优先级"),
    ("备考指南.md", _GUIDE.replace("type: ", "kind: "), "备考指南.md:type"), ("公式总卡.md", _CARD.replace("| x | 题型解析/01.md |", "|  |  |"), "公式总卡.md:link 题型解析/,公式总卡.md:rows"), ("公式总卡.md", _CARD.replace("高频公式速查", "公式"), "公式总卡.md:section 高频公式速查"),
    ("答题模板速查.md", _TEMPLATE.replace("[条件]", "条件"), "答题模板速查.md:blanks"), ("考前1小时清单.md", _HOUR.replace("15-5", ""), "考前1小时清单.md:slots"), ("考前1小时清单.md", _HOUR.replace("看公式", ""), "考前1小时清单.md:items"),
])
def pack_file(name, md):
    return F.array_join(G.pack_codes(name, md), ",")


@cases("join_guide_links", [("[x](题型解析/01-rank.md)", True), ("[x](%E9%A2%98%E5%9E%8B%E8%A7%A3%E6%9E%90/matrix-rank.md)", True), ("题型解析/matrix-rank", False), ("[x](other/matrix-rank.md)", False), ("[x](题型解析\\matrix-rank.md)", True), ("[a](b) [x](a/01-rank.md)", True)], "boolean")
def guide_link(md):
    return G.guide_links_type(md, "matrix-rank", "01-rank.md")


# --------------------------------------------------------------------------
# records


def _json(**fields) -> str:
    return json.dumps(fields, ensure_ascii=False)


_Q = {"question_id": "q1", "initial_type": "rank", "prompt_summary": "p", "solution_summary": "s", "evidence_refs": ["e"], "repeat_status": "needs-review"}


def _card_of(source="a.md", confidence="high", **changes) -> str:
    return _json(source=source, confidence=confidence, questions=[_Q | changes])


@cases("qc_paper_card", [
    (_card_of(), "final", ""), ("{", "final", "paper-card-invalid-json"), ("[]", "final", "paper-card-not-object"), (_card_of(source=""), "final", "paper-card-missing-source"), (_card_of(source="x\\y.md"), "final", ""), (_card_of(source="z.md"), "final", "paper-card-source-not-in-manifest"),
    (_card_of(confidence="sure"), "final", "paper-card-invalid-confidence"), (_json(source="a.md", confidence="low", questions=[]), "final", "paper-card-missing-questions"), (_card_of(question_id="", prompt_summary=" "), "final", "paper-card-question-missing-id,paper-card-question-missing-prompt-summary"),
    (_card_of(initial_type=None, solution_summary=None), "final", "paper-card-question-missing-solution-summary,paper-card-question-missing-initial-type"), (_card_of(evidence_refs=[]), "final", "paper-card-question-missing-evidence"), (_card_of(repeat_status="sometimes"), "final", "paper-card-invalid-repeat-status"),
    (_card_of(repeat_status="unique"), "paper-v0", "paper-card-premature-repeat-claim"), (_card_of(repeat_status="unique"), "final", ""),
])
def paper_card(text, stage):
    return F.array_join(R.card_codes(text, F.array(F.lit("a.md"), F.lit("x/y.md")), stage), ",")


_T = {"id": "rank", "name": "Rank", "confidence": "high", "source_refs": ["card-1.json#q1"]}


@cases("qc_taxonomy", [
    (_json(workflow=R.WORKFLOW, types=[_T]), ""), ("", "missing-taxonomy"), ("[1]", "taxonomy-not-object"), (_json(types=[_T]), "taxonomy-workflow"), (_json(workflow=R.WORKFLOW, types=[]), "taxonomy-empty"), (_json(workflow=R.WORKFLOW, types=[_T | {"name": ""}]), "taxonomy-type-missing-field"),
    (_json(workflow=R.WORKFLOW, types=[_T | {"source_refs": []}]), "taxonomy-type-missing-source-refs"), (_json(workflow=R.WORKFLOW, types=[_T, _T | {"source_refs": ["other.json#q"]}]), "taxonomy-type-source-not-card"), (_json(workflow=R.WORKFLOW, types=[{"id": "a", "name": "b", "confidence": "low", "representative_questions": ["card-1.json"]}]), ""),
])
def taxonomy(text):
    return F.array_join(R.taxonomy_codes(text, F.array(F.lit("card-1.json"))), ",")


_S = {"workflow": R.WORKFLOW, **{k: [] for k in R.SOURCE_LISTS}, "textbook_refs": ["book"], "paper_refs": ["a.md", "b\\c.md"]}


@cases("qc_source_map", [
    (_json(**_S), ""), (None, "missing-source-map"), ("3", "source-map-not-object"), (_json(**(_S | {"workflow": "x"})), "source-map-workflow"), (_json(**{k: v for k, v in _S.items() if k != "answer_refs"}), "source-map-missing-field"), (_json(**(_S | {"paper_refs": ["a.md"]})), "source-map-missing-paper-ref"),
    (_json(**(_S | {"textbook_refs": [" "]})), "source-map-empty-textbook-refs"),
])
def source_map(text):
    return F.array_join(R.source_map_codes(text, F.array(F.lit("a.md"), F.lit("b/c.md"))), ",")


_P = {"id": "p1", "path": "a.md", "canonical_problem_source": "a.md", "canonical_answer_source": "b\\c.md", "all_sources": ["a.md", "d.md"], "source_roles": {"problem": ["a.md"], "answer": ["e.md"]}}


@cases("qc_manifest", [
    (_json(papers=[_P]), "", "a.md,b/c.md,d.md,e.md"), (_json(papers=[_P | {"id": "p2"}]), "missing-paper-card,missing-paper-deep-dive", "a.md,b/c.md,d.md,e.md"), (_json(papers=[_P | {"source_roles": {}}]), "manifest-paper-missing-canonical-source-role", "a.md,b/c.md,d.md"),
    (_json(papers=[_P | {"id": "p9", "paper_card": "cards/x.json"}]), "missing-paper-deep-dive", "a.md,b/c.md,d.md,e.md"), (_json(papers=[]), "", ""), ("{}", "", ""),
])
def manifest_sources_of(text, _):
    return F.array_join(R.manifest_sources(text), ",")


@cases("qc_manifest_outputs", [
    (_json(papers=[_P]), ""), (_json(papers=[_P | {"id": "p2"}]), "missing-paper-card,missing-paper-deep-dive"), (_json(papers=[_P | {"source_roles": {}}]), "manifest-paper-missing-canonical-source-role"), (_json(papers=[_P | {"canonical_problem_source": ""}]), "manifest-paper-missing-canonical-source-role"),
    (_json(papers=[_P | {"id": "p9", "paper_card": "cards/x.json"}]), "missing-paper-deep-dive"), (_json(papers=[]), ""),
])
def manifest(text):
    return F.array_join(R.manifest_codes(text, F.array(F.lit("paper-cards/p1.json"), F.lit("试卷精析/p1.md"), F.lit("cards/x.json"))), ",")


_D = {"type_id": "rank", "type_name": "Rank", "confidence": "high", "source_question_refs": ["c.json#q1"], "recognition_cues": ["x"], "common_variants": ["x"], "method_cards": ["x"], "formula_cards": ["x"], "pitfalls": ["x"], "worked_example_candidates": [{"question_ref": "c.json#q1", "reason": "r"}], "self_test_candidates": ["c.json#q2"], "insufficient_evidence_notes": ""}


@cases("qc_dossier", [
    (_json(**_D), ""), ("x", "type-dossier-invalid-json"), ("[]", "type-dossier-not-object"), (_json(**(_D | {"pitfalls": []})), "type-dossier-missing-field"), (_json(**(_D | {"quality": "needs-review"})), "type-dossier-missing-field"), (_json(**(_D | {"type_id": "other"})), "type-dossier-type-mismatch"),
    (_json(**(_D | {"confidence": "maybe"})), "type-dossier-invalid-confidence"), (_json(**(_D | {"source_question_refs": ["c.json#q9"]})), "type-dossier-unknown-question-ref"), (_json(**(_D | {"self_test_candidates": ["c.json#q1"]})), "type-dossier-example-selftest-overlap"),
    (_json(**(_D | {"self_test_candidates": ["c.json#q2", {"ref": "c.json#q2"}]})), "type-dossier-duplicate-self-test"), (_json(**(_D | {"pitfalls": ["模拟题"]})), "type-dossier-fabricated-question"),
])
def dossier(text):
    return F.array_join(R.dossier_codes(text, F.lit("rank"), F.array(F.lit("c.json#q1"), F.lit("c.json#q2"))), ",")


@cases("fn_ref_flatten", [
    ('"see a.json#q1, b.json#q2"', "a.json#q1|b.json#q2"), ('["a.json#q1", {"question_ref": "b.json#q2", "refs": 1}]', "a.json#q1|b.json#q2"), ("null", ""), ('[["x-1.json#一.2"], []]', "x-1.json#一.2"), ('{"source_refs": ["a.json#q1", "a.json#q1"]}', "a.json#q1|a.json#q1"), ("[1, true]", ""),
])
def refs_of(value):
    return F.array_join(R.question_refs(F.concat(F.lit('{"v": '), value, F.lit("}")), "v"), "|")


@cases("join_question_refs", [("c#1,c#2", "c#2,c#3", "c#1", "c#3;c#2"), ("c#1", "c#1", "c#1", ";c#1"), ("c#1", "c#4", "c#1", "c#4;"), ("", "", "", ";")])
def question_refs(shown, tests, known):
    """References that no card has; and those that are example and test at once."""
    listed = lambda x: F.filter(F.split(x, ","), lambda v: v != "")
    every = F.array_sort(F.array_distinct(F.concat(listed(shown), listed(tests))))
    held = F.concat(listed(known), F.when(shown.contains(","), F.array(F.lit("c#2"))).otherwise(F.array().cast("array<string>")))
    return F.concat_ws(";", F.array_join(F.array_except(every, held), ","), F.array_join(F.array_intersect(listed(shown), listed(tests)), ","))


@cases("fn_human_sources", [
    ("来源：2018-2019 第二学期 · 一.2。其他", "2018-2019第二学期·一.2"), ("**来源**：A 卷\n来源: B 卷；x", "A卷|B卷"), ("无", ""), ("来源：，。", ""), ("来源： 甲 ， ", "甲"),
])
def sources_of(md):
    return F.array_join(G.human_sources(md), "|")


@cases("pred_insufficient", [("证据不足", True), ("需人工补充", True), ("quality: needs-review", True), ("证据充分", False), ("", False)], "boolean")
def too_little(md):
    return G.insufficient(md)


@cases("pred_heading", [("## 核心概念", True), ("###### 关于核心概念的说明", True), ("核心概念", False), ("#核心概念", False), ("a\n# x 核心概念\n", True)], "boolean")
def heading_with(md):
    return md.rlike(G.ANY + r"^#{1,6}\s+.*核心概念")


@cases("fn_has_substance", [("## Only a heading here", False), ("| --- | --- |", False), ("eight ch", True), ("seven c", False), ("[text of a link](url)", True), ("**bold** `code`", True), ("{{placeholder}} text", False), ("", False)], "boolean")
def substance(md):
    return G.has_substance(md, 8)


@cases("fn_strip_markup", [("# Head\ntext", "text"), ("[a b](c) *x*", "a b x"), ("> | a | b |", "a b"), ("a_b-c", "a b c"), ("", "")])
def stripped(md):
    return G.plain(md)


@cases("fn_section_body", [
    ("## A\nx\n### B\ny\n## C\nz", "A", "x\n### B\ny\n"), ("## A\nx\n### B\ny\n## C\nz", "B", "y\n"), ("# T\n## A\nx", "T", "## A\nx"), ("no heading A here\nx\n## C", "A", ""), ("## A", "A", ""), ("### A1\nx\n#### d\ny\n### e", "A", "x\n#### d\ny\n"),
])
def body_below(md, title):
    return F.coalesce(*(F.when(title == t, G.section(md, t)) for t in ("A", "B", "T")))


@cases("fn_section_body_anywhere", [("marker A here\nx\n### y\nz\n## C\nw", "x\n### y\nz\n"), ("## A\nx\n# C", "x\n"), ("none", ""), ("x\n- A:\ny\n# z", "y\n")])
def body_anywhere(md):
    return G.section(md, "A", True)


@cases("sel_section_text", [
    ("## 例题精讲\nx\n### 例题 1\ny\n## 自测题\nz", "x\n### 例题 1\ny\n"), ("### 例题 1\ny\n## 真题例解\nw\n## 快速得分\nz", "w\n"), ("## 其他\nx", ""), ("#### 例题\na\n## 自测题\nb", "a\n"),
])
def outline(md):
    return G.outline_section(md, G.PARTS["例题"], (*G.PARTS["自测题"], *G.LATER))


@cases("fn_split_blocks", [(PAGE, "5|4|4"), ("### Example one\nx\n### 例题 二\ny", "2|0|0"), ("## 自测题\n### 自测 1\na\n### 自测 1 答案\nb\n### Self-test 2\nc\n## 自测答案\n### 自测 1 答案\nd", "0|2|1"), ("", "0|0|0")])
def blocks(md):
    return F.concat_ws("|", *(F.size(b).cast("string") for b in (G.examples(md), G.self_tests(md), G.answers(md))))


LINE60 = "a block of sixty characters or more that is written down twice"


@cases("agg_dup_blocks", [(f"答案：{LINE60}\n### b\n答案: {LINE60.replace(' ', '  ')}\n", True), (f"答案：{LINE60}\n### b\n答案：{LINE60} else\n", False), ("答案：short\n### b\n答案：short\n", False), ("", False)], "boolean")
def dup_blocks(md):
    return G.repeated(G._long_blocks(md, r"(?s)答案\s*[：:]\s*(.+?)(?=\n\s*(?:###|##)|\z)"))


# --------------------------------------------------------------------------
# binding and canonical papers

def _cascade(spark, sf_dir):
    """Ten papers for every ten documents, and their annotations.

    0 has its file, 1 declares the same one, 2 has a file in another folder, 3 a file by its source, 4 declares
    one of the two files whose source is 5's path, so that 5 has one left; 6 has a loose source; the loose source
    of 8 fits 7 too, which is bound before by its own file; 9 has two files named after its source.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).alias("r"), F.floor(F.col("doc_id") / 10).cast("string").alias("g"))
    docs = docs.withColumn("stem", F.concat(F.lit("p"), "g", F.lit("-"), F.col("r").cast("string")))
    of = lambda *parts: F.concat(*(F.lit(x) if not x.startswith("@") else F.col(x[1:]) for x in parts))
    path = F.when(F.col("r") == 6, of("./papers/x/", "@stem", ".pdf.md")).when(F.col("r").isin(7, 8), F.concat(F.lit("papers/p"), F.col("r").cast("string"), F.lit("/d"), "g", F.lit(".pdf.md"))).otherwise(of("papers/", "@stem", ".pdf.md"))
    declared = F.when(F.col("r") == 1, of("annotations/p", "@g", "-0.json")).when(F.col("r") == 4, of("annotations/n", "@g", "-5a.json"))
    papers = docs.select(F.col("doc_id").alias("seq"), "stem", path.alias("path"), declared.alias("annotation"))
    note = lambda file, source=F.lit(""): F.struct(file.alias("file"), source.alias("source"))
    own = of("papers/", "@stem", ".pdf.md")
    files = (
        F.when(F.col("r").isin(0, 7), F.array(note(of("annotations/", "@stem", ".json"))))
        .when(F.col("r") == 2, F.array(note(of("annotations/old/", "@stem", ".json"))))
        .when(F.col("r") == 3, F.array(note(of("annotations/n", "@g", "-3.json"), own)))
        .when(F.col("r") == 5, F.array(note(of("annotations/n", "@g", "-5a.json"), own), note(of("annotations/n", "@g", "-5b.json"), own)))
        .when(F.col("r") == 6, F.array(note(of("annotations/m", "@g", "-6.json"), of("x\\", "@stem", ".pdf.md"))))
        .when(F.col("r") == 8, F.array(note(of("annotations/m", "@g", "-7.json"), of("d", "@g", ".pdf.md"))))
        .when(F.col("r") == 9, F.array(note(of("annotations/", "@stem", ".pdf.md.json")), note(of("annotations/", "@stem", ".md.json"))))
    )
    return papers, docs.select(F.explode(files).alias("x")).select("x.*")


@register("join_annotation_cascade", """with d as (select doc_id % 10 r, cast(doc_id // 10 as string) g, concat('p', cast(doc_id // 10 as string), '-', cast(doc_id % 10 as string)) stem from documents)
select stem, case r when 0 then concat('annotations/', stem, '.json') when 2 then concat('annotations/old/', stem, '.json') when 3 then concat('annotations/n', g, '-3.json') when 4 then concat('annotations/n', g, '-5a.json')
 when 5 then concat('annotations/n', g, '-5b.json') when 6 then concat('annotations/m', g, '-6.json') when 7 then concat('annotations/', stem, '.json') when 8 then concat('annotations/m', g, '-7.json') end file,
 cast([1, 1, 2, 4, 1, 4, 5, 1, 5, 3][r + 1] as int) tier, case r when 1 then 'annotation_already_bound' when 9 then 'ambiguous_annotation_fallback' end error from d""")
def join_annotation_cascade(spark, sf_dir):
    """Five rules in the order of papers, where bindings free others and take files from later papers."""
    return R.bind(*_cascade(spark, sf_dir))


@register(
    "join_annotation_papers",
    "select concat('paper-', cast(doc_id as string)) stem, case when doc_id % 3 <> 2 then concat('annotations/', case when doc_id % 3 = 0 then '' else 'old/' end, 'paper-', cast(doc_id as string), '.json') else concat('annotations/n', cast(doc_id as string), '.json') end file, case doc_id % 3 when 0 then 1 when 1 then 2 else 4 end tier, cast(null as varchar) error from documents",
)
def join_annotation_papers(spark, sf_dir):
    """The same over a paper for each document: exact files, files in another folder, and sources."""
    docs, text = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    stem = F.concat(F.lit("paper-"), text)
    path = F.concat(F.lit("papers/"), stem, F.lit(".pdf.md"))
    papers = docs.select(F.col("doc_id").alias("seq"), stem.alias("stem"), path.alias("path"), F.lit(None).cast("string").alias("annotation"))
    kind = F.col("doc_id") % 3
    file = F.concat(F.lit("annotations/"), F.when(kind == 1, "old/").otherwise(""), F.when(kind == 2, F.concat(F.lit("n"), text)).otherwise(stem), F.lit(".json"))
    return R.bind(papers, docs.select(file.alias("file"), F.when(kind == 2, path).otherwise("").alias("source")))
