"""Gates over teaching pages: marker, section and block rules as expressions, a code for each rule that fails.

A gate takes the text of a page as a column and gives its codes as an array, so that a
page is read once, where it is, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python import per_value

ANY = "(?mdU)"


def codes(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()))))


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def holds(text: Column, markers) -> Column:
    return any_of(F.contains(text, F.lit(m)) for m in markers)


def words(*texts: str) -> str:
    """A pattern for any of some plain texts."""
    return "|".join(map(re.escape, texts))


# --------------------------------------------------------------------------
# sections, blocks, tables


def _rest(match: Column) -> Column:
    """A match without its first line."""
    return F.coalesce(F.get(F.split(match, "\n", 2), F.lit(1)), F.lit(""))


def outline(text: Column) -> Column:
    """The text cut before each heading.

    ``parts`` (heading included) and their ``levels`` (0 for what stands above the first); ``heads`` and
    ``flat`` have a line for each part, of its heading and of all of it, for titles to be found in.
    """
    signs = lambda b: F.char_length(F.regexp_extract(b, r"(?U)\A(#{1,6})(?!#)\s", 1))
    head = lambda b, level: F.when(level > 0, F.substring_index(b, "\n", 1)).otherwise(F.lit(""))
    one_line = lambda b: F.replace(b, F.lit("\n"), F.lit(LINE_END))

    def cut(parts: Column) -> Column:
        joined = lambda levels: F.struct(parts.alias("parts"), levels.alias("levels"), F.array_join(F.zip_with(parts, levels, head), "\n").alias("heads"), F.array_join(F.transform(parts, one_line), "\n").alias("flat"))
        return X.let(F.transform(parts, signs), joined)

    return X.let(F.split(text, ANY + r"^(?=#{1,6}(?!#)\s)"), cut)


#: What stands for the end of a line inside a part that is a line itself; no title holds it.
LINE_END = "\x01"


def _line_with(lines: Column, title: Column) -> Column:
    """The number of the first line that holds ``title``, 0 without one."""
    ends = lambda b: F.octet_length(b) - F.octet_length(F.replace(b, F.lit("\n"), F.lit("")))
    return X.let(_before(lines, title), lambda b: F.when(F.octet_length(b) < F.octet_length(lines), ends(b) + 1).otherwise(0))


def _before(text: Column, marker: Column) -> Column:
    """What stands before the first ``marker``, all of it without one; looks at bytes, where ``position`` counts characters."""
    return F.call_function("substring_index", text, marker, F.lit(1))


def section_of(cut: Column, title: Column, anywhere: Column) -> Column:
    """What follows the first heading of an outline that holds ``title`` up to one of its level or above.

    ``anywhere``: a line that is no heading counts too, with the level of a second one.
    """

    def found(at: Column) -> Column:
        first, own = F.get(cut["parts"], at - 1), F.get(cut["levels"], at - 1)
        in_head = (own > 0) & F.contains(F.substring_index(first, "\n", 1), title)
        below = lambda level: F.array_position(F.transform(F.slice(cut["levels"], at + 1, F.lit(1 << 20)), lambda v: v <= level), True).cast("int")
        line = F.when(in_head, first).otherwise(F.substring(first, F.position(title, first), F.char_length(first)))
        stop = X.let(F.when(in_head, own).otherwise(2), below)
        return F.concat(_rest(line), F.array_join(F.slice(cut["parts"], at + 1, X.let(stop, lambda n: F.when(n > 0, n - 1).otherwise(1 << 20))), ""))

    at = _line_with(F.when(anywhere, cut["flat"]).otherwise(cut["heads"]), title)
    return X.let(at, lambda i: F.when(i > 0, found(i)).otherwise(F.lit("")))


def section(text: Column, title: str, anywhere: bool = False) -> Column:
    return F.when(F.contains(text, F.lit(title)), X.let(outline(text), lambda cut: section_of(cut, F.lit(title), F.lit(anywhere)))).otherwise(F.substring(text, 1, 0))


def outline_section(text: Column, titles: tuple[str, ...], stops: tuple[str, ...]) -> Column:
    """What follows the highest heading with one of ``titles`` up to one with ``stops`` of its level or above."""
    found = [F.nullif(F.regexp_extract(text, rf"{ANY}^#{{{n}}}(?!#)\s+[^\n]*(?:{words(*titles)})[^\n]*$(?s:.*?)(?=^#{{1,{n}}}(?!#)\s+[^\n]*(?:{words(*stops)})|\z)", 0), F.lit("")) for n in range(2, 7)]
    return _rest(F.coalesce(*found, F.lit("")))


def plain(text: Column) -> Column:
    """Text without headings, links' targets and signs of markup, white space as one blank."""
    text = F.when(F.contains(text, F.lit("#")), F.regexp_replace(text, ANY + r"^#{1,6}\s+.*$", " ")).otherwise(text)
    linked = lambda t: F.when(F.contains(t, F.lit("](")), F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")).otherwise(t)
    return F.btrim(F.regexp_replace(X.let(text, linked), r"(?U)[\s|>`*_#\-\[\]()]+", " "))


def has_substance(text: Column, least: int | Column) -> Column:
    told = lambda body: (F.char_length(body) >= least) & ~body.rlike(r"\A[|:\- ]*\z") & ~(F.contains(body, F.lit("{{")) & body.rlike(r"\{\{[^}]+\}\}"))
    return X.let(text, lambda t: (F.char_length(t) >= least) & X.let(plain(t), told))


def after(text: Column, marker: str | Column, n: int) -> Column:
    """``n`` characters after the first ``marker``; null without one."""
    marker = F.lit(marker) if isinstance(marker, str) else marker
    at = F.char_length(_before(text, marker)) + 1
    return F.when(F.contains(text, marker), F.substring(text, at + F.char_length(marker), F.lit(n)))


def _substance_after(text: Column, markers: tuple[str, ...], n: int, least: int) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.coalesce(has_substance(after(text, m, n), least), F.lit(False)))


def table_rows(text: Column, least: int) -> Column:
    """Cells of table rows that are neither headers nor separators, with so many filled ones at least."""
    rows = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?md)^\s*\|.*$"), F.lit(0)), lambda v: F.btrim(v, F.lit(" \n"))), lambda x: x.startswith("|") & ~x.rlike(r"^\|(\s*:?-{3,}\s*\|)+\s*$") & ~x.rlike(r"^\|?\s*:?-{3,}"))
    cells = F.transform(rows, lambda x: F.transform(F.split(F.btrim(x, F.lit("|")), r"\|"), lambda v: F.btrim(v)))
    return F.filter(cells, lambda c: ~F.get(c, F.lit(0)).isin(*TABLE_HEADS) & (F.size(F.filter(c, lambda v: v != "")) >= least))


def _row_width(line: str) -> int | None:
    line = line.strip()
    if not line.startswith("|"):
        return None
    cells = re.split(r"(?<!\\)\|", line)
    if RULE.fullmatch(line):
        return sum(bool(c.strip()) for c in cells) or None
    return len(cells) - (not cells[0].strip()) - (len(cells) > 1 and not cells[-1].strip())


RULE = re.compile(r"\|[\s\-:|]+\|?")


def table_faults(text: str) -> str:
    """Numbers of the lines whose cells do not match the header of their table, joined by commas."""
    lines = [(n, line, _row_width(line) if "|" in line else None) for n, line in enumerate(text.splitlines(), 1)]
    faults, at = [], 0
    while at + 1 < len(lines):
        (_, _, width), (number, line, below) = lines[at], lines[at + 1]
        at += 1
        if not width or below is None or not RULE.fullmatch(line.strip()):
            continue
        if below != width:
            faults.append(number)
            continue
        at += 1
        while at < len(lines) and lines[at][2] is not None:
            if lines[at][2] != width:
                faults.append(lines[at][0])
            at += 1
    return ",".join(map(str, faults))


broken_tables = per_value(table_faults)

# --------------------------------------------------------------------------
# structural gate of a type page

# What a page has to hold.
SECTIONS = ["元信息", "真卷对应题号", "考前速记", "核心概念", "核心方法", "零基础先看这里", "例题精讲", "自测题", "自测答案", "快速得分技巧", "易错点与检查清单", "来源校对说明"]
ENTRY = ["这类题考试到底在考什么", "30秒认题", "2分钟下笔模板", "不会做时先写什么拿步骤分"]
FIELDS = ["type", "course", "exam_scope", "exam_type_id", "exam_type_name", "rank", "paper_count", "must_know", "quality", "status"]
TABLE_HEADS = ["时间情况", "策略", "大约可省", "易错点", "错误做法", "正确做法", "原因", "项目", "内容"]
RESIDUE = r"Seeded from|^\|\s*Paper\s*\|\s*(?:Reliability|Difficulty|Format)\s*\||^\|\s*[^|\n]*\|\s*unspecified\s*\||^#{1,6}\s+Common Pitfalls\b"
TEACHING = "为什么这么做|先做什么，为什么|为什么|验算|易错点对比|错法|正法"
METHOD_REF = r"【方法引用】[^\S\r\n]*\S+"
VAGUE_SOURCE = r"来源(?i:\s*[：:]\s*(真题|待补|待补充|TBD|TODO)?\s*$)"
EMPTY_SOURCES = ["真题", "待补", "待补充", "TBD", "TODO"]
SOURCE_SAMPLES = ["YYYY", "第X学期", "第X题"]
EXAMPLE_HEAD = r"^###\s*(?:例题|Example)\b"
TEST_HEAD = r"(?i:^###\s*(?:自测|Self[- ]?test)\s+(\d+)(?!\s*答案)\b)"
ANSWER_HEAD = r"^###\s*自测\s+(\d+)\s*答案\b"
BLANKS = r"\[(?:表达式|值|答案|结论|中间量|步骤[0-9一二三四五六七八九十]*|占位符)\]"
SHORT_MARK = "证据不足，需人工补充"


#: Sections that the gate looks at, and whether a line that is no heading may open them.
STRUCTURE_TITLES = [
    *((t, False) for t in ("自测题", "自测答案", "核心概念", "核心方法", "快速得分技巧", "易错点与检查清单", "易错点", "填空式答题模板", "2分钟下笔模板")),
    *((t, True) for t in (*ENTRY, "元信息", "一眼先记住", "符号", "术语", "易错点与检查清单", "最容易混", "易错点", "方法选择", "决策", "关键公式表", "最少必须记住的公式", "本篇最少")),
]


def quality(text: Column) -> Column:
    return F.btrim(F.regexp_extract(X.front_matter(text), r"(?md)^quality:\s*[\"']?(.+?)[\"']?\s*$", 1))


def evidence_short(text: Column) -> Column:
    return F.contains(text, F.lit(SHORT_MARK)) & F.coalesce(quality(text) == "needs-review", F.lit(False))


def concrete_source(value: Column) -> Column:
    """Whether a source names a paper, and not only that there is one."""

    def names_a_paper(name: Column) -> Column:
        told = (F.contains(name, F.lit("题号待人工校对")) & (F.char_length(name) >= 6)) | (F.char_length(name) >= 4) | name.rlike(r"\d{4}|期中|期末|学期|试卷|第\s*\d+\s*题")
        return (name != "") & ~name.isin(*EMPTY_SOURCES) & ~holds(name, SOURCE_SAMPLES) & told

    return X.let(F.btrim(F.btrim(F.btrim(value), F.lit("*"))), names_a_paper)


def has_source(block: Column) -> Column:
    in_head = F.regexp_extract_all(F.substring_index(block, "\n", 1), F.lit("（来源：([^）]*)）"), F.lit(1))
    tails = F.regexp_extract_all(block, F.lit(r"来源\s*[：:](?=([^\n]*))"), F.lit(1))
    return F.contains(block, F.lit("来源")) & F.exists(F.concat(F.slice(in_head, 1, 1), tails), concrete_source)


def examples(text: Column) -> Column:
    return F.slice(F.split(text, ANY + EXAMPLE_HEAD), 2, 1 << 20)


def filled_example(block: Column, known: Column) -> Column:
    prompt = _substance_after(block, ("题目原文", "题目：", "题目"), 400, 6) | has_substance(F.substring(block, 1, 500), 40)
    solved = _substance_after(block, ("完整解析", "解析", "Solution"), 600, 12)
    method = ~holds(block, ("步骤 _", "步骤 X")) & F.contains(block, F.lit("【方法引用】")) & block.rlike(METHOD_REF)
    return holds(block, TEACHING.split("|")) & method & known & solved & prompt


def _numbered(text: Column, head: str) -> Column:
    """Blocks that begin with a numbered heading."""
    return F.filter(F.split(text, f"{ANY}(?={head})"), lambda b: b.rlike(ANY + r"\A(?:" + head + ")"))


def self_tests(text: Column) -> Column:
    own = section(text, "自测题")
    return _numbered(F.when(F.btrim(own) != "", own).otherwise(text), TEST_HEAD)


def answers(text: Column) -> Column:
    return _numbered(section(text, "自测答案"), ANSWER_HEAD)


def has_answer(block: Column) -> Column:
    return _substance_after(block, ("答案与解析", "**答案**", "答案：", "答案:", "Answer:", "Answer：", "Answer"), 500, 6)


def _number(block: Column, head: str) -> Column:
    return F.regexp_extract(block, ANY + head, 1)


def answered(given: Column) -> Column:
    """Numbers of the tests that the answers' section answers."""
    return F.transform(F.filter(given, has_answer), lambda a: _number(a, ANSWER_HEAD))


def filled_test(block: Column, known: Column, apart: Column, numbers: Column) -> Column:
    """A test with a source and a question, whose answer stands in its own section (or inside, where there is none)."""
    prompt = _substance_after(block, ("**题目**", "题目：", "题目"), 400, 6) | has_substance(F.substring(block, 1, 400), 20)
    return known & prompt & (F.array_contains(numbers, _number(block, TEST_HEAD)) | (~apart & has_answer(block)))


def answers_apart(text: Column) -> Column:
    return has_heading(text, "自测答案")


def has_heading(text: Column, title: str) -> Column:
    """A heading that begins with ``title`` and a boundary; the usual form is a plain search."""
    return F.contains(text, F.lit(f"\n## {title}\n")) | (F.contains(text, F.lit(title)) & text.rlike(rf"{ANY}^#{{1,6}}\s+{title}\b"))


def starred(block: Column) -> Column:
    head = F.array_join(F.slice(F.split(block, "\n", 13), 1, 12), "\n")
    graded = lambda h: F.contains(h, F.lit("⭐⭐")) | (F.contains(h, F.lit("⭐")) & F.contains(h, F.lit("难度")) & (h.rlike(r"难度\s*[：:].*⭐") | h.rlike(r"(?md)^\*\*难度\*\*\s*[：:].*⭐")))
    return F.contains(block, F.lit("⭐")) & X.let(head, graded)


def ungrounded_block(block: Column, known: Column) -> Column:
    """Without a source that names a paper, or made up."""
    made_up = holds(block, ("自编题", "模拟题")) & ~holds(block, ("改编", "原题"))
    vague = F.contains(block, F.lit("来源")) & block.rlike(ANY + VAGUE_SOURCE)
    return ~known | made_up | vague


def counts(text: Column) -> dict[str, Column]:
    """Examples and tests that are filled in, examples with stars, references to methods."""
    numbers = answered(answers(text))
    return {
        "examples": F.size(F.filter(examples(text), lambda b: filled_example(b, has_source(b)))),
        "self_tests": F.size(X.let(numbers, lambda n: F.filter(self_tests(text), lambda b: filled_test(b, has_source(b), answers_apart(text), n)))),
        "starred": F.size(F.filter(examples(text), starred)),
        "method_refs": F.regexp_count(text, F.lit(METHOD_REF)),
    }


def _first_section(text: Column, *titles: str, anywhere: bool = True) -> Column:
    return _first_of(lambda title: section(text, title, anywhere), titles)


def _first_of(cut: Callable[[str], Column], titles: tuple[str, ...]) -> Column:
    found = [F.nullif(F.btrim(cut(t)), F.lit("")) for t in titles]
    return F.coalesce(*found, F.lit(""))


def frontmatter_faulty(text: Column) -> Column:
    wanted = F.array(*map(F.lit, FIELDS))

    def faulty(front: Column) -> Column:
        names = F.regexp_extract_all(front, F.lit(r"(?md)^([A-Za-z_]\w*)\s*:"), F.lit(1))
        bulky = front.rlike(r"(?md)^source_artifacts:\s*\[") | front.rlike(r"(?md)^generated_fingerprint:")
        return bulky | X.let(names, lambda n: (F.size(F.array_except(wanted, n)) > 0) | (F.size(F.array_except(n, F.array_append(wanted, F.lit("source_summary")))) > 0))

    return F.coalesce(X.let(X.front_matter(text), faulty), F.lit(True))


def concepts_told(body: Column) -> Column:
    told = body.rlike(r"(?i)参考\s*[：:]\s*\S+|教材\s*[：:]|来自教材|见教材|基于考纲整理|未参考指定教材")
    return holds(body, ("定义", "对比", "|")) & told


def concept_faulty(text: Column) -> Column:
    body = section(text, "核心概念")
    return ~text.rlike(ANY + r"^#{1,6}\s+核心概念\b") | ~has_substance(body, 8) | ~concepts_told(body)


def strategies_faulty(body: Column) -> Column:
    filled = F.filter(table_rows(body, 2), lambda c: ~F.coalesce(F.get(c, F.lit(1)), F.lit("")).isin("", "策略", "---"))
    return ~body.rlike("时间充裕|时间紧张|几乎不够|完全不会|时间不够") | (F.size(filled) < 2)


def scoring_faulty(text: Column) -> Column:
    return ~text.rlike(ANY + r"^#{1,6}\s+快速得分技巧\b") | strategies_faulty(section(text, "快速得分技巧"))


def comparisons_faulty(body: Column) -> Column:
    return (body == "") | ~(F.contains(body, F.lit("错误做法")) & F.contains(body, F.lit("正确做法")) & F.contains(body, F.lit("原因"))) | (F.size(table_rows(body, 3)) < 1)


def errors_faulty(text: Column) -> Column:
    return comparisons_faulty(_first_section(text, "易错点与检查清单", "易错点", anywhere=False))


def tests_answered(questions: Column) -> Column:
    """Whether an answer with substance stands among the tests."""
    tails = F.slice(F.split(questions, ANY + r"答案与解析|^\s*\*\*?答案\*\*?\s*[：:]|^\s*答案\s*[：:]|Answer\s*[：:]"), 2, 1 << 20)
    return F.exists(tails, lambda t: has_substance(F.substring(t, 1, 400), 6))


def answers_mixed(text: Column) -> Column:
    return ~answers_apart(text) | tests_answered(section(text, "自测题"))


def with_structure(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``failed``, the checks of a type page that fail; pages that own up to too little evidence need less of it.

    Sections and blocks are cut once, as columns of their own, then what is to be known of
    each block, and the 26 checks look at those; only a few patterns pass over the whole text.
    """
    text, kept = F.col(text_col), df.columns
    col = lambda name: F.col(f"_{name}")
    titles = F.array(*(F.struct(F.lit(t).alias("title"), F.lit(anywhere).alias("anywhere")) for t, anywhere in STRUCTURE_TITLES))
    cut = lambda title, anywhere=False: F.get(col("sections"), F.lit(STRUCTURE_TITLES.index((title, anywhere))))
    either = lambda *titles, anywhere=True: _first_of(lambda t: cut(t, anywhere), titles)
    df = df.withColumn("_parts", outline(text)).withColumn("_sections", F.transform(titles, lambda t: section_of(col("parts"), t["title"], t["anywhere"])))
    df = df.withColumns({f"_{k}": v for k, v in {
        "short": evidence_short(text), "apart": answers_apart(text), "examples": examples(text), "tests": _numbered(F.when(F.btrim(cut("自测题")) != "", cut("自测题")).otherwise(text), TEST_HEAD),
        "numbers": answered(_numbered(cut("自测答案"), ANSWER_HEAD)), "errors": either("易错点与检查清单", "易错点", anywhere=False), "meta": F.coalesce(F.nullif(cut("元信息", True), F.lit("")), text),
    }.items()})
    verified = lambda t: t.rlike("[vV](?i:erify)")
    checked = X.let(verified(text), lambda english: F.array_join(F.filter(F.split(text, "\n"), lambda v: holds(v, ("验证", "校验", "验算")) | (english & verified(v))), "\n"))
    decision = F.coalesce(F.nullif(either("方法选择", "决策"), F.lit("")), F.substring(text, F.position(F.lit("├"), text), F.lit(160)))
    wanted = {  # bodies, and the characters that make substance of them
        **{m: (cut(m, True), 6) for m in ENTRY}, "badge": (F.substring(col("meta"), 1, 240), 6), "lookup": (cut("一眼先记住", True), 6), "symbols": (F.concat(cut("符号", True), F.lit("\n"), cut("术语", True)), 6),
        "pitfalls": (either("易错点与检查清单", "最容易混", "易错点"), 8), "decision": (decision, 6), "formulas": (either("关键公式表", "最少必须记住的公式", "本篇最少"), 8), "checked": (checked, 4),
        "concepts": (cut("核心概念"), 8), "methods": (cut("核心方法"), 8),
    }
    bodies = F.array(*(F.struct(body.alias("body"), F.lit(n).alias("least")) for body, n in wanted.values()))
    has = lambda name: F.get(col("substance"), F.lit(list(wanted).index(name)))
    sourced = lambda rule: lambda b: X.let(has_source(b), lambda known: rule(b, known))
    told = df.withColumns({
        "_substance": F.transform(bodies, lambda b: has_substance(b["body"], b["least"])),
        "_shown": F.transform(col("examples"), sourced(lambda b, known: F.struct(filled_example(b, known).alias("filled"), starred(b).alias("starred"), ungrounded_block(b, known).alias("ungrounded")))),
        "_tried": F.transform(col("tests"), sourced(lambda b, known: F.struct(filled_test(b, known, col("apart"), col("numbers")).alias("filled"), ungrounded_block(b, known).alias("ungrounded")))),
    })
    counted = lambda blocks, name: F.size(F.filter(blocks, lambda b: b[name]))
    least = lambda usual: F.when(col("short"), 1).otherwise(usual)
    meta, heading = col("meta"), lambda title: has_heading(text, title)
    template = F.coalesce(F.nullif(either("填空式答题模板", "2分钟下笔模板", anywhere=False), F.lit("")), text)
    faulty = {
        "required_sections": ~reduce(lambda a, b: a & b, (F.contains(text, F.lit(s)) for s in SECTIONS)),
        "entry_layer": any_of(~F.contains(text, F.lit(m)) | ~has(m) for m in ENTRY),
        "worked_examples": counted(col("shown"), "filled") < least(5),
        "self_tests": counted(col("tried"), "filled") < least(4),
        "badge": ~((holds(meta, ["频率"]) | holds(text, ["考试频率"])) & holds(text, ["难度"]) & has("badge") & ~F.contains(F.substring(meta, 1, 120), F.lit("{{"))),
        "quick_lookup": ~has("lookup"),
        "symbols": ~has("symbols"),
        "pitfalls": ~has("pitfalls"),
        "decision_tree": ~F.contains(text, F.lit("├")) | ~has("decision"),
        "formulas": ~has("formulas"),
        "method_reference": F.regexp_count(text, F.lit(METHOD_REF)) < least(5),
        "verification_steps": ~has("checked"),
        "no_placeholders": F.contains(text, F.lit("{{")) & text.rlike(r"\{\{[^}]+\}\}") | F.contains(text, F.lit("_(fill by review-coach)_")),
        "frontmatter_shape": frontmatter_faulty(text),
        "markdown_tables": broken_tables(text) != "",
        "chinese_user_facing": residue(text),
        "source_grounding": (F.size(col("shown")) + F.size(col("tried")) == 0) | (counted(col("shown"), "ungrounded") + counted(col("tried"), "ungrounded") > 0),
        "render_safe_markdown": ((text.startswith(">") | F.contains(text, F.lit("\n>"))) & text.rlike(r"(?md)^>\s*\|")) | F.contains(text, F.lit("$$")) & F.exists(F.regexp_extract_all(text, F.lit(r"(?is)<details\b[^>]*>.*?</details>"), F.lit(0)), lambda d: d.contains("$$")),
        "teaching_scaffolding": ~holds(text, ("方法选择树", "决策流程", "├", "方法选择")) | ~holds(text, TEACHING.split("|")) | ~holds(text, ("易错点", "错法", "正法", "最容易混", "错误做法")) | ~holds(text, ("验算", "校验", "验证", "检查方式")) | ~holds(text, [ENTRY[3]]),
        "concept_explanation": ~heading("核心概念") | ~has("concepts") | ~concepts_told(cut("核心概念")),
        "core_methods": ~heading("核心方法") | ~has("methods") | ~holds(cut("核心方法"), ("适用场景", "方法选择")),
        "scoring_strategy": ~heading("快速得分技巧") | strategies_faulty(cut("快速得分技巧")),
        "error_comparison": comparisons_faulty(col("errors")),
        "difficulty_stars": counted(col("shown"), "starred") < least(3),
        "self_test_answer_separation": ~col("apart") | tests_answered(cut("自测题")),
        "fill_in_answer_template": ~template.rlike(BLANKS),
    }
    return told.withColumn("failed", codes(faulty)).select(*kept, "failed")


def residue(text: Column) -> Column:
    """What a generator left in English; plain searches come before the pattern."""
    return holds(text, ("Seeded from", "Paper", "unspecified", "Common Pitfalls")) & text.rlike(ANY + RESIDUE)


def report_codes(text: Column) -> Column:
    """The two checks of an analysis report that fail."""
    return codes({"markdown_tables": broken_tables(text) != "", "chinese_user_facing": residue(text)})


# --------------------------------------------------------------------------
# mechanical gates of a preparation pack

# Phrases that are no teaching, citations, routes.
# Patterns with branches look at the character that each may begin with first: whole texts are searched, and nearly all places fail there.
PLACEHOLDER = r"(?imd)(?=[{T待|])(?:\{\{[^}]+\}\}|TODO|TBD|待 AI|待整理|^\|\s*\|\s*\|)"
MACHINE_REF = r"(?i)(?=[.p机])(?:(?<=[\w.-])\.json#[^\s,，;；)）\]}】、。]|paper-card|机器可读题目卡引用)"
BROKEN_PROSE = r"(?i)(?=[\\*\u4e00-\u9fff])(?:\\end\*\*Transfer|无\*\*Transfer|\*\*Answer\*\*：?\s*\$[^\n]{0,80}>\s*\*\*Check|验\*\*Transfer|\*\*(?:First look|Answer|Check|Transfer)\*\*[^\n]{0,2}\*\*(?:First look|Answer|Check|Transfer)\*\*)"
LOW_QUALITY = r"(?i)(?=[\u4e00-\u9fff])(?:答案以.*为准|调用对应方法卡|矩阵或公式|先圈出对象|不要急着代数展开|自测答案?以.*来源|同型变式通常只换|详见来源|见原题答案|复核时对照\s*paper-card|题目较长.*关键条件)"
UNIVERSAL = r"(?i)看到题干后先判入口|根据关键词确定本题属于本题型|使用本页核心方法中最匹配的一条|把题目给出的矩阵、向量或参数代入|按本页模板核算|同卷答案区核算"
GENERIC_ANSWER = r"(?is)答案\s*[：:].{0,80}(?:按本页模板|同卷答案区|核算最终数值|以来源为准|对照\s*paper-card|自行计算)"
HEADING_ONLY = r"(?i)(?:\*\*)?题目(?:\*\*)?\s*[：:]\s*(?:\n\s*){0,2}#{1,6}\s*[一二三四五六七八九十\d]+[.、．][^\n]{0,40}(?:题|分|共|简答|计算)"
RAW_DUMP = r"(?:\*\*)?题目(?:\*\*)?\s*[：:][^\n]{240,}(?:解\s*[：:]|答案\s*[：:]|\\\\begin\{array\})"
SELF_QUESTION = r"(?md)^#{1,6}\s*\d+(?:\.\d+)*\s*为什么"
GROUNDING = r"(?=[\u4e00-\u9fff])(?:课本|教材|讲义).{0,24}(?:§\s*\d+(?:\.\d+)+|图\s*\d+(?:\.\d+)+|题图\s*\d+(?:\.\d+)+|第\s*\d+\s*章)"
OVERBROAD = r"(?=[\u4e00-\u9fff])(?:课本|教材|讲义).{0,16}§\s*\d+(?:\.\d+)?(?:\s|[，,、。；;]|$)"
FULL_PROBLEM = r"(?:\*\*)?题目(?:\*\*)?\s*[：:]"
WEAK_PROBLEM = r"题目摘录\s*[：:]|题目摘要\s*[：:]|题目\s*[：:].{0,30}(?:往年题|自测)\s*\d+"
SOLUTION_STEP = r"完整解析|解析|第\s*\d+\s*步|先判|再写|代入|验算|检查"
ANSWER = r"(?md)自测.*答案|(?:\*\*)?答案(?:\*\*)?\s*[：:]"
QUESTION_REF = r"第?\s*[一二三四五六七八九十\d]+\s*题|Q\d+|一、|二、|三、|四、|五、|六、|七、"
HUMAN_SOURCE = r"(?:\d{4}\s*[-—]\s*\d{4}|20\d{2}|19\d{2}).{0,24}(?:学期|期中|期末|真题|试卷|卷).{0,24}(?:[一二三四五六七八九十]+[.、．]?\d*|第\s*\d+\s*题|\d+\s*[.、．])"
FABRICATED = r"(?=[\u4e00-\u9fff])(?:自编题|模拟题|改编题|原创题)"
CITED = r"来源\s*(?:\*\*)?\s*[：:]"
LABEL = r"(?:\*\*)?来源(?:\*\*)?\s*[：:]\s*([^\n。；;]+)"
BLOCKS = {
    "考前速记": ("考前速记", "速查", "30 秒", "30秒"), "符号": ("符号",), "核心概念": ("核心概念", "必要概念", "基础知识"), "核心方法": ("核心方法", "操作步骤", "方法选择"),
    "例题": ("例题", "真题例解"), "自测": ("自测",), "快速得分": ("快速得分", "抢分", "步骤分"), "易错": ("易错",), "来源": ("来源",),
}
PARTS = {"例题": ("例题", "真题例解"), "自测题": ("自测题", "真题自测"), "自测答案": ("自测答案", "答案与解析", "答案与验算")}
LATER = ("快速得分", "易错点", "来源校对")
STANDARD = ["目标读者", "没听过课", "没做过作业", "短时间速成", "完整题目", "完整解析", "课本", "往年卷", "例题", "自测", "样板"]
ROUTE = ["我现在", "先读", "先看", "第一步", "从这里开始", "1 小时", "1天", "1 天", "3天", "3 天", "P0", "P1"]
CROSS_PAPER = ["跨卷关系", "原题复现", "同型变式", "相似题", "复习优先级"]


def page_type(text: Column) -> Column:
    return F.btrim(F.btrim(F.regexp_extract(text, r"(?md)^type:\s*(.+)$", 1)), F.lit("\"'"))


def page_field(text: Column, name: str) -> Column:
    return F.btrim(F.btrim(F.regexp_extract(text, rf"(?md)^{name}:\s*(.+)$", 1)), F.lit("\"'"))


def loose_inline(text: Column) -> Column:
    """A formula with white space inside its dollars, whatever it holds."""
    rows = F.split(F.replace(F.replace(text, F.lit("\\$"), F.lit("")), F.lit("$$"), F.lit("")), "\n")

    def loose(line: Column) -> Column:
        parts = F.split(line, r"\$")
        return F.exists(F.filter(parts, lambda p, i: (i % 2 == 1) & (i + 1 < F.size(parts))), lambda p: p.rlike(r"(?U)\A\s|\s\z"))

    return F.exists(rows, loose)


def markdown_rules(text: Column, kind: str | None = None, for_people: bool = False) -> dict[str, Column]:
    """Rules of any page of a pack."""
    rules = {"frontmatter-type": page_type(text) != kind} if kind else {}
    rules["placeholder-content"] = text.rlike(PLACEHOLDER)
    if for_people:
        rules |= {"human-markdown-machine-ref-leak": text.rlike(MACHINE_REF), "human-markdown-broken-prose-join": text.rlike(BROKEN_PROSE)}
    displayed = F.contains(text, F.lit("$$")) & F.exists(F.transform(F.split(text, "\n"), lambda v: F.btrim(v)), lambda x: x.contains("$$") & (x != "$$"))
    return rules | {"markdown-table": broken_tables(text) != "", "render-risk": displayed | (F.contains(text, F.lit("$")) & loose_inline(text))}


def human_sources(text: Column) -> Column:
    """Readable sources of a part, without white space and closing marks."""
    labels = F.transform(F.regexp_extract_all(text, F.lit(LABEL), F.lit(1)), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", ""), F.lit(" ，,。；;、")))
    return F.filter(labels, lambda x: x != "")


def _long_blocks(text: Column, pattern: str) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.filter(found, lambda x: F.char_length(x) >= 60)


def repeated(blocks: Column) -> Column:
    return F.size(F.array_distinct(blocks)) < F.size(blocks)


def insufficient(text: Column) -> Column:
    return holds(text, ("证据不足", "需人工补充", "needs-review"))


def _type_page_rules(text: Column, cut: Callable[[str], Column], known_types: Column) -> dict[str, Column]:
    """The 33 page codes, of a page and what ``cut`` names of it; most need a type with a dossier, without which only the first are told."""
    shown, tests, given, kind, of_shown, of_tests, generic = map(cut, ("shown", "tests", "given", "kind", "of_shown", "of_tests", "generic"))
    known = (kind != "") & F.array_contains(known_types, kind)
    few, grounded = cut("few"), cut("grounded")
    first = {
        "type-analysis-missing-block": any_of(~holds(text, names) for names in BLOCKS.values()),
        "type-analysis-missing-source-question": ~text.rlike(CITED) | ~(text.rlike(QUESTION_REF) | text.rlike(HUMAN_SOURCE)),
        "type-analysis-fabricated-question": text.rlike(FABRICATED),
        "type-analysis-missing-type-id": kind == "",
        "type-analysis-missing-dossier": (kind != "") & ~known,
    }
    rest = {
        "type-analysis-missing-worked-example-source": F.size(of_shown) == 0,
        "type-analysis-missing-self-test-source": F.size(of_tests) == 0,
        "type-analysis-duplicate-worked-example": repeated(of_shown),
        "type-analysis-duplicate-self-test": repeated(of_tests),
        "type-analysis-example-selftest-overlap": F.arrays_overlap(of_shown, of_tests),
        "type-analysis-too-few-worked-examples": few & (F.size(F.array_distinct(of_shown)) < 5),
        "type-analysis-too-few-self-tests": few & (F.size(F.array_distinct(of_tests)) < 4),
        "type-analysis-worked-example-too-thin": ~holds(shown, ["看到"]) | ~holds(shown, ["方法引用"]) | ~holds(shown, ["易错"]) | ~holds(shown, ["验算", "检查", "代回", "一致", "合理性"]),
        "type-analysis-worked-example-missing-transfer": ~holds(shown, ["变式", "举一反三", "训练目标"]),
        "type-analysis-self-test-missing-hint": ~holds(tests, ["提示"]),
        "type-analysis-self-test-missing-method-link": ~holds(tests, ["方法", "变式", "训练目标"]),
        "type-analysis-missing-self-test-answers": given == "",
        "type-analysis-low-quality-phrase": text.rlike(LOW_QUALITY),
        "type-analysis-self-question-heading": text.rlike(SELF_QUESTION),
        "type-analysis-missing-textbook-grounding": ~grounded,
        "type-analysis-overbroad-textbook-ref": text.rlike(OVERBROAD) & ~grounded,
        "type-analysis-missing-action-template": ~holds(text, ["2 分钟", "下笔模板", "先手"]),
        "type-analysis-template-worked-solution": shown.rlike(UNIVERSAL),
        "type-analysis-template-self-test-answer": generic > 0,
        "type-analysis-repeated-self-test-answer": ((generic > 0) & ((generic > 1) | (F.regexp_count(given, F.lit("按本页模板")) > 1))) | repeated(_long_blocks(given, r"(?s)答案\s*[：:]\s*(.+?)(?=\n\s*(?:###|##)|\z)")),
        "type-analysis-heading-only-problem": shown.rlike(HEADING_ONLY) | tests.rlike(HEADING_ONLY),
        "type-analysis-raw-ocr-dump": shown.rlike(RAW_DUMP) | tests.rlike(RAW_DUMP),
        "type-analysis-repeated-worked-solution": repeated(_long_blocks(shown, r"(?s)完整解析\s*[：:]\s*(.+?)(?=\n\s*(?:验算|举一反三|易错|###|##)|\z)")),
        "type-analysis-missing-full-worked-problem": ~shown.rlike(FULL_PROBLEM) | shown.rlike(WEAK_PROBLEM),
        "type-analysis-missing-full-self-test-problem": ~tests.rlike(FULL_PROBLEM) | tests.rlike(WEAK_PROBLEM),
        "type-analysis-missing-full-solution": ~shown.rlike(SOLUTION_STEP),
        "type-analysis-missing-self-test-answer-content": ~given.rlike(ANSWER),
        "type-analysis-missing-action-sentence-style": ~holds(text, ["动作", "先判", "再列"]),
    }
    return first | {code: known & test for code, test in rest.items()}


def with_type_page(df: DataFrame, text_col: str, known_types: Column, grounded_types: Column) -> DataFrame:
    """``df`` with ``codes``, the page codes of a type page.

    The parts of a page are cut once, as columns of their own, and so is what several rules
    ask of them; a page is one row all the time, and nothing is worked out for rows to leave out.
    """
    text, kept = F.col(text_col), df.columns
    cut = lambda name: F.col(f"_{name}")
    part = lambda name, stops: outline_section(text, PARTS[name], stops)
    df = df.withColumns({
        "_shown": part("例题", PARTS["自测题"] + PARTS["自测答案"] + LATER), "_tests": part("自测题", PARTS["自测答案"] + LATER), "_given": part("自测答案", LATER), "_kind": page_field(text, "exam_type_id"),
        "_few": (page_field(text, "quality") != "needs-review") & ~insufficient(text),
    })
    df = df.withColumns({
        "_of_shown": human_sources(cut("shown")), "_of_tests": human_sources(cut("tests")), "_generic": F.regexp_count(cut("given"), F.lit(GENERIC_ANSWER)),
        "_grounded": text.rlike(GROUNDING) | F.array_contains(grounded_types, cut("kind")),
    })
    found = codes(markdown_rules(text, "exam-type-analysis", True) | _type_page_rules(text, cut, known_types))
    return df.withColumn("codes", found).select(*kept, "codes")


def standard_codes(text: Column) -> Column:
    missing = any_of(~F.contains(text, F.lit(m)) for m in STANDARD)
    return codes(markdown_rules(text, "exam-prep-quality-standard") | {"quality-standard-missing-rule": missing})


def guide_codes(text: Column) -> Column:
    listed = holds(text, ["文件", "统计", "产物"]) & ~holds(text, ["先读", "第一步", "从这里开始"])
    return codes(markdown_rules(text, "exam-prep-guide") | {"guide-missing-start-route": ~holds(text, ROUTE), "guide-artifact-list-only": listed})


def analysis_codes(text: Column, has_cards: Column) -> Column:
    claims = holds(text, ["原题", "重复", "相似", "变式"]) & ~text.rlike(CITED)
    return codes(markdown_rules(text, "exam-prep-analysis", True) | {"analysis-missing-human-source-ref": has_cards & ~text.rlike(HUMAN_SOURCE), "analysis-repeat-claim-missing-source": claims})


def deep_dive_codes(text: Column, final: Column) -> Column:
    thin = any_of(~F.contains(text, F.lit(m)) for m in ["题号", "来源", "考点", "解法", "疑点"])
    return codes(markdown_rules(text, "exam-paper-deep-dive", True) | {"gold-sample-paper-too-thin": thin, "paper-deep-dive-missing-cross-paper-backfill": final & ~holds(text, CROSS_PAPER)})


def scope_codes(scope: Column, name: Column, text: Column) -> Column:
    """Names of a final examination in the pack of a midterm."""
    midterm = F.contains(scope, F.lit("期中"))
    old_file = name.isin("期末公式总卡.md", "期末答题模板速查.md", "期末考试备考指南.md")
    return codes({"scope-naming-residue": midterm & (old_file | holds(text, ["期末公式总卡", "期末答题模板", "期末考试备考指南"]))})


# The four files of a pack, what they link to and hold.
PACK = {
    "备考指南.md": ("exam-prep-guide", ["题型解析/", "公式总卡.md", "答题模板速查.md", "考前1小时清单.md"], ["怎么使用这套资料", "题型优先级", "复习时间分配"]),
    "公式总卡.md": ("formula-cheat-sheet", ["题型解析/"], ["高频公式速查"]),
    "答题模板速查.md": ("answer-template-quickref", ["题型解析/"], ["标准答题模板"]),
    "考前1小时清单.md": ("pre-exam-one-hour-checklist", ["备考指南.md", "公式总卡.md", "答题模板速查.md", "题型解析/"], []),
}
SLOTS = ["60-45", "45-30", "30-15", "15-5", "5-0"]


def _filled_table(text: Column) -> Column:
    """A row with something in a cell, below a header and a separator."""
    return text.rlike(r"(?md)^[ \t]*\|[^\n]*\n[ \t]*\|(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*\n(?:[ \t]*\|[^\n]*\n)*?[ \t]*\|(?=[^\n]*[^|\s])")


def pack_codes(name: Column, text: Column) -> Column:
    """``kind``, ``link``, ``section`` and other faults of one file of a pack."""
    linked = F.concat(F.replace(text, F.lit("\\"), F.lit("/")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda t: X.decoded(t)), " "))
    rules: dict[str, Column] = {}
    for file, (kind, links, heads) in PACK.items():
        own = name == file
        rules[f"{file}:type"] = own & (page_type(text) != kind)
        rules |= {f"{file}:link {x}": own & ~F.contains(linked, F.lit(x)) for x in links}
        rules |= {f"{file}:section {x}": own & ~text.rlike(rf"{ANY}^#{{1,6}}\s+{re.escape(x)}\b") for x in heads}
    formulas, templates = section(text, "高频公式速查"), section(text, "标准答题模板")
    rules |= {
        "公式总卡.md:rows": (name == "公式总卡.md") & ~_filled_table(F.coalesce(F.nullif(formulas, F.lit("")), text)),
        "公式总卡.md:source": (name == "公式总卡.md") & ~F.contains(text, F.lit("来源")) & ~F.contains(linked, F.lit("题型解析/")),
        "答题模板速查.md:blanks": (name == "答题模板速查.md") & ~templates.rlike(r"\[(?:条件|表达式|值|答案|结论|中间量|步骤[0-9一二三四五六七八九十]*|占位符)\]"),
        "考前1小时清单.md:slots": (name == "考前1小时清单.md") & any_of(~F.contains(text, F.lit(s)) for s in SLOTS),
        "考前1小时清单.md:items": (name == "考前1小时清单.md") & ~text.rlike(r"(?md)^-\s*\[[ xX]\][ \t]+\S+"),
    }
    return codes(rules)


def guide_links_type(text: Column, type_id: str, page: str) -> Column:
    """A link to the page of a type: by the page's name, or by the type's id below the folder of type pages."""
    targets = F.transform(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda t: F.replace(X.decoded(F.btrim(t)), F.lit("\\"), F.lit("/")))
    named = lambda t: F.contains(t, F.lit(page)) | (F.contains(t, F.lit("题型解析/")) & (F.contains(t, F.lit(type_id)) | F.contains(t, F.lit(type_id.replace("_", "-")))))
    return F.exists(targets, named)
