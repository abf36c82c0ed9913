"""Work that is done once, and memory that follows no batch's size."""

import re

import pytest
from pyspark.sql import functions as F

from lorefield.functions.python import per_value
from lorefield.operators import mathscan
from lorefield.operators import pages as G
from lorefield.plans import registry

SF = "/root/testdata/sf0.001"


def _plan(spark, name: str, kind: str = "optimizedPlan") -> str:
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return getattr(registry.queries()[name](spark, SF)._jdf.queryExecution(), kind)().toString()


def test_page_codes_are_worked_out_once(spark):
    assert _plan(spark, "qc_type_page").count("待整理") == 1


def test_parts_of_a_page_are_cut_once(spark):
    # five levels of headings, of which four stand in a test for an empty match as well
    assert _plan(spark, "qc_type_page").count("(?:例题|真题例解)") <= 10


@pytest.mark.parametrize("text, found", [
    ("x tbd", "PLACEHOLDER"), ("{{a}}", "PLACEHOLDER"), ("a\n| | |", "PLACEHOLDER"), ("待整理", "PLACEHOLDER"), ("a | | |", ""), ("see A.JSON#q1", "MACHINE_REF"), (" .json#q1", ""), ("a.json# q1", ""), ("Paper-Card", "MACHINE_REF"),
    ("无**Transfer", "BROKEN_PROSE"), ("\\end**transfer", "BROKEN_PROSE"), ("**Answer****Check**", "BROKEN_PROSE"), ("答案以书为准", "LOW_QUALITY"), ("自测答案以来源", "LOW_QUALITY"), ("见讲义第 3 章", "GROUNDING"), ("改编题", "FABRICATED"), ("plain prose, todos aside", "PLACEHOLDER"), ("plain prose", ""),
])
def test_page_patterns(spark, text, found):
    names = ["PLACEHOLDER", "MACHINE_REF", "BROKEN_PROSE", "LOW_QUALITY", "GROUNDING", "FABRICATED"]
    row = spark.range(1).select(*(F.lit(text).rlike(getattr(G, n)).alias(n) for n in names)).first()
    assert ",".join(n for n in names if row[n]) == found


@pytest.mark.parametrize("name", ["agg_merge_risks", "agg_blocking", "out_compact_check"])
def test_texts_are_scanned_once(spark, name):
    assert len(re.findall("MapInArrow", _plan(spark, name))) == 1


def test_lines_without_signs_meet_no_test(monkeypatch):
    met = []
    monkeypatch.setattr(mathscan, "BARE_LINE", {"x": met.append})
    assert list(mathscan.text_risks("plain `code`\n" * 50 + "�\nprice $5\n\\left(\n")) == [("latex-left-right-unbalanced", None)]
    assert met == ["�", "price $5", "\\left("]


def test_scan_sees_fences_and_code_as_before():
    text = "~~~\n$ x = 1 $\n~~~\n`$ y = 1 $`\n$ z = 1 $\n```\n$\n```\n\\$ $\n"
    assert list(mathscan.text_risks(text)) == [("math-dollar-odd-line", 3), ("inline-math-delimiter-space", 5)]


def test_front_matter_is_cut_once(spark):
    from lorefield.functions import text as X

    plan = spark.createDataFrame([("---\na: 1\n---\n",)], "md string").select(X.front_matter_map(F.col("md")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 1


def test_values_meet_small_batches(spark):
    def own_mb(x):
        with open("/proc/self/smaps_rollup") as f:
            return str(int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) >> 10)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
    rows = spark.range(0, 256, 1, 1).select(F.repeat(F.lit("a"), 1 << 20).alias("x")).select(per_value(own_mb)("x").alias("mb"))
    got = [int(r.mb) for r in rows.collect()]
    assert len(got) == 256 and max(got) < 150


def test_markers_are_found_once(spark):
    from lorefield.operators.proposals import markers

    df = spark.createDataFrame([("<!-- a: 1 -->\n<!-- b: 2 -->\n<!-- a: 3 -->",), ("none",)], "text string").select(markers(F.col("text")).alias("m"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 2
    assert [r.m for r in df.collect()] == [{"a": "3", "b": "2"}, {}]


def test_what_follows_a_marker_is_cut_once(spark):
    df = spark.createDataFrame([("题目 # 答案：[前](x) 两列 {{y}}",), ("答案：[前](x) 两列 | 无关组",), ("none",)], "text string").select(G.has_substance(G.after(F.col("text"), "答案：", 50), 8).alias("told"))
    assert df._jdf.queryExecution().analyzed().toString().count("答案：") == 3  # whether it is there, what stands before, its length
    assert [r.told for r in df.collect()] == [False, True, None]


def test_sections_by_heading_and_anywhere(spark):
    text = "x 秩 y\nabove\n## 一\nin 秩\nmore\n### 秩的\nown\n#### low\nbelow\n### next\nout\n## 秩"
    rows = spark.createDataFrame([(text,), ("## a\n秩",), ("none",), ("# 秩\n# b",)], "text string").select(*(G.section(F.col("text"), "秩", anywhere).alias(f"a{anywhere:d}") for anywhere in (False, True)))
    assert [tuple(r) for r in rows.collect()] == [("own\n#### low\nbelow\n", "above\n"), ("", ""), ("", ""), ("", "")]


def test_texts_of_a_review_stay_where_they_are(spark):
    import random

    from lorefield.operators import proposals as Q

    rnd = random.Random(1)
    texts = [f"---\nsource_file: a.pdf\n---\n\n1. first\n\n{rnd.randbytes(20000).hex()}\n" for _ in range(64)]
    made = spark.createDataFrame([(k, "<!-- case-json: none -->", f"/vault/{k}.md", t + "more\n", None) for k, t in enumerate(texts)], "id long, text string, target string, replacement string, spans string")
    files = spark.createDataFrame([(f"/vault/{k}.md", t, "0") for k, t in enumerate(texts)], "path string, text string, digest string")
    cases = spark.createDataFrame([], "path string, payload string, case_sha256 string, evidence string, evidence_sha256 string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    found = {r.code for r in Q.review_proposals(made, cases, files).select("code").distinct().collect()}
    assert {"proposal-case-json-unavailable", "proposal-target-sha256-missing"} <= found and "question-number-missing" not in found
    assert written() - before < sum(map(len, texts)) // 10
