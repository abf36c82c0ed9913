"""Functions and operators on small fixtures."""

import io
import re
import zipfile

from pyspark.sql import functions as F

from lorefield.functions import text as X
from lorefield.functions import unicode as U
from lorefield.operators import census as C
from lorefield.operators import diffing as D
from lorefield.operators import privacy as P
from lorefield.operators import repair as R
from lorefield.operators import risks
from lorefield.sources import office


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def test_front_matter_last_key_wins_and_quotes_go(spark):
    text = "\ufeff---\r\na: 1\r\n  nested: no\r\nb: 'two' # note\r\na: 3\r\n---\r\nbody"
    assert one(spark, text, X.front_matter_map) == {"a": "3", "b": "two"}
    assert one(spark, "no block", X.front_matter) is None
    assert one(spark, None, X.front_matter) is None


def test_iso_dates(spark):
    for raw, want in (("2026-07-04", "2026-07-04"), ("20260704", "2026-07-04"), ("2026-13-40", None), ("soon", None), ("", None)):
        got = one(spark, raw, X.iso_date)
        assert (str(got) if got else None) == want


def test_percent_rounds_half_to_even(spark):
    assert one(spark, 0.125, X.percent, "double") == "12%"
    assert one(spark, 0.135, X.percent, "double") in ("13%", "14%")


def test_slugs(spark):
    assert one(spark, "  Été & More! ", X.slug) == "t-more"
    assert one(spark, "ＡＢ Été 线性", lambda x: U.slugify(x)) == "ab-été-线性"
    assert one(spark, "\\u00e9", lambda x: U.decode_escapes(x)) == "é"


def test_counts_and_confidence(spark):
    rows = spark.createDataFrame([({},), ({"c": None},), ({"c": " "},), ({"c": "LOW"},), ({"c": "2.0"},), ({"c": "3"},)], "m map<string,string>")
    present = F.map_contains_key("m", F.lit("c"))
    value = F.try_element_at("m", F.lit("c"))
    got = rows.select(C.question_count(present, value), C.confidence(present, value)).collect()
    assert [r[0] for r in got] == [1, 0, 0, 0, 0, 3]
    assert [r[1] for r in got] == ["high", "invalid", "invalid", "low", "invalid", "invalid"]


def test_redaction_order_and_gate(spark):
    text = "call 415-555-0100 or a.b@c.org; token: abc; see D:\\vault\\x and 10.0.0.7 at db.corp"
    clean = one(spark, text, P.redact)
    assert "415" not in clean and "[REDACTED_PHONE]" in clean
    assert one(spark, text, P.gate) == "hold"
    assert one(spark, "plain words", P.gate) == "allow"
    assert one(spark, "plain words", P.warnings) == []


def test_repair(spark):
    text = "#Broken heading\nPage 1\n-  Bullet\n## Next section ........ 4\n\n\n\nend"
    assert one(spark, text, R.repair) == "# Broken heading\n\n- Bullet\n## Next section\n\nend"
    assert one(spark, "---\nba: 1\na: 2\na: 3\n---\na: 4", lambda x: R.set_field(x, "a", F.lit("9"))) == "---\nba: 1\na: 9\na: 3\n---\na: 4"
    assert one(spark, "---\nba: 1\na: 2\n---\na: 4", lambda x: R.drop_field(x, "a")) == "---\nba: 1\n---\na: 4"
    assert one(spark, "nothing", lambda x: R.set_field(x, "a", F.lit("9"))) == "nothing"


def test_seventeen_bad_lines_are_counted_and_eight_sampled(spark):
    doc = spark.createDataFrame([(1, "a.md", "\n".join(["$x"] * 17))], "doc_id int, path string, md string")
    found = risks.records(risks.detect(doc)).where("code = 'math-dollar-odd-line'").first()
    assert (found["count"], len(found["sample"]), found["truncated"]) == (17, 8, True)


def test_redaction_equals_plain_substitutions(spark):
    """The guarded chain against Python's own, over documents and over awkward texts."""
    plain = [(re.compile(re.sub(r"\(\?([imu]*)U([imu]*)\)", lambda m: f"(?{m[1]}{m[2]})" if m[1] + m[2] else "", p).replace("(?iu)", "(?i)")), n) for p, n, _ in P.REDACTIONS]
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["call 415-555-0100 at /home/me/x\u00a0.env TOKEN=abc", "C:\\vault\\x eyJa.b.c sk-" + "a" * 24, "a@b.co 10.1.2.3 x.corp /vault/y", "token: 'x' and 13912345678", "PASSWORD = \"q\"", "é.env.local: 1"]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, text string")
    got = {r.i: r.clean for r in rows.select("i", P.redact(F.col("text")).alias("clean")).collect()}
    for i, text in enumerate(texts):
        for pattern, name in plain:
            text = pattern.sub(f"[REDACTED_{name}]", text)
        assert got[i] == text


def test_regions_and_plans_move_nothing(spark):
    """Lines and their page markers stay in their rows; redaction is one narrow pass."""
    from lorefield.plans import registry

    for name in ("join_page_asof", "pii_redact", "qc_structural", "fix_repair_text"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


def test_bad_pdf_is_told_and_read_on(spark):
    from lorefield.sources.pdf import make_pdf, pdf_pages

    files = spark.createDataFrame([("a.pdf", bytearray(make_pdf("T", [["one", "two (2)"], ["drei é"]]))), ("b.pdf", bytearray(b"nothing")), ("c.pdf", bytearray(make_pdf("empty", [])))], "path string, content binary")
    got = {(r.path, r.page): r for r in pdf_pages(files).collect()}
    assert (got["a.pdf", 1].text, got["a.pdf", 2].text, got["a.pdf", 1].pages, got["a.pdf", 1].title) == ("one\ntwo (2)", "drei é", 2, "T")
    assert got["b.pdf", None].error and ("c.pdf", 1) not in got


def test_census_anchor(spark):
    rows = [("A", "matrix-rank"), ("A", "eigen-decomp"), ("B", "matrix-rank"), ("B", "gaussian-elim"), ("C", "matrix-rank"), ("C", "eigen-decomp")]
    got = C.type_frequency(spark.createDataFrame([(*r, 1) for r in rows], "p string, t string, n int"), "p", "t", "n").orderBy("rank_no").collect()
    assert [r.type_id for r in got[:2]] == ["matrix-rank", "eigen-decomp"]
    assert (got[0].paper_count, got[0].must_know) == (3, True)


def test_cascade_reports_ambiguous_and_taken(spark):
    papers = spark.createDataFrame([("p1", 1, "a", "k"), ("p2", 2, "b", "k"), ("p3", 3, "z", None)], "paper string, seq int, path string, alias string")
    notes = spark.createDataFrame([("n1", "a", None), ("n2", None, "k"), ("n3", None, "k")], "note string, src string, name string")
    got = {r.paper: (r.state, r.note) for r in C.bind_cascade(papers, notes, [("path", "src"), ("alias", "name")]).collect()}
    assert got == {"p1": ("bound", "n1"), "p2": ("ambiguous", None), "p3": ("missing", None)}


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>Hello</a:t></a:r></a:p></p:txBody><p:txBody><a:p><a:r><a:t>Body</a:t></a:r></a:p></p:txBody></p:sld>'
    sheet = '<worksheet><sheetData>' + "".join(f'<row><c r="A{i}"><v>{i}</v></c><c r="C{i}"><f>A{i}+1</f></c></row>' for i in range(1, 20)) + "</sheetData></worksheet>"
    (tmp_path / "a.docx").write_bytes(_zip({"word/document.xml": doc}))
    (tmp_path / "b.pptx").write_bytes(_zip({"ppt/slides/slide1.xml": slide}))
    (tmp_path / "c.xlsx").write_bytes(_zip({"xl/workbook.xml": '<workbook><sheets><sheet name="One"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet}))
    (tmp_path / "d.docx").write_bytes(b"no archive")
    got = {r.path.rpartition("/")[2]: r for r in office.read_office(spark, str(tmp_path)).collect()}
    assert got["a.docx"].md == "# Title\n\n| a\\|b | c |\n| --- | --- |"
    assert got["b.pptx"].md == "## Slide 1: Hello\n\nBody"
    assert len(re.findall("\n", got["c.xlsx"].md)) == 2 + office.SHEET_ROWS and "=A1+1" in got["c.xlsx"].md
    assert got["d.docx"].md is None and got["d.docx"].error


def test_streaming_counts(spark, tmp_path):
    from lorefield.streaming.events import event_stream, windowed_counts

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    query = windowed_counts(event_stream(spark, str(tmp_path / "in"), source.schema)).writeStream.outputMode("complete").format("memory").queryName("lorefield_counts").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(n) from lorefield_counts").first()[0] == source.count()


#: Papers, annotations with their sources, and what binds to what, worked out by hand.
PAPERS = [
    (1, "2019-a", "papers/2019-a.pdf.md", "annotations/2019-a.json"), (2, "2020-b", "papers/2020-b.pdf.md", None), (3, "2021-c", "papers/2021-c.pdf.md", "annotations/sub/2021-c.json"), (4, "2022-d", "papers/2022-d.pdf.md", None),
    (5, "2023-e", "./papers/2023-e.pdf.md", None), (6, "2024-f", "papers/x/2024-f.pdf.md", None), (7, "2025-g", "papers/2025-g.pdf.md", None), (8, "dup", "papers/p1/dup.pdf.md", None), (9, "dup2", "papers/p2/dup.pdf.md", None), (10, "none", "papers/none.pdf.md", None),
    (11, "again", "papers/again.pdf.md", "annotations/2019-a.json"), (12, "late", "papers/2023-e.pdf.md", None),
]
NOTES = [
    ("annotations/2019-a.json", "papers/2019-a.pdf.md"), ("annotations/old/2020-b.json", ""), ("annotations/2021-c.json", ""), ("annotations/2022-d.pdf.md.json", ""), ("annotations/e-note.json", "papers/2023-e.pdf.md"), ("annotations/f-note.json", "x/2024-f.pdf.md"),
    ("annotations/u/2025-g.json", ""), ("annotations/v/2025-g.json", ""), ("annotations/loose.json", "dup.pdf.md"),
]
BOUND = [
    ("2019-a", "annotations/2019-a.json", 1, None), ("2020-b", "annotations/old/2020-b.json", 2, None), ("2021-c", "annotations/2021-c.json", 2, None), ("2022-d", "annotations/2022-d.pdf.md.json", 3, None), ("2023-e", "annotations/e-note.json", 4, None), ("2024-f", "annotations/f-note.json", 5, None),
    ("2025-g", None, 2, "ambiguous_preferred_annotation"), ("dup", None, 5, "ambiguous_source_fallback"), ("dup2", None, 5, "ambiguous_source_fallback"), ("again", None, 1, "annotation_already_bound"),
]


def test_cascade_of_papers_by_hand(spark):
    from lorefield.operators import records as R

    got = R.bind(spark.createDataFrame(PAPERS, "seq int, stem string, path string, annotation string"), spark.createDataFrame(NOTES, "file string, source string"))
    assert sorted(map(tuple, got.collect())) == sorted(BOUND)


def test_bindings_free_each_other_along_a_chain(spark):
    """Paper k could have notes k and k + 1; each binding leaves the next paper one."""
    from lorefield.operators import records as R

    papers = [(0, "s0", "x/0.md", "n/0.json")] + [(k, f"s{k}", f"x/{k}.md", None) for k in range(1, 6)]
    notes = [("n/0.json", "x/1.md")] + [(f"n/{k}{side}.json", f"x/{k}.md") for k in range(1, 6) for side in "ab"]
    papers[1] = (1, "s1", "x/1.md", "n/1a.json")
    papers += [(10 + k, f"t{k}", "", f"n/{k}a.json") for k in range(2, 4)]
    got = {r.stem: (r.file, r.error) for r in R.bind(spark.createDataFrame(papers, "seq int, stem string, path string, annotation string"), spark.createDataFrame(notes, "file string, source string")).collect()}
    assert got["s0"] == ("n/0.json", None) and got["s1"] == ("n/1a.json", None) and got["t2"] == ("n/2a.json", None)
    assert got["s2"] == (None, "ambiguous_annotation_fallback")  # the paper that takes one of its two files comes later


def test_blocking_lines_are_all_counted(spark):
    from lorefield.operators import risks as R
    from lorefield.plans.risks import blocking_lines

    docs = spark.createDataFrame([(1, "a.md", "$ x = 1 $\n" * 20), (2, "b.md", "$ x = 1 $\n" * 3), (3, "c.md", "plain\n")], "doc_id int, path string, md string")
    assert sorted(tuple(r) for r in blocking_lines(R.detect(docs), docs).collect()) == [(1, 20, 20), (2, 3, 3)]


def test_reports_that_fail_are_to_revise(spark):
    from lorefield.plans import registry

    n = {(r.kind, r.needs_revision): r.n for r in registry.queries()["agg_review_totals"](spark, "/root/testdata/sf0.001").collect()}
    assert n["analysis-report", True] > 0 and n["analysis-report", False] > 0
