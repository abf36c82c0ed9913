"""Scalars, paths, lists, notes and look-ups over awkward inputs, with results worked out by hand."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import unicode as U
from ..functions.python import per_value
from ..operators import census as C
from ..operators import paths as P
from ..operators import repair
from ..operators import risks as R
from ..sources import taxonomy as T
from .cases import cases

# --------------------------------------------------------------------------
# strings


@cases("fn_safe_slug", [("Import drops A&B", "import-drops-a-b"), ("../x", "issue"), ("a/b", "issue"), ("a\\b", "issue"), ("", "issue"), ("  v1.2_beta ", "v1.2_beta"), ("--.x.--", "x"), ("中文", "issue"), ("a..b", "issue")])
def safe_slug(x):
    return X.safe_slug(x)


@cases("fn_slugify_unicode", [("Linear Algebra", "linear-algebra"), ("线性代数 (上)", "线性代数-上"), ("Ｆｕｌｌ　Width", "full-width"), ("Straße", "strasse"), ("é́x", "é́x"), ("--a--", "a"), ("२०२४ अंक", "२०२४-अंक"), ("!!", ""), ("", "")])
def slugify(x):
    return U.slugify(x)


@cases("fn_scope_key", [("期中", "期中"), ("Mid Term", "mid-term"), ("a/b", None), ("..", None), ("", None), ("c:", None), ("!!", None), ("a\\b", None)])
def scope_key(x):
    raw = F.btrim(x)
    bad = (raw == "") | raw.isin(".", "..") | raw.rlike(r"[/\\:]")
    return F.when(~bad, F.nullif(U.slugify(raw), F.lit("")))


@cases("fn_md_cell", [("a|b", "a\\|b"), ("a\\|b", "a\\|b"), ("$|A|$ x", "$\\lvert A\\rvert$ x"), ("det |A| and |λE-A|", "det $\\lvert A\\rvert$ and $\\lvert λE-A\\rvert$"), ("a\nb", "a b"), ("|x y|", "\\|x y\\|"), ("|1|", "\\|1\\|"), ("$|a+b|$|c", "$\\lvert a+b\\rvert$\\|c"), ("", "")])
def md_cell(x):
    return X.table_cell(x)


@cases("fn_yaml_scalar", [('"a # b" # c', "a # b"), ("plain # note", "plain"), ("a#b", "a#b"), ("'it", "it"), ("  x  ", "x"), ('""', ""), ("'a' rest", "a"), ("", "")])
def yaml_scalar(x):
    return X.yaml_scalar(x)


@cases("md_list", [
    ("simple", '[a, "b", \'c\', ]', "a|b|c"), ("simple", "a, b", ""), ("simple", "[]", ""), ("quoted", '["a, b", "c\\"d"]', 'a, b|c"d'), ("quoted", "[x, y]", "x|y"), ("quoted", '["a\\\\b"]', "a\\b"), ("strings", '["a", 2]', "a|2"), ("strings", '[a, "b, c"]', "a|b, c"), ("strings", "alone", "alone"), ("strings", "", ""), ("strings", "[]", ""),
])
def lists(kind, x):
    return F.array_join(F.when(kind == "simple", X.simple_list(x)).when(kind == "quoted", X.quoted_list(x)).otherwise(X.string_list(x)), "|")


@cases("fn_replace_section", [
    ("# T\n\n## Follow-up\nold\n\n## Next\nx\n", "new", "# T\n\n## Follow-up\n\nnew\n\n## Next\nx\n"), ("# T\n", "new", "# T\n\n## Follow-up\n\nnew\n"), ("", "new", "## Follow-up\n\nnew\n"), ("## Follow-up\na\n### b\nc", "new", "## Follow-up\n\nnew\n"), ("a\r\n## Follow-up\r\nb\r\n## N", "new", "a\n## Follow-up\n\nnew\n\n## N\n"), ("## Follow-ups\nx", "new", "## Follow-ups\nx\n\n## Follow-up\n\nnew\n"),
])
def section_replaced(md, content):
    return X.replace_section(md, "Follow-up", content)


@cases("fn_note_section", [("## Evidence\n a \n\n## B", "a"), ("## Evidence", ""), ("### Evidence\nx", ""), ("x\n  ## Evidence  \ny\n# z\nw", "y\n# z\nw"), ("## Evidence\r\na\r\n## B", "a")])
def evidence_section(md):
    return X.note_section(md, "Evidence")


@cases("fn_link_targets", [("[a](b%20c.md) [d](e+f)", "b c.md|e+f"), ("![i](x.png)", "x.png"), ("[](%E9%A2%98)", "题"), ("[a] (b)", ""), ("[a](b) text [c](d \"t\")", 'b|d "t"'), ("[a](100%)", "100%")])
def link_targets(md):
    return F.array_join(F.transform(F.regexp_extract_all(md, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda t: X.decoded(F.btrim(t))), "|")


@cases("fn_strip_code", [("a\n```py\nx\n```\nb", "a\nb"), ("a `b` ``c`d`` e", "a   e"), ("~~~\nx\n```\ny\n~~~\nz", "z"), ("```\nopen", ""), ("````\n```\n````\nq", "q"), ("`a\nb` c", " c"), ("no code", "no code")])
def no_code(md):
    return X.strip_code(md)


@cases("fn_split_sections", [("# a\nx\n## b\ny", "1-2:# a|3-4:## b"), ("x\n一、甲\ny\n(2) 乙", "2-3:一、甲|4-4:(2) 乙"), ("plain\ntext", ""), ("#### deep\n### c", "2-2:### c"), ("第3题 x\n3. y", "2-2:3. y"), ("1（10 分）求", "1-1:1（10 分）求")])
def sections(md):
    rows, starts = F.split(md, "\n"), R.section_starts(md)
    ends = F.transform(starts, lambda s, i: F.coalesce(F.get(starts, i + 1) - 1, F.size(rows)))
    shown = F.transform(starts, lambda s, i: F.concat(s.cast("string"), F.lit("-"), F.get(ends, i).cast("string"), F.lit(":"), F.substring(F.btrim(F.get(rows, s - 1)), 1, 120)))
    return F.array_join(F.slice(shown, 1, R.MAX_SECTIONS), "|")


@cases("fn_question_numbers", [("1. a\n二、b\n  ## 3）c", "1|二"), ("a 1. b", ""), ("10．x\n11) y", "10|11"), ("一.", "一"), ("", "")])
def question_numbers(md):
    return F.array_join(F.regexp_extract_all(md, F.lit(r"(?mdU)^\s*(?:#{1,3}\s*)?([一二三四五六七八九十]+|[0-9]+)[\.、．)]"), F.lit(1)), "|")


_LOG = "# Changes\n\n## [Unreleased]\n- x\n\n## [1.2.0] - 2026-01-02\n\n- new\n- more\n\n## [v1.1.0]\n- old\n## [1.0.0] - y\n\n"


@cases("fn_release_notes", [(_LOG, "1.2.0", "- new\n- more\n"), (_LOG, "v1.2.0", "- new\n- more\n"), (_LOG, "1.1.0", "- old\n"), (_LOG, "1.0.0", None), (_LOG, "9.9", None), (_LOG, "Unreleased", None), ("## [V2] - d\r\na\r\n", "2", "a\n")])
def notes_of_release(changelog, version):
    return X.release_notes(changelog, version)


@cases("fn_json_body", [('"just text"', "|just text"), ('{"body": "b", "title": "t"}', "t|b"), ('{"text": "x", "title": 3}', "|x"), ('{"body": 1, "text": "x"}', "|x"), ('{"title": "t"}', None), ("[1]", None), ("{", None), ('{"body": ""}', "|")])
def json_body(raw):
    return X.json_text(raw)


@cases("fn_eol_normalise", [("a\r\nb\rc\n", "a\nb\nc\n"), ("a\n", "a\n"), ("\r\r\n", "\n\n"), ("", "")])
def eol(x):
    return F.regexp_replace(x, r"\r\n?", "\n")


@cases("cls_eol", [("a\nb", "lf"), ("a\r\nb\r\n", "crlf"), ("a\rb", "cr"), ("a\r\nb\n", "mixed"), ("a\rb\n", "mixed"), ("abc", "lf"), ("", "lf"), ("\r\n\r", "mixed")])
def line_ends(x):
    crlf, lf, cr = (X.count_of(x, p) for p in (r"\r\n", r"(?<!\r)\n", r"\r(?!\n)"))
    kinds = sum(((n > 0).cast("int") for n in (lf, cr)), (crlf > 0).cast("int"))
    return F.when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(cr > 0, "cr").otherwise("lf")


@cases("fn_imported_body", [("---\na: 1\n---\n# T\n## Imported Content\nx\n", "\nx\n"), ("---\na: 1\n---\nbody", "body"), ("no front", "no front"), ("## Imported Content  \ny", "\ny"), ("## Imported Contents\ny", "## Imported Contents\ny")])
def imported_body(md):
    marked = F.split(md, r"(?md)^## Imported Content[ \t]*$", 2)
    return F.when(F.size(marked) > 1, F.element_at(marked, 2)).otherwise(X.body(md))


@cases("fm_week_plan", [("---\na: 1\nb: 'x: y'\nno colon\n---\nbody", "a=1;b='x: y'"), ("no", ""), ("---\nopen", ""), ("---\n a : \"q\"\n---\n", 'a="q"')])
def week_plan_front(md):
    block = F.get(F.split(md, "---\n", 3), F.lit(1))
    rows = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    shown = F.transform(rows, lambda x: F.concat(F.btrim(F.substring_index(x, ":", 1)), F.lit("="), F.btrim(F.get(F.split(x, ":", 2), F.lit(1)))))
    return F.when(md.startswith("---") & (F.size(F.split(md, "---\n", 3)) > 2), F.array_join(shown, ";")).otherwise("")


@cases("fm_feedback", [("---\nstatus: open\ntitle: a: b\n---\n\n\nbody\n", "status=open;title=a: b|body\n"), ("body", "|body"), ("---\nopen: 1\n", "|---\nopen: 1\n"), ("---\r\na: 1\r\n---\r\nx", "a=1|x")])
def feedback_front(md):
    text = F.replace(md, F.lit("\r\n"), F.lit("\n"))
    parts = F.split(text, "---\n", 3)
    rows = F.filter(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: x.contains(":"))
    shown = F.array_join(F.transform(rows, lambda x: F.concat(F.btrim(F.substring_index(x, ":", 1)), F.lit("="), F.btrim(F.get(F.split(x, ":", 2), F.lit(1))))), ";")
    whole = text.startswith("---\n") & (F.size(parts) > 2)
    return F.when(whole, F.concat(shown, F.lit("|"), F.regexp_replace(F.get(parts, F.lit(2)), r"\A\n+", ""))).otherwise(F.concat(F.lit("|"), text))


_TASK = "---\ntype: task\ncourse: \"Linear Algebra\"\nstatus: active\ntags: [task, \"exam\"]\n---\n# Midterm checkpoint\n\n- Due: 2026-07-14\n- Area: exam\n- priority: high\n- Course: ../courses/la/index.md\n"


@cases("proj_read_task", [
    (_TASK, "capture-x", "Midterm checkpoint|active|2026-07-14|exam|high|task,exam|Linear Algebra|../courses/la/index.md"), (_TASK.replace("2026-07-14", "20260714").replace("status: active\n", ""), "a", "Midterm checkpoint|active|2026-07-14|exam|high|task,exam|Linear Algebra|../courses/la/index.md"),
    ("no front\n- Due: soon\n", "overdue-reading-list", "Overdue Reading List|active||||||"), (_TASK.replace("# Midterm checkpoint\n", "").replace("tags: [task, \"exam\"]", "tags: task"), "archived-quiz", "Archived Quiz|active|2026-07-14|exam|high||Linear Algebra|../courses/la/index.md"),
])
def task(md, stem):
    front = lambda k: F.btrim(F.btrim(F.coalesce(F.regexp_extract(X.front_matter(md), rf"(?md)^{k}:(.*)$", 1), F.lit(""))), F.lit("\"'"))
    tags = F.coalesce(F.regexp_extract(X.front_matter(md), r"(?md)^tags:(.*)$", 1), F.lit(""))
    due = F.coalesce(X.iso_date(X.detail(md, "Due")).cast("string"), F.lit(""))
    status = F.coalesce(F.nullif(front("status"), F.lit("")), F.lit("active"))
    title = X.title(md, F.initcap(F.replace(stem, F.lit("-"), F.lit(" "))))
    return F.concat_ws("|", title, status, due, X.detail(md, "Area"), X.detail(md, "Priority"), F.array_join(X.simple_list(tags), ","), front("course"), X.detail(md, "Course"))


@cases("fm_sources", [('source_artifacts: ["a.md", "b.md"]', "a.md|b.md"), ("source_artifacts: [\"a\", 'b c']", "a|b c"), ("source_artifacts: [x, y]", "x|y"), ("source_artifacts: []", ""), ('source_summary: "3 papers"', "3 papers"), ("none", ""), ("source_summary: plain", "plain")])
def fm_sources(md):
    raw = F.regexp_extract(md, r"(?md)^source_artifacts:\s*(\[.*\])\s*$", 1)
    quoted = F.transform(F.regexp_extract_all(raw, F.lit(r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))
    found = F.coalesce(F.from_json(raw, "array<string>"), F.when(F.size(quoted) > 0, quoted).otherwise(X.simple_list(raw)))
    summary = F.regexp_extract(md, r'(?md)^source_summary:\s*"?(.*?)"?\s*$', 1)
    return F.when(raw != "", F.array_join(found, "|")).otherwise(summary)


# --------------------------------------------------------------------------
# paths and files


@cases("cls_hold_back_rules", [
    (".env", 1, "environment file"), ("a/.env.local", 1, "environment file"), (".envrc", 1, None), ("x.env", 1, "environment file"), ("a.sync-conflict-1.md", 1, "sync-conflict file"), ("work/.venv/lib/x.py", 1, "local virtual environment"), ("other/venv/lib/x.py", 1, None), ("p/env/pyvenv.cfg", 1, "local virtual environment"),
    ("tmp/a.md", 1, "temporary file"), ("a/Temp/b.md", 1, "temporary file"), ("NODE_MODULES/x.js", 1, "dependency cache"), ("a/__pycache__/b.pyc", 1, "generated cache"), (".obsidian/workspace.json", 1, "local workspace file"), ("x/.ds_store", 1, "local-only file"), ("a.ZIP", 1, "archive or disk image"), ("a.pdf", 1, "binary source document"),
    ("a.MP4", 1, "binary media asset"), ("a.sqlite", 1, "binary or local environment artifact"), ("a.log", 1, "log file"), ("notes.md", 10485761, "large file"), ("notes.md", 10485760, None), ("notes.pdf.md", 1, None),
])
def held_back(path, size):
    return P.hold_back(path, size, F.array(F.lit("work/.venv")))


@cases("cls_status_parse", [
    (" M notes/a.md", " M|notes/a.md|notes/a.md"), ("R  old.md -> new dir/b.md", "R |old.md|new dir/b.md"), ('?? "a b.md"', "??|a b.md|a b.md"), ('R  "x\\ty" -> "z\\"q"', 'R |x\ty|z"q'), ("D  gone.md", "D |gone.md|gone.md"), ('A  "caf\\303\\251"', "A |caf\u00c3\u00a9|caf\u00c3\u00a9"), ('?? "open', '??|"open|"open'),
])
def status_of(line):
    return per_value(P.status_line)(line)


@cases("src_git_status", [(" M a.md", "modified"), ("?? a.md", "untracked"), ("D  a.md", "deleted"), (" D a.md", "deleted"), ("DM a.md", "other"), ("R  a -> b", "renamed"), ("A  a", "added")])
def status_kind(line):
    code = F.substring(line, 1, 2)
    return F.when(code == "??", "untracked").when(code.isin("D ", " D"), "deleted").when(code.startswith("R"), "renamed").when(code.startswith("A"), "added").when(code.isin(" M", "M ", "MM"), "modified").otherwise("other")


@cases("filt_status_skip", [("node_modules/x", True), ("a/node_modules/x", False), (".git/config", True), ("TMP/a", True), ("notes/tmp/a", False), (".state/import-repair/evidence/x.md", True), (".state/import-repair/case/x.md", False), ("", False), ("\\temp\\a", True)], "boolean")
def skipped(path):
    return P.skipped(path)


@cases("cls_file_hygiene", [
    ("a.sync-conflict-2.md", 1, "is_conflict"), ("x/__pycache__/a.pyc", 1, "is_cache"), ("Thumbs.db", 1, "is_local,is_binary"), (".env.test", 1, "is_local"), (".obsidian/workspace-mobile.json", 1, "is_local"), ("a/.obsidian/workspace.json", 1, ""), ("temp/a.md", 1, "is_temp"), ("temp", 1, ""), ("a.md", 10485761, "is_large"), ("a/b.PDF", 1, "is_binary"), ("notes.md", 1, ""),
])
def hygiene(path, size):
    return F.concat_ws(",", *(F.when(flag, name) for name, flag in P.hygiene(path, size).items()))


@cases("cls_import_meta", [("a/x.pdf", "pdf-import-note|[import, pdf]|# PDF Import - x"), ("s.PPT", "slide-summary|[import, slides]|# Slide Summary - s"), ("t.v2.xlsx", "imported-table-summary|[import, table]|# Imported Table Summary - t.v2"), ("d.docx", "imported-reference|[import, reference]|# Imported Reference - d"), ("noext", "imported-reference|[import, reference]|# Imported Reference - noext")])
def import_meta(path):
    return P.import_meta(path)


@cases("cls_local_plan", [("a.pdf", "pdf:pdf-to-md"), ("a.DOCX", "docx:docx-to-md"), ("a.pptx", "pptx:pptx-to-md"), ("a.xlsx", "xlsx:xlsx-to-md"), ("a.webp", "image-index:image-index"), ("a.doc", "legacy-office-index:legacy-office-index"), ("a.vhd", "binary-index:binary-index"), ("a.py", None), ("a.unknown", "binary-index:binary-index"), ("noext", "binary-index:binary-index")])
def local_plan(path):
    return P.local_plan(path)


@cases("cvt_dispatch_local", [("a.pdf", "pdf"), ("b.JPG", "image-index"), ("c.md", "skip"), ("d.xls", "legacy-office-index"), ("e.bit", "binary-index")])
def dispatch(path):
    return F.coalesce(F.substring_index(P.local_plan(path), ":", 1), F.lit("skip"))


@cases("cls_method", [("a.pdf", "auto", True, "api"), ("a.pdf", "auto", False, "local"), ("a.pdf", "local", True, "local"), ("a.md", "api", True, "local"), ("a.PNG", "api", False, "api"), ("a.vhd", "auto", True, "local")])
def convert_method(path, asked, token):
    return P.method(path, asked, token)


@cases("probe_route", [
    (0, 0, 0.0, False, "scanned:mineru-api"), (10, 150, 0.0, False, "scanned:mineru-api"), (3, 120, 0.0, False, "academic:mineru-api"), (20, 5000, 0.01, True, "mojibake-text-layer:mineru-api"), (20, 4000, 0.044, False, "text-manual:pymupdf"), (20, 4000, 0.045, False, "academic:mineru-api"), (2, 1599, 0.0, False, "academic:mineru-api"), (1, 800, 0.0, False, "text-manual:pymupdf"),
])
def route(pages, chars, density, mojibake):
    return P.pdf_route(pages, chars.cast("double"), density, mojibake)


@cases("probe_env_override", [("", 5, 5), ("12", 5, 12), (" 7 ", 5, 7), ("0", 5, 5), ("-3", 5, 5), ("x", 5, 5), ("1_000", 5, 1000), (None, 5, 5)], "bigint")
def env_override(raw, default):
    number = F.when(F.btrim(raw).rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(F.btrim(raw), F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.when(number > 0, number).otherwise(default)


@cases("filt_inbox", [("tasks/inbox/a.md", True), ("inbox/a.md", True), ("tasks/inbox/sub/a.md", False), ("myinbox/a.md", False), ("inbox", False)], "boolean")
def in_inbox(path):
    return path.rlike("(^|/)inbox/[^/]+$")


@cases("fn_relpath", [("/v/notes/a.md", "/v", "notes/a.md"), ("/v/a.md", "/v", "a.md"), ("/w/a.md", "/v", "/w/a.md"), ("/vault/a.md", "/v", "/vault/a.md"), ("C:\\v\\a.md", "C:/v", "a.md")])
def relpath(path, root):
    whole = P.slashes(path)
    return F.when(whole.startswith(F.concat(root, F.lit("/"))), F.substring(whole, F.char_length(root) + 2, F.lit(1 << 20))).otherwise(whole)


@cases("fn_rel_link", [("notes/a b.md", "reviews/x/p.md", "../../notes/a%20b.md"), ("reviews/x/q(1).md", "reviews/x/p.md", "q%281%29.md"), ("题/一#二.md", "p.md", "题/一%23二.md"), ("a%b?.md", "p.md", "a%25b%3F.md"), ("a.md", "a/b.md", "../a.md")])
def rel_link(target, page):
    return per_value(P.relative_link)(target, page)


@cases("fn_annotation_id", [("2024/a.pdf.md", "2024__a"), ("b.md", "b"), ("x/y/c.txt", "x__y__c.txt"), ("d.pdf.md.md", "d.pdf.md"), (".pdf.md", "")])
def annotation_id(path):
    return F.replace(F.regexp_replace(path, r"(?:\.pdf)?\.md$", ""), F.lit("/"), F.lit("__"))


@cases("fn_course_state_key", [("/v/courses/2026-spring/la", "2026-spring/la"), ("/v/courses/la", "la"), ("/elsewhere/la", "la")])
def course_key(path):
    return F.when(path.contains("/courses/"), F.substring_index(path, "/courses/", -1)).otherwise(F.substring_index(path, "/", -1))


@cases("fn_tag_slug", [("2026-spring/la", "2026-spring-la"), ("la", "la"), ("a/b/c", "a-b-c")])
def tag_slug(key):
    return F.replace(key, F.lit("/"), F.lit("-"))


@cases("fn_infer_course", [("/v/courses/la/notes/x.md", "la"), ("/v/courses/2026/la/homework/x.md", "la"), ("/v/courses/la/x.md", ""), ("/v/notes/x.md", ""), ("/v/courses/2026/la/other/x.md", "")])
def infer_course(path):
    rest = F.split(F.element_at(F.split(path, "/courses/", 2), -1), "/")
    mark = lambda k: F.coalesce(F.get(rest, F.lit(k)).isin(*P.COURSE_FOLDERS), F.lit(False))
    found = F.when(mark(1), F.get(rest, F.lit(0))).when(mark(2), F.get(rest, F.lit(1))).otherwise("")
    return F.when(path.contains("/courses/"), found).otherwise("")


@cases("scan_fallback_root", [
    ("a.pdf.md\nb.pdf.md", "**/*.pdf.md", "|**/*.pdf.md"), ("文本/a.pdf.md\n试卷/a.pdf", "**/*.pdf.md", "文本|*.pdf.md"), ("text/x/a.pdf.md", "**/*.pdf.md", "text|**/*.pdf.md"), ("文本/a.pdf.md\ntext/b.pdf.md", "**/*.pdf.md", "|**/*.pdf.md"), ("markdown/a.pdf.md", "*.pdf.md", "markdown|*.pdf.md"), ("md/x/a.pdf.md\nb.pdf", "*.pdf.md", "md|**/*.pdf.md"), ("a.pdf", "*.pdf.md", "|*.pdf.md"),
])
def papers_root(files, pattern):
    return per_value(P.papers_root)(files, pattern)


_TREE = "courses/la/index.md\ncourses/la/notes/a.md\ncourses/2026/la/homework/b.md\ncourses/2026/optics/index.md\ncourses/2027/optics/notes/x.md\ncourses/empty/readme.txt\nother/notes/x.md"


@cases("scan_courses", [(_TREE, "2026/la|2026/optics|2027/optics|la"), ("courses/a/b/c/notes/x.md", ""), ("", ""), ("courses/a/labs/x.md", "a")])
def all_courses(files):
    return per_value(lambda x: "|".join(P.course_folders(x)))(files)


@cases("scan_resolve_course", [(_TREE, "2026/la", "", "2026/la"), (_TREE, "LA", "2026", "2026/la"), (_TREE, "la", "", "la"), (_TREE, "Optics", "", "ambiguous: 2026/optics, 2027/optics"), (_TREE, "optics", "2027", "2027/optics"), (_TREE, "chemistry", "", "not found")])
def course_named(files, wanted, semester):
    return per_value(P.resolve_course)(files, wanted, semester)


def _lines(files):
    return F.split(files, "\n")


def _first_there(files, *candidates):
    there = F.filter(F.array(*candidates), lambda c: F.array_contains(_lines(files), c))
    return F.get(there, F.lit(0))


@cases("join_raw_sibling", [("a.pdf.md", "", "a.pdf.raw.md\nx", "a.pdf.raw.md"), ("a.pdf.md", "x.md", "a.pdf.raw.md\nx.md", "x.md"), ("a.pdf.md", "gone.md", "a.pdf.raw.md", "a.pdf.raw.md"), ("a.pdf.md", "../out.md", "../out.md", None), ("a.pdf.md", "x.txt", "x.txt", None), ("b.md", "", "a.pdf.raw.md", None)])
def raw_sibling(path, declared, files):
    """The declared raw import inside the vault, else the one beside the file."""
    own = F.when((declared != "") & declared.endswith(".md") & ~declared.contains(".."), declared)
    return _first_there(files, own, F.concat(F.regexp_replace(path, r"\.md$", ""), F.lit(".raw.md")))


@cases("join_summary", [("a.pdf.md", "a.pdf-repair-summary.md", "a.pdf-repair-summary.md"), ("a.pdf.md", "a-repair-summary.md\na.pdf.md-repair-summary.md", "a.pdf.md-repair-summary.md"), ("a.pdf.md", "a-repair-summary.md", "a-repair-summary.md"), ("a.md", "b-repair-summary.md", None)])
def repair_summary(path, files):
    stem, mark = F.regexp_replace(path, r"\.md$", ""), F.lit("-repair-summary.md")
    return _first_there(files, F.concat(stem, mark), F.concat(path, mark), F.concat(F.regexp_replace(stem, r"\.pdf$", ""), mark))


@cases("join_sidecar_names", [("2020答案.pdf.md", "2020.pdf.md\n2020答案.pdf.md", "2020.pdf.md"), ("2020.pdf.md", "2020.pdf.md\n2020参考答案.pdf.md", "2020参考答案.pdf.md"), ("2021.pdf.md", "2020答案.pdf.md", None), ("2020解析复习版.pdf.md", "x2020.pdf.md\n2020.pdf.md", "2020.pdf.md"), ("a.pdf.md", "a.pdf.md", None)])
def paired(path, files):
    """The problem of an answer, or the answer of a problem: names that differ by marks of answers only."""
    bare = F.regexp_replace(path, "参考答案|答案|解析|复习版", "")
    stem = F.regexp_replace(path, r"\.(?:pdf|PDF)\.md$", "")
    others = F.filter(F.array_sort(F.array_distinct(_lines(files))), lambda f: f != path)
    problem = F.filter(others, lambda f: F.endswith(f, bare) | (F.contains(f, F.regexp_replace(bare, r"\.pdf\.md$", "")) & F.endswith(f, F.lit(".pdf.md"))))
    answer = F.filter(others, lambda f: F.startswith(f, stem) & F.contains(F.substring(f, F.char_length(stem) + 1, F.lit(1 << 20)), F.lit("答案")) & F.endswith(f, F.lit(".pdf.md")))
    return F.get(F.when(path != bare, problem).otherwise(answer), F.lit(0))


@cases("join_review_regex", [("hw1", "2026-hw1-review.md", True), ("hw1", "hw10-review.md", False), ("hw1", "hw1.md", True), ("a.b", "axb.md", False), ("a.b", "x-a.b-y.md", True), ("hw1", "xhw1.md", False)], "boolean")
def reviews(base, name):
    """Whether a review's name holds the homework's as a whole part between dashes."""
    return F.contains(F.concat(F.lit("-"), F.regexp_replace(name, r"\.md$", ""), F.lit("-")), F.concat(F.lit("-"), base, F.lit("-")))


@cases("seq_suffix", [("note", "", "note.md"), ("note", "note.md", "note-2.md"), ("note", "note.md,note-2.md", "note-3.md"), ("note", "note-2.md", "note.md"), ("note", "note.md,note-3.md", "note-2.md")])
def free_name(base, taken):
    names = F.transform(F.sequence(F.lit(1), F.size(F.split(taken, ",")) + 1), lambda n: F.concat(base, F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".md")))
    return F.get(F.filter(names, lambda x: ~F.array_contains(F.split(taken, ","), x)), F.lit(0))


@cases("list_md", [("b.md\na.md\nREADME.md\nsub/c.md\nx.txt", "a.md|b.md"), ("", ""), ("readme.md", "readme.md")])
def md_files(files):
    return F.array_join(F.array_sort(F.filter(_lines(files), lambda f: f.rlike(r"^[^/]+\.md$") & (f != "README.md"))), "|")


@cases("list_files", [("b.md\na.md\nsub/c.md\nx.txt", "a.md|b.md"), ("", ""), ("d/e.md", "")])
def files_in(files):
    return F.array_join(F.array_sort(F.filter(_lines(files), lambda f: f.rlike(r"^[^/]+\.md$"))), "|")


@cases("plan_evidence_path", [("notes/a.md", True), ("../a.md", False), ("/etc/a.md", False), ("a/../../b.md", False), ("a/../b.md", True), ("a.txt", False), ("", False)], "boolean")
def evidence_inside(path):
    """A Markdown file below the root: no step up leaves it."""
    depth = F.transform(F.split(path, "/"), lambda x: F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1))
    least = F.aggregate(depth, F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")), lambda a, d: F.struct((a["now"] + d).alias("now"), F.least(a["low"], a["now"] + d).alias("low")))["low"]
    return path.endswith(".md") & ~path.startswith("/") & (least >= 0)


prep_evidence = cases("prep_evidence", [("notes/a.md", True), ("../../secret.md", False), ("x/./y.md", True), ("notes/a.pdf", False)], "boolean")(evidence_inside)

# --------------------------------------------------------------------------
# records


@cases("agg_count_value", [('{"n": 3}', 3), ('{"n": "4"}', 4), ('{"n": 2.0}', 2), ('{"n": "2.0"}', 0), ('{"n": "many"}', 0), ('{"n": -2}', 0), ('{"n": true}', 0), ('{"n": null}', 0), ('{"m": 5}', 1), ('{"n": 0}', 0), ('{"n": 1.5}', 0), ('{"n": " 7 "}', 7), ('{"n": "07"}', 0)], "bigint")
def count_value(fields):
    return C.counted(fields, "n")


@cases("cls_confidence", [('{"confidence": "High"}', "high"), ('{"confidence": " medium "}', "medium"), ('{"confidence": "needs-review"}', "low"), ("{}", "high"), ('{"confidence": null}', "invalid"), ('{"confidence": ""}', "invalid"), ('{"confidence": "kinda-sure"}', "invalid")])
def confidence(fields):
    value = F.lower(F.btrim(F.get_json_object(fields, "$.confidence")))
    known = F.when(value == "high", "high").when(value == "medium", "medium").when(value.isin(*LOW), "low").otherwise("invalid")
    return F.when(~F.array_contains(F.json_object_keys(fields), "confidence"), "high").otherwise(known)


#: Labels that count as low confidence (fixed values).
LOW = ["low", "uncertain", "needs-review"]


@cases("cls_display_label", [("reliability", "answer-key", "答案卷"), ("reliability", "Recall", "回忆版"), ("format", "MCQ", "选择"), ("format", "oral", "oral"), ("difficulty", "3", "★★★"), ("difficulty", " hard ", "难"), ("difficulty", "", "未标注")])
def display_label(kind, value):
    raw = F.btrim(value)
    label = F.lit(None).cast("string")
    for name, table in LABELS.items():
        names = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
        label = F.when(kind == name, F.coalesce(F.try_element_at(names, raw), F.try_element_at(names, F.lower(raw)), raw)).otherwise(label)
    return F.when(raw == "", "未标注").otherwise(label)


# What users see of each label.
LABELS = {
    "reliability": {"answer-key": "答案卷", "review-copy": "复习版", "recall": "回忆版", "unspecified": "未标注"},
    "format": {"unspecified": "未标注", "choice": "选择", "multiple-choice": "选择", "mcq": "选择", "select": "选择", "fill": "填空", "fill-in": "填空", "blank": "填空", "calculation": "计算", "compute": "计算", "short-answer": "简答", "true-false": "判断", "proof": "证明"},
    "difficulty": {"unspecified": "未标注", "easy": "易", "medium": "中", "hard": "难", "1": "★", "2": "★★", "3": "★★★", "4": "★★★★", "5": "★★★★★", "*": "★", "**": "★★", "***": "★★★", "****": "★★★★", "*****": "★★★★★"},
}


@cases("cls_source_role", [("2020试卷及答案.pdf.md", "combined"), ("2020答案复习版.pdf.md", "answer_review"), ("a/2020答案.md", "answer"), ("2020试卷复习版.pdf.md", "problem_review"), ("2020试题.pdf.md", "problem"), ("2020.pdf.md", "unknown"), ("试卷答案.md", "combined")])
def source_role(path):
    return C.source_role(C.sidecar_stem(path))


@cases("fn_canonical_stem", [("2024-final答案复习版.pdf.md", "2024-final"), ("期末试卷及答案.pdf.md", "期末"), ("a/2020_试题 .md", "2020"), ("答案.md", ""), ("2020·试卷.pdf.md", "2020"), ("plain.md", "plain")])
def stem_of(path):
    return C.canonical_stem(C.sidecar_stem(path))


@cases("cls_likely_area", [("import", "document import pipeline"), ('"docs"', "documentation and usage guidance"), ("", "general tool behavior"), ("unknown", "general tool behavior"), ("git", "git workflow and change grouping"), ("agent-routing", "agent role routing and subagent/main-agent handoff")])
def likely_area(kind):
    names = F.create_map(*(F.lit(x) for kv in AREAS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, X.yaml_scalar(kind)), F.lit(AREAS["other"]))


# What each kind of feedback is about; the last names the tool, here without its name.
AREAS = {
    "workflow": "workflow and orchestration", "template": "templates and generated artifact structure", "routing": "routing and companion selection", "import": "document import pipeline", "exam-prep": "AI-first exam prep workflow and teaching-material quality",
    "import-repair": "imported markdown repair workflow", "agent-routing": "agent role routing and subagent/main-agent handoff", "quality-gate": "mechanical tripwire and quality gate coverage", "git": "git workflow and change grouping", "quality": "output quality and result shaping",
    "docs": "documentation and usage guidance", "course-pack": "course packs and specialization rules", "install": "installation and self-update workflow", "other": "general tool behavior",
}


@cases("cls_infer_runtime", [("on Windows 11, Python 3.12.1, version: 2.0", "Windows|3.12.1|2.0"), ("macOS with py 3.11", "macOS|3.11|unknown"), ("in /home/x; installed version 1.4, ok", "Linux|unknown|1.4"), ("nothing", "unknown|unknown|unknown"), ("darwin python version: 3.13", "macOS|3.13|"), ("installed 0.9;", "unknown|unknown|0.9")])
def infer_runtime(text):
    low = F.lower(text)
    system = F.when(low.contains("windows"), "Windows").when(low.rlike("macos|darwin|os x"), "macOS").when(low.rlike("linux|/home/"), "Linux").otherwise("unknown")
    number = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)\bpython(?: version)?[: ]+([0-9]+(?:\.[0-9]+){1,2})\b", r"(?i)\bpy(?:thon)?\s*([0-9]+(?:\.[0-9]+){1,2})\b")), F.lit("unknown"))
    version = F.when(text.rlike(r"(?i)(?:installed(?: version)?|version)[: ]+[^\s,;]+"), F.regexp_extract(text, r"(?i)(?:installed(?: version)?|version)[: ]+([^\s,;]+)", 1)).otherwise("unknown")
    return F.concat_ws("|", system, number, F.when(low.contains("darwin"), "").otherwise(version))


@cases("cls_evidence_mode", [("---\nrepair_evidence_mode: ocr-assisted\nsource_file: a.pdf\n---\n", "ocr-assisted"), ("---\nderived_from_import: a.raw.md\n---\n", "text-grounded"), ("---\nsource_file: X.PDF\n---\n", "pdf-declared"), ("---\nsource_file: x.docx\n---\n", "evidence-missing"), ("no", "evidence-missing")])
def evidence_mode(md):
    front = X.front_matter_map(md)
    value = lambda k: F.coalesce(F.try_element_at(front, F.lit(k)), F.lit(""))
    return F.when(value("repair_evidence_mode") != "", value("repair_evidence_mode")).when(value("derived_from_import") != "", "text-grounded").when(F.lower(value("source_file")).endswith(".pdf"), "pdf-declared").otherwise("evidence-missing")


@cases("cls_review_guidance", [
    ("", "", ""), ("proposal-target-stale,text-x", "", "stale-proposal"), ("proposal-scope-widened-without-authorization", "", "proposal-scope-widened"), ("markdown-paragraph-boundary-regression", "math-dollar-odd-line", "markdown-paragraph-boundary-regression"), ("other", "math-dollar-odd-line", "replacement-still-has-blocking-risks"), ("other", "unicode-escape", "proposal-review-failed"),
    ("proposal-derived-from-scratch-fix,text-a", "", "scratch-fix-proposal-rejected"), ("text-model-blocked-by-vision-risk", "", "insufficient-evidence-mode"), ("proposal-case-target-stale", "", "stale-proposal"),
])
def review_guidance(found, risks):
    """Why a review fails, by its error codes and what the replacement still holds: the first reason that applies."""
    has = lambda *names: F.arrays_overlap(F.split(found, ","), F.array(*map(F.lit, names)))
    blocking = F.arrays_overlap(F.split(risks, ","), F.array(*map(F.lit, R.BLOCKING)))
    rules = [
        ("", found == ""), ("stale-proposal", has("proposal-target-stale", "proposal-case-target-stale")), ("proposal-scope-widened", has("proposal-scope-widened-without-authorization")), ("markdown-paragraph-boundary-regression", has("markdown-paragraph-boundary-regression")),
        ("replacement-still-has-blocking-risks", blocking), ("scratch-fix-proposal-rejected", has("proposal-derived-from-scratch-fix")), ("insufficient-evidence-mode", F.exists(F.split(found, ","), lambda c: c.startswith("text-"))),
    ]
    return P.first_match(rules, "proposal-review-failed")


@cases("qc_queue_item", [('{"schema_version": "v1", "path": "a", "content_sha256": "x", "recommended_evidence_mode": "auto", "blocked": ""}', ""), ('{"schema_version": "", "path": "a", "content_sha256": "x", "recommended_evidence_mode": "auto", "blocked": ""}', "schema_version"), ('{"path": " "}', "schema_version,path,content_sha256,recommended_evidence_mode,blocked"), ("{}", "schema_version,path,content_sha256,recommended_evidence_mode,blocked")])
def queue_item_lacks(record):
    needed = ["schema_version", "path", "content_sha256", "recommended_evidence_mode"]
    empty = [F.when(F.coalesce(F.btrim(F.get_json_object(record, f"$.{k}")), F.lit("")) == "", F.lit(k)) for k in needed]
    return F.concat_ws(",", *empty, F.when(~F.array_contains(F.json_object_keys(record), "blocked"), F.lit("blocked")))


@cases("inc_status_machine", [("open", "raw"), ("triaged", "triaged"), ("resolved", "resolved"), ("archived", "resolved"), ("done", None), ("", None)])
def status_folder(status):
    return F.try_element_at(F.create_map(*map(F.lit, ["open", "raw", "triaged", "triaged", "resolved", "resolved", "archived", "resolved"])), status)


@cases("fix_merge_parts", [('[{"start_page":1,"end_page":2,"markdown":" a "},{"start_page":3,"end_page":4,"markdown":"b"}]', "<!-- MERGED from 2 parts: pages 1-2, pages 3-4 -->\n\na\n\nb"), ('[{"start_page":1,"end_page":9,"markdown":""},{"start_page":10,"end_page":10,"markdown":"x"}]', "<!-- MERGED from 2 parts: pages 1-9, pages 10-10 -->\n\nx")])
def merged(parts):
    rows = F.from_json(parts, "array<struct<start_page:int,end_page:int,markdown:string>>")
    ranges = F.array_join(F.transform(rows, lambda p: F.format_string("pages %d-%d", p["start_page"], p["end_page"])), ", ")
    bodies = F.filter(F.transform(rows, lambda p: F.btrim(p["markdown"], F.lit(" \n\t\r"))), lambda b: b != "")
    return F.concat(F.lit("<!-- MERGED from "), F.size(rows).cast("string"), F.lit(" parts: "), ranges, F.lit(" -->\n\n"), F.array_join(bodies, "\n\n"))


_PAGE = "---\nquality: reviewed\nold: 1\n---\n\n\n# 7 · Rank\n\nmine\n# 8 · x\n"


@cases("census_meta_refresh", [
    (_PAGE, "---\ntype: exam-type-analysis\nexam_type_id: \"rank\"\nrank: 2\npaper_count: 3\nmust_know: true\nquality: reviewed\nstatus: active\n---\n# 02 · Rank\n\nmine\n# 8 · x\n"),
    ("body only", "---\ntype: exam-type-analysis\nexam_type_id: \"rank\"\nrank: 2\npaper_count: 3\nmust_know: true\nquality: draft\nstatus: active\n---\nbody only"),
])
def refreshed(md):
    """New front matter before the body that people wrote; the quality stays, and the first heading's rank follows."""
    body = F.regexp_replace(X.body(md), r"\A\n+", "")
    quality = F.coalesce(F.nullif(F.regexp_extract(X.front_matter(md), r"(?md)^quality:\s*(\S+)\s*$", 1), F.lit("")), F.lit("draft"))
    old = F.regexp_extract(body, r"(?md)^#\s+\d+\s*·", 0)
    head = F.concat(F.lit('---\ntype: exam-type-analysis\nexam_type_id: "rank"\nrank: 2\npaper_count: 3\nmust_know: true\nquality: '), quality, F.lit("\nstatus: active\n---\n"))
    return F.concat(head, F.when(old == "", body).otherwise(F.overlay(body, F.lit("# 02 ·"), F.position(old, body), F.char_length(old))))


@cases("pred_generated", [("generated_fingerprint: aa\nbody\n", "body\n", True), ("body\n", "body!\n", False), ('source_artifacts: ["x"]\nbody\n', "body\n", True), ("generated_fingerprint: b\nbody \n", "body\n", False)], "boolean")
def machine_owned(page, stamped):
    """Whether a page is as it was made: its fingerprint, without machine lines, is that of the text stamped."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?md)^generated_fingerprint:\s*.*\n?", ""), r"(?md)^source_artifacts:\s*\[.*\]\s*\n?", "")
    print_ = lambda x: F.substring(F.sha2(x, 256), 1, 16)
    return (print_(bare) == print_(stamped)) | (print_(F.regexp_replace(page, r"(?md)^generated_fingerprint:\s*.*\n?", "")) == print_(stamped))


_CONCEPT = [("courses/la/references/线性代数教材.pdf.md", True), ("courses/la/references/期末试卷.pdf.md", False), ("courses/la/references/reviews/教材.pdf.md", False), ("courses/la/references/教材.pdf.raw.md", False), ("courses/la/slides/week1.pdf.md", True), ("references/textbooks/optics.pdf.md", False), ("references/textbooks/linear-algebra.pdf.md", True), ("courses/la/references/教材.md", False)]


@cases("pred_concept_source", _CONCEPT, "boolean")
def concept_source(path):
    """Imported textbooks and lecture material of the course *linear-algebra* in ``courses/la``."""
    name, dirs = F.lower(F.regexp_extract(path, "([^/]*)$", 1)), F.lower(F.regexp_extract(path, "^(.*/)", 1))
    import_ = path.endswith(".pdf.md") & ~name.contains(".raw.")
    exam = name.rlike("试卷|试题|期中|期末|真题|答案|exam") | dirs.rlike("/(?:reviews?|papers|exam papers|期中|期末|答案|answers|ans)/")
    own = F.when(dirs.startswith("references/textbooks/"), name.rlike("linear|algebra")).when(dirs.rlike("^courses/la/(?:slides|lectures|课件|教材|教材课件)/"), True).when(dirs.startswith("courses/la/references/"), name.rlike("教材|课本|讲义|textbook|linear|algebra")).otherwise(False)
    return import_ & ~exam & own


# --------------------------------------------------------------------------
# taxonomies


def _tax(*types, version=1, course="", scope="") -> str:
    return json.dumps({"version": version, "course": course, "exam_scope": scope, "types": [dict(zip(("id", "name", "aliases", "keywords"), t)) for t in types]}, ensure_ascii=False, separators=(",", ":"))


@cases("src_yaml_taxonomy", [
    ('version: 2\ncourse: "la"\nexam_scope: "期中"\ntypes:\n  - id: "rank"\n    name: "秩"\n    aliases: ["r", "s, t"]\n    keywords: []\n', _tax(("rank", "秩", ["r", "s, t"], []), version=2, course="la", scope="期中")),
    ("types:\n- aliases:\n  - a\n  - b\n  id: x\n  keywords:\n  - k\n  name: X\n- id: y\ncourse: la\nversion: 1\n", _tax(("x", "X", ["a", "b"], ["k"]), ("y", "y", [], []), course="la")),
    ("course: la\ntypes:\n  - id: a\n    aliases: [p, 'q']\n    note: z\n# end\n", _tax(("a", "a", ["p", "'q'"], []), course="la")),
    ("types:\n  - name: no id\n", None), ("", _tax()), ("version: x\ntypes:\n", _tax()),
])
def yaml_taxonomy(text):
    return T.taxonomy_json(text)


@cases("sink_taxonomy_yaml", [(_tax(("rank", "秩", ["r", 'q"'], []), version=2, course="la", scope="期中"), 'version: 2\ncourse: "la"\nexam_scope: "期中"\ntypes:\n  - id: "rank"\n    name: "秩"\n    aliases: ["r", "q\\""]\n    keywords: []\n'), (_tax(), 'version: 1\ncourse: ""\nexam_scope: ""\ntypes:\n'), (_tax(("a", "", [], ["k"])), 'version: 1\ncourse: ""\nexam_scope: ""\ntypes:\n  - id: "a"\n    name: "a"\n    aliases: []\n    keywords: ["k"]\n')])
def yaml_of(record):
    return T.taxonomy_yaml(F.from_json(record, T.SCHEMA))


@cases("sink_repair_case", [("plain", "```markdown\nplain\n```"), ("a ``` b", "````markdown\na ``` b\n````"), ("````", "`````markdown\n````\n`````"), ("", "```markdown\n\n```")])
def fenced(text):
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda x: F.char_length(x))), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
    return F.concat(fence, F.lit("markdown\n"), text, F.lit("\n"), fence)


@cases("fix_span_hash", [("a\nb", repair.span_hash(["a", "b"])), ("", repair.span_hash([]))])
def span_digest(text):
    return F.sha2(F.when(text == "", "").otherwise(F.concat(text, F.lit("\n"))), 256)
