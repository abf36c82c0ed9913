"""Classifiers of paths: first match of ordered rules."""

from __future__ import annotations

import ast
import posixpath
import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups with the substrings that select them, in order; what is held back.
GROUPS = [
    ("ops", [".student-os/", "/scripts/", "scripts/", "/templates/", "templates/", "repo-profile.md"]),
    ("feedback", ["/feedback/", "feedback/", "feedback-summary", "type: feedback"]),
    ("imports", ["/references/imports/", "references/imports/", "/references/textbooks/", "references/textbooks/", "/references/slides/", "references/slides/", "imported-reference", "imported-table-summary", "slide-summary", "pdf-import-note"]),
    ("notes", ["/notes/", "notes/", "class-note"]),
    ("report", ["/labs/", "labs/", "lab-report"]),
    ("homework", ["/homework/", "homework/", "-solution.md", "problem-analysis"]),
    ("review", ["/reviews/", "reviews/", "chapter-review", "weekly-review-digest", "review-sheet", "exam-census", "exam-type-", "exam-prep-guide", "formula-cheat-sheet", "answer-template-quickref", "pre-exam-one-hour-checklist", "题型频率统计", "题型解析", "备考指南", "公式总卡", "答题模板速查", "考前1小时清单"]),
    ("tasks", ["/tasks/", "tasks/", "weekly-plan"]),
    ("course", ["/courses/", "courses/", "/semesters/", "semesters/", "dashboard.md", "/index.md", "semester-overview"]),
]
HELD_NEEDLES = [".sync-conflict-", "__pycache__/", "/__pycache__/", ".DS_Store", "Thumbs.db", "node_modules/", "/node_modules/", ".obsidian/workspace"]
HELD_SUFFIXES = {
    "archive or disk image": [".zip", ".7z", ".rar", ".tar", ".gz", ".iso", ".dmg"],
    "binary source document": [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"],
    "binary media asset": [".png", ".jpg", ".jpeg", ".mp3", ".mp4", ".mov", ".mkv", ".webm", ".wav", ".m4a", ".avi"],
    "binary or local environment artifact": [".db", ".sqlite", ".bin", ".exe"],
    "environment file": [".env"],
    "log file": [".log"],
}
LARGE_BYTES = 10 * 1024 * 1024
#: Source suffixes that review archives keep apart from extracted text.
PAPER_SUFFIXES = [".pdf", ".docx", ".pptx", ".xlsx", ".doc", ".ppt", ".xls", ".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".mp3", ".mp4", ".mov", ".avi", ".mkv"]
BINARY = [suffix for reason in list(HELD_SUFFIXES)[:4] for suffix in HELD_SUFFIXES[reason]]
SKIPPED_DIRS = [".git", ".dsh", ".pytest_cache", ".mypy_cache", "__pycache__", "node_modules", "tmp", "temp"]
LOCAL_NAMES = [".ds_store", "thumbs.db", ".env"]
# Suffixes of kinds of sources, with the local converter of each.
IMAGES = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp"]
LEGACY = [".doc", ".ppt", ".xls"]
TEXTS = [".c", ".cc", ".cpp", ".csv", ".json", ".md", ".py", ".rs", ".sh", ".tex", ".toml", ".ts", ".tsx", ".txt", ".yaml", ".yml"]
LOCAL_PLANS = [([".pdf"], "pdf", "pdf-to-md"), ([".docx"], "docx", "docx-to-md"), ([".pptx"], "pptx", "pptx-to-md"), ([".xlsx"], "xlsx", "xlsx-to-md"), (IMAGES, "image-index", "image-index"), (LEGACY, "legacy-office-index", "legacy-office-index"), (TEXTS, None, None)]
LINK_BREAKERS = " ?#<>[]{}|\\%()"


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    out = F.lit(default)
    for name, test in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def contains_any(text: Column, needles: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(text, n))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def group(path: Column) -> Column:
    whole = slashes(path)
    return first_match([(name, contains_any(whole, needles)) for name, needles in GROUPS], "ops")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(slashes(path)), "/"), lambda x: x != "")


def in_virtualenv(path: Column, environments: Column) -> Column:
    """Below a folder of ``environments`` (those with a configuration), or the configuration itself."""
    names = parts(path)
    place = lambda i: F.array_join(F.slice(names, F.lit(1), i + 1), "/")
    own = lambda x, i: x.isin("env", "venv", ".venv") & (F.array_contains(environments, place(i)) | F.coalesce(F.get(names, i + 1) == "pyvenv.cfg", F.lit(False)))
    return F.exists(F.transform(names, own), lambda hit: hit)


def hold_back(path: Column, size: Column, environments: Column | None = None) -> Column:
    """Why a path stays out of a commit; null if it need not."""
    low = F.lower(slashes(path))
    name = F.regexp_extract(low, "([^/]*)$", 1)
    env = F.lit(False) if environments is None else in_virtualenv(path, environments)
    local = contains_any(low, [n.lower() for n in HELD_NEEDLES])
    ending = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")
    reasons = [
        ("environment file", (name == ".env") | name.startswith(".env.")),
        ("sync-conflict file", name.contains(".sync-conflict-")),
        ("local virtual environment", env),
        ("temporary file", F.arrays_overlap(parts(path), F.array(F.lit("tmp"), F.lit("temp")))),
        ("generated cache", local & low.contains("__pycache__")),
        ("local workspace file", local & low.contains(".obsidian/workspace")),
        ("dependency cache", local & low.contains("node_modules/")),
        ("log file", local & low.endswith(".log")),
        ("local-only file", local),
        *((reason, ending.isin(*suffixes)) for reason, suffixes in HELD_SUFFIXES.items()),
        ("large file", F.coalesce(size > LARGE_BYTES, F.lit(False))),
    ]
    return F.nullif(first_match(reasons, ""), F.lit(""))


def hygiene(path: Column, size: Column) -> dict[str, Column]:
    """What keeps a file out of shared history, as flags."""
    names, name = parts(path), F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    dirs = F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
    within = lambda *which: F.arrays_overlap(dirs, F.array(*map(F.lit, which)))
    workspace = (F.get(F.split(path, "/"), F.lit(0)) == ".obsidian") & name.startswith("workspace") & name.endswith(".json")
    return {
        "is_conflict": F.regexp_extract(path, "([^/]*)$", 1).contains(".sync-conflict-"),
        "is_cache": within("__pycache__", "node_modules"),
        "is_local": name.isin(*LOCAL_NAMES) | name.startswith(".env.") | workspace,
        "is_temp": within("tmp", "temp"),
        "is_large": F.coalesce(size > LARGE_BYTES, F.lit(False)),
        "is_binary": suffix(path).isin(*BINARY),
    }


def review_folder(name: Column) -> Column:
    low = F.lower(name)
    rules = [("归档", name.endswith("-repair-summary.md")), ("文本", low.endswith(".pdf.md") | low.endswith(".raw.md")), ("试卷", suffix(name).isin(*PAPER_SUFFIXES))]
    return F.nullif(first_match(rules, ""), F.lit(""))


def skipped(path: Column) -> Column:
    """Whether a status line about the path is not shown: tool folders, and evidence below a state folder."""
    names = parts(path)
    return F.coalesce(F.get(names, F.lit(0)).isin(*SKIPPED_DIRS), F.lit(False)) | F.array_join(names, "/").rlike(r"^\.[^/]+/import-repair/evidence(/|$)")


def unquoted(path: str) -> str:
    """A path as a status line quotes it; what is no string literal stays."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    try:
        value = ast.literal_eval(path)
    except (SyntaxError, ValueError):
        return path
    return value if isinstance(value, str) else path


def status_line(line: str) -> str:
    """``status|source|target`` of one line of a short status."""
    old, arrow, new = line[3:].strip().partition(" -> ")
    both = (old, new) if arrow else (old, old)
    return "|".join([line[:2], *(unquoted(p.strip()) for p in both)])


def local_plan(path: Column) -> Column:
    """``kind:method`` of the local converter; null for files that are text already."""
    plan = F.lit("binary-index:binary-index")
    for suffixes, kind, method in LOCAL_PLANS:
        plan = F.when(suffix(path).isin(*suffixes), F.lit(f"{kind}:{method}") if kind else F.lit(None).cast("string")).otherwise(plan)
    return plan


def import_meta(path: Column) -> Column:
    """``type|tags|title`` of the note for an import."""
    stem = F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), r"^(.+?)(?:\.[^.]*)?$", 1)
    note = lambda kind, tag, title: F.concat(F.lit(f"{kind}|[import, {tag}]|# {title} - "), stem)
    return (
        F.when(suffix(path) == ".pdf", note("pdf-import-note", "pdf", "PDF Import"))
        .when(suffix(path).isin(".pptx", ".ppt"), note("slide-summary", "slides", "Slide Summary"))
        .when(suffix(path).isin(".xlsx", ".xls"), note("imported-table-summary", "table", "Imported Table Summary"))
        .otherwise(note("imported-reference", "reference", "Imported Reference"))
    )


def method(path: Column, asked: Column, token: Column) -> Column:
    """Where a file is converted: by the service if asked for, or if there is a token, and only what it reads."""
    able = suffix(path).isin(".pdf", ".docx", ".pptx", ".xlsx", *IMAGES, *LEGACY)
    return F.when(able & ((asked == "api") | ((asked != "local") & token)), "api").otherwise("local")


def pdf_route(pages: Column, chars: Column, density: Column, mojibake: Column) -> Column:
    """``strategy:tool`` of a probed PDF: no text layer, a broken one, much plain text, or formulas (fixed limits)."""
    per_page = F.coalesce(F.try_divide(chars, F.least(pages, F.lit(5))), F.lit(0.0))
    return (
        F.when((pages == 0) | (per_page < 40), "scanned:mineru-api")
        .when(mojibake, "mojibake-text-layer:mineru-api")
        .when((per_page >= 800) & (density < 0.045), "text-manual:pymupdf")
        .otherwise("academic:mineru-api")
    )


def relative_link(target: str, page: str) -> str:
    """The path of ``target`` as seen from ``page``, with the characters coded that would break a link."""
    return "".join(quote(c, safe="") if c in LINK_BREAKERS else c for c in posixpath.relpath(target, posixpath.dirname(page) or "."))


#: Folders that may hold the text of papers (fixed values, in order).
TEXT_FOLDERS = ["文本", "text", "markdown", "md"]


def papers_root(files: str, pattern: str) -> str:
    """``folder|pattern`` where papers are found among ``files``, a path each line.

    A recursive pattern that only hits one text folder moves there; a pattern without a
    hit is tried in each text folder, then with patterns of its own.
    """
    listed = files.split("\n")

    def hits(root: str, glob: str) -> list[str]:
        deep = "**/" in glob
        name = re.compile(re.escape(glob.replace("**/", "")).replace(r"\*", "[^/]*") + r"\Z")
        below = [f[len(root) :] for f in listed if f.startswith(root)]
        return [f for f in below if f.endswith(".pdf.md") and name.match(posixpath.basename(f) if deep else f)]

    own = [(t, f"{t}/") for t in TEXT_FOLDERS]
    found = hits("", pattern)
    if found:
        only = [t for t, root in own if "**" in pattern and all(f.startswith(root) for f in found)]
        return f"{only[0]}|" + ("*.pdf.md" if hits(f"{only[0]}/", "*.pdf.md") else "**/*.pdf.md") if only else f"|{pattern}"
    return next((f"{t}|{glob}" for t, root in own for glob in (pattern, "*.pdf.md", "**/*.pdf.md") if hits(root, glob)), f"|{pattern}")


#: Folders whose presence makes their parent a course (fixed values).
COURSE_FOLDERS = ["notes", "homework", "reviews", "labs", "references"]


def course_folders(files: str) -> list[str]:
    """Courses one or two levels below ``courses/``: folders with an index or with one of the course folders."""
    below = [f.split("/")[1:] for f in files.split("\n") if f.startswith("courses/")]

    def is_course(*path: str) -> bool:
        rest = [p[len(path) :] for p in below if p[: len(path)] == list(path) and len(p) > len(path)]
        return any(r == ["index.md"] or (len(r) > 1 and r[0] in COURSE_FOLDERS) for r in rest)

    found = set()
    for first in {p[0] for p in below if len(p) > 1}:
        if is_course(first):
            found.add(first)
        else:
            found |= {f"{first}/{p[1]}" for p in below if p[0] == first and len(p) > 2 and is_course(first, p[1])}
    return sorted(found)


def resolve_course(files: str, wanted: str, semester: str) -> str:
    """The course that a name means: as written, in the semester, as a slug, or the only one of that name."""
    courses = course_folders(files)
    slug = lambda x: re.sub(r"[^a-z0-9]+", "-", x.lower()).strip("-")
    name = slug(posixpath.basename(wanted.replace("\\", "/")))
    for candidate in (wanted.replace("\\", "/"), f"{slug(semester)}/{name}" if semester else "", name):
        if candidate in courses:
            return candidate
    same = [c for c in courses if posixpath.basename(c) == name]
    return same[0] if len(same) == 1 else ("ambiguous: " + ", ".join(same) if same else "not found")
