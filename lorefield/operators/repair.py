"""Deterministic text repairs: chains of built-in replacements, and what needs more than that."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.python import per_value
from ..functions.text import front_matter, let
from .mathscan import clean_noise

#: Ordered (pattern, replacement) rules (fixed values); a broken marker of n signs becomes n signs together.
RULES = [
    (r"(?mdU)^[ \t]*Page \d+[ \t]*$", ""),
    (r"(?mdU)^(#+)(\S)", "$1 $2"),
    *((rf"(?mdU)^(?:#\s+){{{n}}}(?!#\s)(.+)$", "#" * n + " $1") for n in range(8, 1, -1)),
    (r"(?mdU)^(#+ .+?)\s*(?:\.{2,}\s*\d+|\s{2,}\d+)$", "$1"),
    (r"\n{3,}", "\n\n"),
    (r"(?mdU)^[-*]\s{2,}", "- "),
]
CONVERTER = "mineru-agent-v1"


def repair(text: Column) -> Column:
    """Page labels go, headings get one space and lose dot leaders, blank runs and bullets shrink.

    Noise of one converter is cleaned first, in the texts that name it.
    """
    cleaned = F.when(text.rlike(rf"(?md)^import_method:\s*{CONVERTER}\s*$") & text.rlike(r"\\(?:dot|mathrm|overset|stackrel|texttt|sharp)|(?md:^\$\$)"), noise_free(text)).otherwise(text)
    return repair_layout(cleaned)


def repair_layout(text: Column) -> Column:
    for pattern, replacement in RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


noise_free = per_value(lambda x: clean_noise(x)[0])


def ensure_front_matter(text: Column, block: Column) -> Column:
    """Puts a front-matter block before texts that have none."""
    return F.when(front_matter(text).isNotNull(), text).otherwise(F.concat(F.lit("---\n"), block, F.lit("\n---\n\n"), text))


def _line_at(line: Column, block: Column) -> Column:
    """Where a whole line begins in a block that holds it."""
    return F.position(F.concat(F.lit("\n"), line), F.concat(F.lit("\n"), block))


def _in_block(text: Column, change) -> Column:
    """A text whose front matter is changed by a function of the block; one without any stays."""
    put = lambda front: F.overlay(text, change(front), F.position(front, text), F.char_length(front))
    return let(front_matter(text), lambda front: F.when(front.isNull(), text).otherwise(put(front)))


def _set(front: Column, name: str, value: Column) -> Column:
    new = F.concat(F.lit(f"{name}: "), value)
    changed = lambda line: F.when(line == "", F.concat(front, F.lit("\n"), new)).otherwise(F.overlay(front, new, _line_at(line, front), F.char_length(line)))
    return let(F.regexp_extract(front, f"(?md)^{name}:.*$", 0), changed)


def _drop(front: Column, name: str) -> Column:
    block = F.concat(front, F.lit("\n"))

    def without(line: Column) -> Column:
        less = F.overlay(block, F.lit(""), _line_at(line, block), F.char_length(line))
        return F.when(line == "", front).otherwise(let(less, lambda v: F.left(v, F.char_length(v) - 1)))

    return let(F.regexp_extract(block, f"(?md)^{name}:[^\n]*\n", 0), without)


def set_field(text: Column, name: str, value: Column) -> Column:
    """Sets ``name`` in the front matter: its first line there is replaced, or one is added at the end of the block."""
    return _in_block(text, lambda front: _set(front, name, value))


def drop_field(text: Column, name: str) -> Column:
    """Takes the first ``name`` line out of the front matter."""
    return _in_block(text, lambda front: _drop(front, name))


SOURCE_STATUS = r"(?mds)(^## Source[ \t]*$(?:(?!^## ).)*?^- Repair status:)[ \t]*(?:raw|repaired)?[ \t]*$"


def govern(text: Column, needs_review: Column) -> Column:
    """Marks a machine repair: not verified, with a risk where a person has to look; the risk goes where none has."""
    asked = "needs-human-review"

    def block(front: Column) -> Column:
        risk = F.regexp_extract(front, r"(?md)^repair_risk:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
        marked = let(_set(front, "repair_status", F.lit("auto-repaired")), lambda f: _set(f, "verify_status", F.lit("unverified")))
        return let(marked, lambda f: F.when(needs_review, _set(f, "repair_risk", F.lit(asked))).when(risk == asked, _drop(f, "repair_risk")).otherwise(f))

    return F.regexp_replace(_in_block(text, block), SOURCE_STATUS, "$1 auto-repaired")


# --------------------------------------------------------------------------
# spans and differences


def _lines(text: str) -> list[str]:
    return re.sub(r"\r\n?", "\n", text).splitlines()


def span_hash(lines: list[str]) -> str:
    return hashlib.sha256("".join(x + "\n" for x in lines).encode()).hexdigest()


def apply_spans(text: str, spans: str) -> str | None:
    """Replaces line spans, given as JSON ``[[start, end, hash or null, text], …]`` with lines from 1.

    Null where a span lies outside the text, meets another or no longer has its hash.
    A blank line that ended a span ends its replacement too.
    """
    lines = _lines(text)
    wanted = sorted(json.loads(spans), key=lambda span: span[:2], reverse=True)
    if any(a[0] <= b[1] for a, b in zip(wanted, wanted[1:])):
        return None
    for start, end, known, new in wanted:
        old = lines[start - 1 : end]
        if start < 1 or end < start or end > len(lines) or (known and known != span_hash(old)):
            return None
        put = new.rstrip("\n").split("\n")
        if not old[-1].strip() and put[-1].strip():
            put.append("")
        lines[start - 1 : end] = put
    return "".join(x + "\n" for x in lines) if text.endswith(("\n", "\r")) or lines else ""


def changed_ranges(before: str, after: str) -> str:
    """Line ranges of ``before`` that ``after`` changes, as ``a-b,c-d``; an insertion counts as the line it stands before."""
    steps = difflib.SequenceMatcher(None, before.splitlines(), after.splitlines(), autojunk=False).get_opcodes()
    return ",".join(f"{a + 1}-{max(b, a + 1)}" for kind, a, b, _, _ in steps if kind != "equal")


# Numbered questions, and environments that have to be closed.
QUESTION = re.compile(r"(?m)^\s*(?:#{1,3}\s*)?([一二三四五六七八九十]+|[0-9]+)[\.、．)]")
ENVIRONMENTS = ("array", "matrix", "pmatrix", "bmatrix", "cases")
MARKUP = [r"(?s)<!--.*?-->", r"(?is)<(script|style)\b.*?</\1>"]


def visible(text: str) -> str:
    """Characters that a reader sees, without white space."""
    text = re.sub(r"(?s)\A\ufeff?---\r?\n.*?\r?\n---(?:\r?\n|\Z)", "", text)
    for pattern in MARKUP if "<" in text else ():
        text = re.sub(pattern, "", text)
    if "](" in text:
        text = re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", re.sub(r"!\[([^\]]*)\]\([^)]+\)", r"\1", text))
    return "".join(re.sub(r"(?s)<[^>]+>", "", text).split())


def _questions(text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Questions below the first line, by number and beginning: those after a blank line, and those after another."""
    lines = [line.strip() for line in re.split(r"\r\n|\r|\n", text)]
    apart, joined = {}, {}
    for above, line in zip(lines, lines[1:]):
        if m := QUESTION.match(line):
            (joined if above else apart)[m[1], line[:80]] = None
    return list(apart), list(joined)


@lru_cache(maxsize=1)  # copies of a file often follow each other
def shape(text: str) -> str:
    """What a review compares of a text, as JSON; far smaller than the text, so that this moves and not the text."""
    apart, joined = _questions(text)
    return json.dumps({
        "visible": len(visible(text)), "numbers": QUESTION.findall(text), "apart": apart, "joined": joined,
        "unbalanced": any(text.count(f"\\begin{{{e}}}") != text.count(f"\\end{{{e}}}") for e in ENVIRONMENTS),
    }, ensure_ascii=False)


def compared(before: str, after: str) -> str:
    """Codes of what a replacement breaks, by the shapes of both texts; sorted and joined by commas."""
    was, now = json.loads(before), json.loads(after)
    codes = {
        "replacement-body-erased": was["visible"] and now["visible"] < max(1, was["visible"] // 5),
        "question-number-count-decreased": len(now["numbers"]) < len(was["numbers"]),
        "question-number-missing": set(was["numbers"]) - set(now["numbers"]),
        "latex-environment-unbalanced": now["unbalanced"],
        "markdown-paragraph-boundary-regression": set(map(tuple, was["apart"])) & set(map(tuple, now["joined"])),
    }
    return ",".join(sorted(code for code, broken in codes.items() if broken))


def review(before: str, after: str) -> str:
    """Codes of what a replacement breaks, sorted and joined by commas."""
    return compared(shape(before), shape(after))
