"""One query for each defect, over lines that have it and lines that only look like it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risks as R
from ..sources.tables import dealt_table
from .cases import dealt, sql_literal
from .registry import register

ROWS2 = r"1 & 2 \\ 3 & 4"


def _display(body: str) -> str:
    return f"$$\n{body}\n$$"


#: A text, and the (code, line) pairs that the rules ask for; no line for a whole document.
SCRAPS: list[tuple[str, list[tuple[str, int | None]]]] = [
    ("plain words", []),
    (r"$\binom{n}{k}$ ways", []),
    (r"$\binom{n}$ ways", [("latex-binom-fragment", 1)]),
    (r"$\binom{n}{ }$ ways", [("latex-binom-fragment", 1)]),
    (r"$\binom {n} {k+\{1\}}$ ways", []),
    ("bad � char", [("mojibake-replacement-char", 1)]),
    (r"a \u4e2d b", [("unicode-escape", 1)]),
    (r"`\u4e2d` in code", []),
    (r"\nonumber", [("latex-nonumber", 1)]),
    (r"x = 1 \nonumber", []),
    ("a\n\\nonumber \\\\ ,", [("latex-nonumber", 2)]),
    (r"$\left( a \right)$", []),
    (r"$\left( a \right) + \left[ b$", [("latex-left-right-unbalanced", None)]),
    (r"$\leftarrow$", []),
    (_display(rf"\begin{{array}}{{cc}} {ROWS2} \end{{array}}"), []),
    (_display(rf"\begin{{array}}{{ccc}} {ROWS2} \end{{array}}"), [("latex-array-column-mismatch", 2)]),
    (_display(r"\begin{array}{c|c} 1 & 2 \\ 3 & 4 & 5 \\ \end{array}"), [("latex-array-column-mismatch", 2)]),
    (_display(r"\begin{array}{p|c} 1 & 2 \end{array}"), [("latex-array-layout-uncertain", 2)]),
    (_display(r"\begin{array}{cc} \begin{matrix} 1 & 2 \end{matrix} & 3 \end{array}"), []),
    (_display(r"\begin{array}{cc} {1 & 1} & \& \\ 2 & 3 \end{array}"), []),
    (_display("\\begin{array}{cc} 1 \\\\ 2 \\end{array}"), [("latex-array-column-mismatch", 2)]),
    (_display(r"\begin{array}{cc} 1 & { \\ 2 & 3 \end{array}"), [("latex-array-layout-uncertain", 2)]),
    (r"so $\begin{array}{c} 1 \end{array}$ holds", [("obsidian-inline-array-render-risk", 1)]),
    (r"so $\begin{pmatrix} 1 & 2 \end{pmatrix}$ holds", []),
    ("so $\\begin{pmatrix} " + "1 & " * 20 + "2 \\end{pmatrix}$ holds", [("obsidian-inline-array-render-risk", 1)]),
    ("text $$ x $$ text", [("display-math-delimiter-not-standalone", 1)]),
    ("$$x$$", [("display-math-delimiter-not-standalone", 1)]),
    ("$ x = A^{-1}b $", [("inline-math-delimiter-space", 1)]),
    ("$ 12 $ paid", []),
    ("$ only words $", []),
    ("`$ x = 1 $` code", []),
    (r"$\frac{a}{b$ text", [("latex-math-span-brace-unbalanced", 1)]),
    ("$a}$ text", [("latex-math-span-brace-unbalanced", 1)]),
    (r"$\{a\}$", []),
    (r"$\begin{array}{r}{1 & 2 \\ 3 & 4}\end{array}$", [("latex-array-wrapper-malformed", 1), ("obsidian-inline-array-render-risk", 1)]),
    (_display(r"\begin{array}{r}{1}\end{array}"), []),
    ("costs $5 today", [("math-dollar-odd-line", 1)]),
    ("$x$ and $y", [("math-dollar-odd-line", 1), ("math-dollar-unbalanced", None)]),
    (r"\$5 and $x$", []),
    ("$5, $6 and $x$", []),
    ("```\n$x\n```", []),
    ("~~~\n$x\n~~~\nafter $y", [("math-dollar-odd-line", 1), ("math-dollar-unbalanced", None)]),
    ("## 一、题", [("question-heading-promoted", 1)]),
    ("## 第一章", []),
    ("a\nb\x07", [("control-character", 2)]),
    (r"\boxplus a", [("ocr-symbol-garbage", 1)]),
    (r"\neg \neg a", [("ocr-symbol-garbage", 1)]),
    ("\n".join(["$ x = 1 $"] * 17), [("inline-math-delimiter-space", n) for n in range(1, 18)]),
]
CODES = sorted({code for _, found in SCRAPS for code, _ in found})


def scraps(spark, sf_dir):
    """``doc_id, path, md``: a scrap before the whole text, whose own dollars and signs of markup are taken out."""
    rest = F.regexp_replace("text", r"[$\\`~#{}]", "")
    return dealt_table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.lit("a.md").alias("path"), F.concat(dealt([x for x, _ in SCRAPS]), F.lit("\n\n"), rest).alias("md"))


def _known(code: str) -> str:
    rows = [f"({k}, {sql_literal(line)})" for k, (_, found) in enumerate(SCRAPS) for c, line in found if c == code]
    return f"select doc_id, cast(line_no as int) line_no from documents join (values {', '.join(rows)}) v(k, line_no) on doc_id % {len(SCRAPS)} = k"


def _query(code: str):
    def query(spark, sf_dir):
        return R.detect(scraps(spark, sf_dir)).where(F.col("code") == code).select("doc_id", "line_no")

    return query


for _code in CODES:
    register(f"risk_{_code.replace('-', '_')}", _known(_code))(_query(_code))


@register(
    "agg_affected_samples",
    "select doc_id, code, n \"count\", s sample, t truncated from documents join (values "
    + ", ".join(f"({k}, {sql_literal(c)}, {len(lines) or 1}, {sql_literal(','.join(map(str, lines[:8])))}, {str(len(lines) > 8).lower()})" for k, (_, found) in enumerate(SCRAPS) for c in sorted({c for c, _ in found}) for lines in [sorted(n for x, n in found if x == c and n)])
    + f") v(k, code, n, s, t) on doc_id % {len(SCRAPS)} = k",
)
def agg_affected_samples(spark, sf_dir):
    """Counts of affected lines, eight samples, and whether more were left out."""
    found = R.records(R.detect(scraps(spark, sf_dir)))
    return found.select("doc_id", "code", "count", F.array_join(F.col("sample").cast("array<string>"), ",").alias("sample"), "truncated")
