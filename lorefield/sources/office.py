"""Office files as Markdown: DOCX, PPTX and XLSX through their XML, where the files are read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.python import pieces, small_batches

#: Rows of a sheet that are shown (a fixed value).
SHEET_ROWS = 12


def _name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", "<br>").strip()


def _grid(rows: list[list[str]]) -> str:
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    full = [[_cell(c) for c in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [full[0], ["---"] * width, *full[1:]])


def _text(node: ET.Element) -> str:
    return "".join(n.text or "" if _name(n) == "t" else "\n" for n in node.iter() if _name(n) in ("t", "br"))


def docx(data: bytes) -> str:
    """Paragraphs and tables in the order of the document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(n for n in ET.fromstring(z.read("word/document.xml")) if _name(n) == "body")
    blocks = []
    for node in body:
        if _name(node) == "p":
            style = next((v for n in node.iter() if _name(n) == "pStyle" for v in n.attrib.values()), "")
            level = re.fullmatch(r"[Hh]eading ?(\d)", style)
            text = _text(node).strip()
            if text:
                blocks.append("#" * int(level[1]) + " " + text if level else text)
        elif _name(node) == "tbl":
            rows = [[_text(c) for c in row if _name(c) == "tc"] for row in node if _name(row) == "tr"]
            blocks.append(_grid(rows))
    return "\n\n".join(filter(None, blocks))


def _numbered(names: list[str], pattern: str) -> list[str]:
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))


def pptx(data: bytes) -> str:
    """A section for each slide: its first text as the title, the others below."""
    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for k, name in enumerate(_numbered(z.namelist(), r"ppt/slides/slide\d+\.xml"), 1):
            texts = [t for n in ET.fromstring(z.read(name)).iter() if _name(n) == "txBody" and (t := "\n".join(filter(None, (_text(p).strip() for p in n if _name(p) == "p"))))]
            parts.append("\n\n".join([f"## Slide {k}" + (f": {texts[0]}" if texts else ""), *texts[1:]]))
    return "\n\n".join(parts)


def xlsx(data: bytes, max_rows: int = SHEET_ROWS) -> str:
    """The first rows of each sheet as a table; a formula stands in where it has no value."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_text(n) for n in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [n.attrib["name"] for n in ET.fromstring(z.read("xl/workbook.xml")).iter() if _name(n) == "sheet"]
        parts = []
        for title, name in zip(titles, _numbered(names, r"xl/worksheets/sheet\d+\.xml")):
            rows = []
            for row in (n for n in ET.fromstring(z.read(name)).iter() if _name(n) == "row"):
                if len(rows) == max_rows:
                    break
                cells: list[str] = []
                for c in row:
                    column = 0
                    for letter in re.match(r"[A-Z]*", c.attrib.get("r", "")).group():
                        column = column * 26 + ord(letter) - 64
                    cells += [""] * (column - 1 - len(cells))
                    held = {_name(n): (_text(n) if _name(n) == "is" else n.text or "") for n in c}
                    value = held.get("v", held.get("is", "=" + held["f"] if "f" in held else ""))
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
                rows.append(cells)
            parts.append(f"## {title}\n\n{_grid(rows)}".rstrip())
    return "\n\n".join(parts)


READERS = {".docx": docx, ".pptx": pptx, ".xlsx": xlsx}


def convert(files: DataFrame) -> DataFrame:
    """``path, kind, md, error`` for rows of ``path, content``; a file that cannot be read has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for path, content in zip(*(c.to_pylist() for c in piece.columns)):
                kind = "." + path.rpartition(".")[2].lower()
                try:
                    rows.append((path, kind, READERS[kind](content), None))
                except Exception as e:  # one broken file must not end the scan
                    rows.append((path, kind, None, f"{type(e).__name__}: {e}"[:200]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["path", "kind", "md", "error"])

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, kind string, md string, error string")


def read_office(spark: SparkSession, folder: str) -> DataFrame:
    """All office files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,pptx,xlsx}").load(folder)
    return convert(files)
