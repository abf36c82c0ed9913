"""Text of PDF files with a text layer, page by page, without a PDF library.

Objects, streams (plain or deflated) and the page tree are read; of the content of a
page only the operators that show text or move to another line.  Files that are
encrypted, keep their objects in streams or use fonts with maps of their own give the
pages they have and no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.python import pieces, small_batches

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = rb"(\d+)\s+\d+\s+R"
SHOWN = re.compile(rb"\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>|T[dDm*]|'|\"|ET|[A-Za-z*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode().ljust(2, "0"))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" and m[1] != b" " else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def _content(data: bytes) -> str:
    """Strings that are shown, a line for each move."""
    out: list[str] = []
    held: list[str] = []
    for m in SHOWN.finditer(data):
        token = m[0]
        if token[:1] in (b"(", b"<"):
            held.append(_string(token))
        elif token in (b"Tj", b"TJ"):
            out += held
            held = []
        elif token in (b"'", b'"'):
            out += ["\n", *held]
            held = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
            held = []
        else:
            held = []
    return re.sub(r"\n+", "\n", "".join(out)).strip("\n")


class Pdf:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-"):
            raise ValueError("no PDF header")
        self.size, self.objects = len(data), {int(n): body for n, body in OBJECT.findall(data)}
        trailer = data[data.rfind(b"trailer") :]
        self.root, self.info = (self._ref(trailer, key) for key in (b"Root", b"Info"))

    def _ref(self, body: bytes, key: bytes) -> bytes:
        m = re.search(rb"/" + key + rb"\s+" + REFERENCE, body)
        return self.objects.get(int(m[1]), b"") if m else b""

    def _stream(self, body: bytes) -> bytes:
        m = STREAM.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body else m[1]

    def pages(self, node: bytes | None = None) -> Iterator[bytes]:
        """Page objects in the order of the tree."""
        node = self._ref(self.root, b"Pages") if node is None else node
        kids = re.search(rb"/Kids\s*\[(.*?)\]", node, re.S)
        if kids is None:
            if re.search(rb"/Type\s*/Page\b", node):
                yield node
            return
        for n in re.findall(REFERENCE, kids[1]):
            yield from self.pages(self.objects.get(int(n), b""))

    def text(self, page: bytes) -> str:
        m = re.search(rb"/Contents\s*(?:\[(.*?)\]|" + REFERENCE + rb")", page, re.S)
        numbers = re.findall(REFERENCE, m[1]) if m and m[1] is not None else [m[2]] if m else []
        return _content(b"\n".join(self._stream(self.objects.get(int(n), b"")) for n in numbers))

    def title(self) -> str:
        m = re.search(rb"/Title\s*(\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>)", self.info, re.S)
        return _string(m[1]) if m else ""


#: What is told of each page.
FOUND = {"path": pa.string(), "page": pa.int32(), "text": pa.string(), "pages": pa.int32(), "title": pa.string(), "size": pa.int64(), "error": pa.string()}


def pdf_pages(files: DataFrame) -> DataFrame:
    """``path, page, text, pages, title, size, error`` of rows of ``path, content``: a row for each page, one for a file that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for path, content in zip(*(c.to_pylist() for c in piece.columns)):
                try:
                    pdf = Pdf(content)
                    pages = list(pdf.pages())
                    rows += [(path, k, pdf.text(page), len(pages), pdf.title(), pdf.size, None) for k, page in enumerate(pages, 1)]
                except Exception as e:  # one broken file must not end the scan
                    rows.append((path, None, None, 0, "", len(content), f"{type(e).__name__}: {e}"[:200]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), FOUND.values())], list(FOUND))

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, pages int, title string, size long, error string")


def read_pdf(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder)
    return pdf_pages(files)


def make_pdf(title: str, pages: list[list[str]]) -> bytes:
    """A plain file with a page for each list of lines; strings are UTF-16, every other page is deflated."""
    text = lambda s: b"<FEFF" + s.encode("utf-16-be").hex().upper().encode() + b">"
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages))) + b"] /Count %d >>" % len(pages), b"<< /Title " + text(title) + b" >>"]
    for k, lines in enumerate(pages):
        shown = b"BT /F1 10 Tf 40 800 Td\n" + b"\nT*\n".join(text(x) + b" Tj" for x in lines) + b"\nET"
        packed = zlib.compress(shown) if k % 2 else shown
        kind = b"/Filter /FlateDecode " if k % 2 else b""
        bodies += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * k), b"<< " + kind + b"/Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF\n"
