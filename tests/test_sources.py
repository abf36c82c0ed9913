"""Headers of files, and folders that grow."""

import io
import os
import re

from pyspark.sql import functions as F

from lorefield.sources.headers import HEADER_BYTES, HeaderReader, headers, import_sidecars, read_header
from lorefield.sources.vault import write_files
from lorefield.streaming.increment import convert_new


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(min(n, 1000))  # an unbuffered file may give less than asked
        self.taken += len(got)
        return got


def test_no_more_than_the_header_is_read():
    for size in (0, 10, HEADER_BYTES, HEADER_BYTES + 1, 5 * HEADER_BYTES):
        f = Counted(b"x" * size)
        assert len(read_header(f)) == min(size, HEADER_BYTES) == f.taken


def test_bytes_read_of_files_of_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select(F.concat(F.lit("v/"), F.col("doc_id").cast("string"), F.lit(".pdf.md")).alias("path"), F.repeat("text", 40).alias("text"))
    assert write_files(rows, f"file://{tmp_path}") == docs.count()
    got = headers(spark, f"file://{tmp_path}").agg(F.sum("size").alias("all"), F.sum(F.octet_length("header")).alias("read"), F.max(F.octet_length("header")).alias("most")).first()
    sizes = [os.path.getsize(tmp_path / "v" / n) for n in os.listdir(tmp_path / "v")]
    assert got.all == sum(sizes) and got.read == sum(min(s, HEADER_BYTES) for s in sizes) < got.all and got.most == HEADER_BYTES


def test_filters_on_paths_are_taken_before_files_are_opened(spark, tmp_path):
    for name in ("a/x.pdf.md", "a/y.md", "b/x.pdf.md", ".git/z.pdf.md", "b/x.raw.md", "b/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"---\nderived_from_import: {name}\n---\n" if "y" in name else name)
    found = headers(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["x.pdf.md", "x.pdf.md", "x.raw.md", "y.md"]
    assert [p.paths for p in HeaderReader(str(tmp_path), "*.pdf.md", "/b/").partitions()] == [[str(tmp_path / "b/x.pdf.md")]]
    assert [r.name for r in headers(spark, str(tmp_path), pattern="y*").collect()] == ["y.md"]
    for part, names in (("a/", ["x.pdf.md", "y.md"]), ("b/", ["x.pdf.md", "x.raw.md"])):  # one DataFrame, filtered anew
        assert sorted(r.name for r in found.where(F.col("path").contains("/" + part)).collect()) == names
    assert sorted(r.name for r in import_sidecars(found).collect()) == ["x.pdf.md", "x.pdf.md", "y.md"]


def test_unreadable_bytes_and_empty_folders(spark, tmp_path):
    (tmp_path / "a.pdf.md").write_bytes(b"\xff\xfe ok")
    assert import_sidecars(headers(spark, str(tmp_path))).first().text.endswith(" ok")
    (tmp_path / "empty").mkdir()
    assert headers(spark, str(tmp_path / "empty")).count() == 0


def test_two_runs_over_a_growing_folder_equal_one_batch(spark, tmp_path):
    schema, source = "k int, v string", f"file://{tmp_path}/in"
    convert = lambda rows: rows.withColumn("v", F.upper("v"))
    run = lambda name: convert_new(spark, source, schema, f"file://{tmp_path}/{name}/out", f"file://{tmp_path}/{name}/progress", "k", "v", convert)
    drop = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{name}")
    drop("1", [(1, "a"), (2, "b"), (2, "a")])
    first = sorted(map(tuple, run("grown").select("k", "v").collect()))
    assert first == [(1, "A"), (2, "A")]
    assert sorted(map(tuple, run("grown").select("k", "v").collect())) == first  # nothing is new
    drop("2", [(2, "z"), (3, "c")])
    grown = sorted(map(tuple, run("grown").select("k", "v").collect()))
    assert grown == [(1, "A"), (2, "A"), (3, "C")] == sorted(map(tuple, run("once").select("k", "v").collect()))


def test_a_batch_that_is_done_again_adds_nothing(spark, tmp_path):
    import shutil

    schema, source, out = "k int, v string", f"file://{tmp_path}/in", tmp_path / "out"
    spark.createDataFrame([(1, "a")], schema).write.parquet(source)
    run = lambda: convert_new(spark, source, schema, f"file://{out}", f"file://{tmp_path}/progress", "k", "v", lambda rows: rows)
    run()
    for name in ("0", ".0.crc"):
        (tmp_path / "progress/commits" / name).unlink(missing_ok=True)  # as after a failure before the commit
    assert [tuple(r) for r in run().select("k", "v").collect()] == [(1, "a")]
    shutil.rmtree(out)


def _large_files(spark, suffix: str):
    """256 files of 1 MB in one task, in a session that allows large batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
    return spark.range(0, 256, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(suffix)).alias("path"), F.repeat(F.lit("a"), 1 << 20).cast("binary").alias("content"))


def _own_mb() -> str:
    with open("/proc/self/smaps_rollup") as f:
        return str(int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) >> 10)


def test_office_reader_holds_little_at_a_time(spark, monkeypatch):
    from lorefield.sources import office

    own_mb = _own_mb
    monkeypatch.setitem(office.READERS, ".held", lambda data: own_mb())
    got = [int(r.md) for r in office.convert(_large_files(spark, ".held")).collect()]
    assert len(got) == 256 and max(got) < 150


def test_pdf_reader_holds_little_at_a_time(spark, monkeypatch):
    from lorefield.sources import pdf

    own_mb = _own_mb

    class Held:
        size, pages, title, text = 1, lambda self: [b""], lambda self: "", lambda self, page: own_mb()

        def __init__(self, data):
            pass

    monkeypatch.setattr(pdf, "Pdf", Held)
    got = [int(r.text) for r in pdf.pdf_pages(_large_files(spark, ".pdf")).collect()]
    assert len(got) == 256 and max(got) < 150
