"""WARC archives: records written by a text sink, read back by verified boundary chains."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lookup, materialise, shared_folder

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
#: What a revisit of an equal payload names as its profile (a fixed value of the format).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def deduplicate_payloads(pages: DataFrame, path: str, min_bytes: int, id_col: str, payload_col: str) -> DataFrame:
    """``id, url…, digest, refers_to``: of equal payloads of ``min_bytes`` or more, the least id is the response."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.withColumn("payload", payload).withColumn("n_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    groups = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    groups.write.parquet(path)  # its size on disk decides whether it is broadcast
    return lookup(rows, pages.sparkSession.read.parquet(path), ["digest"], "copies", F.col(id_col))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 100, records_per_file: int = 4096, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: datetime | None = None) -> None:
    """Writes one record for each row to files of at most ``records_per_file`` records.

    Blocks end with a blank line, which is the sink's row separator, so records are
    written by Spark's own text writer, where the rows are.  Copies of a response are
    revisit records without a block that refer to it.  A null payload is empty.  ``date``
    is when the pages were taken, for all of them the time of writing if none is given.
    The block of a response is the payload alone, without a message around it, and its
    type is that of the payload.
    """
    at = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("body"))
    found = deduplicate_payloads(rows, f"{path}-copies", min_bytes, "id", "body")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("id"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        F.lit(f"WARC-Date: {at}\r\n"),
        _header("WARC-Target-URI", F.col("url")),
        F.when(revisit, F.lit(f"WARC-Profile: {SAME_PAYLOAD}\r\n")).otherwise(F.lit("")),
        F.when(revisit, _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BLANK), block,
    )
    found.select(record.alias("value")).write.option("lineSep", BLANK).option("maxRecordsPerFile", records_per_file).text(path)


def _field(header: Column, name: str, value: str) -> Column:
    got = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*({value})[ \t]*(?:\r\n|$)", 1)
    return F.when(got != "", got)


def verified_starts(candidates: DataFrame) -> DataFrame:
    """``file, start`` of the candidates that a chain of successors reaches from the start of their file.

    Pointer jumping: each round adds what the present pointers reach and makes the
    pointers twice as long, so the rounds number the logarithm of the longest chain.
    Only offsets move; each round is cut off in the shared folder.
    """
    jump = materialise(candidates.select("file", "start", F.col("next").alias("target")).join(candidates.select("file", F.col("start").alias("target")), ["file", "target"]))
    reached = materialise(candidates.where("start = 0").select("file", "start"))
    n = reached.count()
    while True:
        onward = jump.join(reached, ["file", "start"]).select("file", F.col("target").alias("start"))
        reached = materialise(reached.union(onward).distinct())
        now = reached.count()
        if now == n:
            return reached
        n = now
        further = jump.select("file", F.col("start").alias("target"), F.col("target").alias("end"))
        jump = materialise(jump.join(further, ["file", "target"]).select("file", "start", F.col("end").alias("target")))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: ``id, url, type, refers_to, digest, payload_bytes, payload_sha256``.

    Tasks cut their splits at the magic string and read a header after each; that
    gives candidates, and from their lengths the offset at which the next record
    should start.  Offsets come from running sums over one file's lengths.  Only
    candidates on the chain from the file's start are records: a magic string inside
    a payload is not on it.  Payloads are hashed where they are read; the few that
    hold the magic string themselves are put together in a second reading.  A file
    whose chain does not reach its end is an error.
    """
    from pyspark.sql import Window as W

    scan = spark.read.option("lineSep", MAGIC).text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("raw"), "value")
    # a header is of any length; its fields hold no line break, so its end is in the chunk it starts in
    header = F.when(F.contains("value", F.lit(BLANK)), F.substring_index("value", BLANK, 1)).otherwise(F.lit(""))
    head = F.octet_length(header)
    length = F.try_to_number(F.coalesce(_field(header, "Content-Length", "[0-9]{1,17}"), F.lit("-1")), F.lit("S99999999999999999")).cast("bigint")
    complete = F.col("size") >= F.col("head") + 4 + F.col("length")
    body = F.when((F.col("length") >= 0) & complete, F.sha2(F.substring(F.col("raw"), F.col("head") + 5, F.col("length").cast("int")), 256))
    page = r"<urn:page:(-?[0-9]+)>"
    chunks = scan.withColumn("header", header).withColumn("head", head.cast("bigint")).withColumn("size", F.octet_length("raw").cast("bigint")).withColumn("length", length)
    chunks = chunks.select(
        "file", "block", "row", "size", "head", "length", body.alias("payload_sha256"), _field(F.col("header"), "WARC-Type", r"[^\r\n]*").alias("type"), _field(F.col("header"), "WARC-Target-URI", r"[^\r\n]*").alias("url"),
        F.regexp_extract(F.coalesce(_field(F.col("header"), "WARC-Record-ID", r"[^\r\n]*"), F.lit("")), page, 1).alias("id"), F.regexp_extract(F.coalesce(_field(F.col("header"), "WARC-Refers-To", r"[^\r\n]*"), F.lit("")), page, 1).alias("refers_to"),
        F.regexp_extract(F.coalesce(_field(F.col("header"), "WARC-Payload-Digest", r"[^\r\n]*"), F.lit("")), "sha256:([0-9a-f]{64})", 1).alias("digest"),
    )
    order = W.partitionBy("file").orderBy("block", "row").rowsBetween(W.unboundedPreceding, -1)
    mark = len(MAGIC)
    placed = chunks.withColumn("start", F.coalesce(F.sum(F.col("size") + mark).over(order), F.lit(0)) - mark)
    placed = materialise(placed.withColumn("next", F.when(F.col("length") >= 0, F.col("start") + mark + F.col("head") + 4 + F.col("length") + 4)))
    starts = verified_starts(placed.where("start >= 0 and next is not null").select("file", "start", "next"))
    records = placed.join(starts, ["file", "start"])
    ends = placed.groupBy("file").agg(F.max(F.col("start") + mark + F.col("size")).alias("end"))
    broken = ends.join(records.groupBy("file").agg(F.max("next").alias("reached")), "file", "left").where("reached is null or reached <> end").count()
    if broken:
        raise ValueError(f"{broken} of the files below {path} have records that no chain from their start to their end reaches")
    if records.where("payload_sha256 is null").isEmpty():
        whole = records.withColumn("sha", F.col("payload_sha256"))
    else:
        # chunks between the record and its successor, their bytes put back around the magic strings
        open_ = records.where("payload_sha256 is null").select("file", F.col("start").alias("first"), "next", "head", "length")
        parts = placed.select("file", "block", "row", F.col("start").alias("at")).join(open_, "file").where("at >= first and at < next")
        bytes_ = parts.join(scan.select("file", "block", "row", "raw"), ["file", "block", "row"]).groupBy("file", "first", "head", "length").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("list"))
        joined = F.aggregate("list", F.lit(b""), lambda acc, p: F.concat(acc, F.lit(MAGIC.encode()), p["raw"]))
        glued = bytes_.select("file", F.col("first").alias("start"), F.sha2(F.substring(joined, F.col("head") + 4 + mark + 1, F.col("length").cast("int")), 256).alias("glued"))
        whole = records.join(glued, ["file", "start"], "left").withColumn("sha", F.coalesce("payload_sha256", "glued"))
    return whole.select(F.expr("try_cast(id as bigint)").alias("id"), "url", "type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"), "digest", F.col("length").alias("payload_bytes"), F.col("sha").alias("payload_sha256"))


def archive_round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives of ``pages``, reads them back and follows the revisits.

    Returns ``id, payload_bytes, payload_digest, record_type, refers_to``; bytes and
    digest are of the full payload, for revisits by way of the response.  A revisit
    finds its response by id and digest, so rows that share an id are told apart.  Of
    repeated rows each is a record: those with the smallest id are all responses.  Null
    ids are never responses in place of others; null payloads are empty ones; an empty
    table gives none; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_warc(pages, path, id_col=id_col, url_col=url_col, payload_col=payload_col)
    records = materialise(read_warc(spark, path))
    revisits = records.where("type = 'revisit'")
    wanted = revisits.groupBy("refers_to", "digest").agg(F.count("*").alias("copies"))
    full = records.where("type = 'response'").groupBy(F.col("id").alias("refers_to"), F.col("payload_sha256").alias("digest")).agg(F.max("payload_bytes").alias("full_bytes"))
    full.join(wanted, ["refers_to", "digest"]).write.parquet(f"{path}-full")
    followed = lookup(revisits, spark.read.parquet(f"{path}-full"), ["refers_to", "digest"], "copies", F.col("id"))
    as_row = lambda n, sha: [F.col("id").alias(id_col), n.alias("payload_bytes"), sha.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"]
    own = records.where("type = 'response'").select(*as_row(F.col("payload_bytes"), F.col("payload_sha256")))
    return own.union(followed.select(*as_row(F.col("full_bytes"), F.col("digest"))))
