"""Exact deduplication over an extendible-hash index on shared files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import HOT_SHARE, shared_folder

#: Runs that are not one plain space already; replacing only these gives the same text with few matches.
WHITE_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
#: The directory has 2 ** MAX_DEPTH slots at most; buckets are so large that it is not reached but by skewed hashes.
MAX_DEPTH = 20
#: Keys of so many rows or fewer are never hot, however small the table.
COLD_ROWS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_RUNS, " ")


def double_directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, dict[int, tuple[int, int]]]:
    """Extendible hashing over a histogram of ``max_depth``-bit key prefixes.

    Begins with one bucket.  A bucket over ``capacity`` splits by its next bit; when
    it already uses all bits of the directory, the directory doubles.  Returns the
    directory's depth and, for each slot, the bucket's (local depth, prefix).
    Buckets at ``max_depth`` stay as they are and chain their entries.
    """
    size = [0] * (1 << max_depth)
    for prefix, n in counts.items():
        size[prefix] = n
    held = [size]  # held[k][p]: entries below prefix p of max_depth - k bits
    while len(held[-1]) > 1:
        held.append([a + b for a, b in zip(held[-1][::2], held[-1][1::2])])
    depth, directory = 0, {0: (0, 0)}
    full = [(0, 0)]
    while full:
        local, prefix = full.pop()
        if held[max_depth - local][prefix] <= capacity or local == max_depth:
            continue
        if local == depth:
            directory = {2 * slot + bit: bucket for slot, bucket in directory.items() for bit in (0, 1)}
            depth += 1
        for half in (2 * prefix, 2 * prefix + 1):
            for slot in range(half << (depth - local - 1), (half + 1) << (depth - local - 1)):
                directory[slot] = (local + 1, half)
            full.append((local + 1, half))
    return depth, directory


def _bucket_rows(total: int, partitions: int) -> int:
    """Rows of a bucket at most: several buckets a task on small tables, and 2 ** 16 buckets on the largest."""
    return max(64, total >> 16, min(1 << 15, total // (16 * partitions)))


def build_index(df: DataFrame, path: str, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes an extendible-hash index of whole normalised texts below ``path`` and returns its entries.

    1. Rows are counted by key, a 64-bit hash of the text; no text moves.
    2. The directory begins with one slot.  A bucket of more than ``capacity`` rows
       splits by the next leading bit of the key, and the directory doubles where the
       bucket already uses all of its bits.  It is written to ``path/directory``:
       ``slot, bucket, depth``.
    3. Rows go to their buckets' owners by the slot of their key.  An owner has whole
       key ranges, orders each bucket by key and text, and compares the bytes of texts
       with equal keys; different ones are links of the key's chain (``chain``).
       Copies of keys that hold 1/HOT_SHARE of all rows are merged before they move.

    Entries, in ``path/index``: ``bucket, key, chain, sha, id, keep_id, group_size,
    merged``; one for each row, or, where ``merged``, one for all copies of a hot text.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("key", F.xxhash64("norm"))
    rows.groupBy("key").agg(F.count("*").alias("n")).write.parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    capacity = capacity or _bucket_rows(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    is_hot = (F.col("n") * HOT_SHARE >= total) & (F.col("n") > COLD_ROWS)
    hot = keys.where(is_hot).select("key", F.lit(True).alias("hot"))  # HOT_SHARE rows at most
    bits = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(total, 1) / capacity))) + 3)
    slot = lambda depth: F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
    counted = keys.groupBy(slot(bits).alias("slot")).agg(F.sum(F.when(is_hot, 1).otherwise(F.col("n"))).alias("n"))
    depth, directory = double_directory({r.slot: r.n for r in counted.collect()}, capacity, bits)  # 2 ** bits rows at most
    slots = spark.createDataFrame([(s, prefix << (depth - local), local) for s, (local, prefix) in sorted(directory.items())], "slot int, bucket int, depth int")
    slots.write.parquet(f"{path}/directory")
    slots = F.broadcast(slots.select("slot", "bucket"))
    marked = rows.join(F.broadcast(hot), "key", "left")
    single = marked.where("hot is null").select("key", "norm", "id", F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("merged"))
    copies = marked.where("hot").groupBy("key", "norm").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("key", "norm", "id", "n", F.lit(True).alias("merged"))
    owned = single.union(copies).withColumn("slot", slot(depth)).join(slots, "slot").drop("slot").repartition("bucket")
    chain, same = W.partitionBy("bucket", "key").orderBy("norm"), W.partitionBy("bucket", "key", "norm")
    entries = owned.select(
        "bucket", "key", (F.dense_rank().over(chain) - 1).alias("chain"), F.unhex(F.sha2("norm", 256)).alias("sha"), "id",
        F.min("id").over(same).alias("keep_id"), F.sum("n").over(same).alias("group_size"), "merged",
    )
    entries.write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def probe_index(spark: SparkSession, df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, keep_id, group_size`` of whole texts by an index written before; nulls for texts that it lacks.

    The leading bits of a text's key give its slot and bucket; in the bucket its chain
    is met by key and SHA-256 of the bytes.  A null text counts as empty; repeated rows
    each get a row; an empty table gives none; other columns are not read.
    """
    directory = spark.read.parquet(f"{path}/directory")
    depth = directory.count().bit_length() - 1
    norm = normalised(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(norm).alias("key"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    rows = rows.withColumn("slot", F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)).join(F.broadcast(directory.select("slot", "bucket")), "slot")
    groups = spark.read.parquet(f"{path}/index").select("bucket", "key", "sha", "keep_id", "group_size").distinct()
    return rows.join(groups, ["bucket", "key", "sha"], "left").select(F.col("id").alias(id_col), "keep_id", "group_size")


def exact_dedup(df: DataFrame, path: str | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Marks the copies among whole texts that are equal once white-space runs are one space.

    Builds the index below ``path`` (by default a new folder in the shared one); the
    owners of its buckets decide.  Rows whose copies were merged take the answer of
    their entry.  Returns ``id, keep_id, group_size, kept, text_sha256``, one row for
    each row of ``df``.  A null text counts as empty; of repeated rows with the smallest
    id each is kept, as none has a smaller one; a null id is never kept in place of
    another, and is its group's only if all ids are null.  An empty table gives none;
    other columns are not read.
    """
    index = build_index(df, path or shared_folder(df.sparkSession, "exact-dedup"), capacity, id_col, text_col)
    found = index.where("not merged").select("id", "keep_id", "group_size", "sha")
    entries = index.where("merged").select("key", "sha", "keep_id", "group_size")
    n = entries.count()
    if n:
        norm = normalised(F.col(text_col))
        rows = df.select(F.col(id_col).alias("id"), F.xxhash64(norm).alias("key"), norm.alias("norm"))
        keys = entries.select("key").distinct()  # hot keys: HOT_SHARE at most
        rows = rows.join(F.broadcast(keys), "key", "left_semi").select("id", "key", F.unhex(F.sha2("norm", 256)).alias("sha"))
        # as many entries as hot keys, but where hashes collide
        found = found.union(rows.join(F.broadcast(entries) if n <= 8 * HOT_SHARE else entries, ["key", "sha"]).select("id", "keep_id", "group_size", "sha"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
