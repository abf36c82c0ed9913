"""Sharding along a Hilbert curve over quantised metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, materialise, shared_folder

#: Bits of a position inside a partition in ``monotonically_increasing_id``.
POSITION_BITS = 33


def _left(x, n) -> Column:
    return F.call_function("shiftleft", x if isinstance(x, Column) else F.lit(x), n if isinstance(n, Column) else F.lit(n))


def _right(x: Column, n) -> Column:
    return F.call_function("shiftright", x, n if isinstance(n, Column) else F.lit(n))


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a point with ``bits``-bit whole-number coordinates.

    The coordinates are an array that a fold over (bit, dimension) pairs changes
    step by step, first the exchanges and inversions of each level from the highest
    bit down, then Gray encoding, then the interleaving of the bits.
    """
    n = len(dims)
    point = F.array(*(d.cast("int") for d in dims))

    def swap(x, pair):
        level, k = _right(pair, 8), pair.bitwiseAND(0xFF)
        low = _left(F.lit(1), level) - 1
        own, first = F.get(x, k), F.get(x, F.lit(0))
        is_set = _right(own, level).bitwiseAND(1) == 1
        turned = (first.bitwiseXOR(own)).bitwiseAND(low)
        return F.when(is_set, F.transform(x, lambda v, i: F.when(i == 0, v.bitwiseXOR(low)).otherwise(v))).otherwise(
            F.transform(x, lambda v, i: F.when(i == 0, v.bitwiseXOR(turned)).when(i == k, v.bitwiseXOR(turned)).otherwise(v))
        )

    def fold(x: Column, pairs: list[int], step) -> Column:
        return F.aggregate(F.array(*map(F.lit, pairs)), x, step) if pairs else x

    x = fold(point, [(level << 8) + k for level in range(bits - 1, 0, -1) for k in range(n)], swap)
    x = fold(x, list(range(1, n)), lambda x, k: F.transform(x, lambda v, i: F.when(i == k, v.bitwiseXOR(F.get(x, k - 1))).otherwise(v)))

    def flip(x: Column) -> Column:
        """What Gray encoding inverts at the bits of all coordinates."""
        last = F.get(x, F.lit(n - 1))
        levels = F.array(*(F.lit(level) for level in range(bits - 1, 0, -1)))
        return let(last, lambda v: F.aggregate(levels, F.lit(0), lambda acc, level: F.when(_right(v, level).bitwiseAND(1) == 1, acc.bitwiseXOR(_left(F.lit(1), level) - 1)).otherwise(acc))) if bits > 1 else F.lit(0)

    def interleaved(x: Column) -> Column:
        pairs = F.array(*(F.lit((level << 8) + k) for level in range(bits - 1, -1, -1) for k in range(n)))

        def push(turn, acc, pair):
            bit = _right(F.get(x, pair.bitwiseAND(0xFF)).bitwiseXOR(turn), _right(pair, 8)).bitwiseAND(1)
            return _left(acc, 1).bitwiseOR(bit.cast("bigint"))

        return let(flip(x), lambda turn: F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, pair: push(turn, acc, pair)))

    return let(x, interleaved)


def _quantised(value: Column, low, high, bits: int) -> Column:
    """Equal steps between the least and the greatest value; null goes to 0."""
    top = (1 << bits) - 1
    if low is None or high <= low:
        return F.lit(0)
    return F.coalesce(F.least(F.floor((value.cast("double") - float(low)) / (float(high) - float(low)) * (top + 1)), F.lit(top)), F.lit(0)).cast("int")


def hilbert_shards(df: DataFrame, n_shards: int, numeric: list[str], categorical: list[str], bits: int = 6, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cuts rows, in Hilbert order of their metadata, into runs of equal count.

    ``numeric`` columns are quantised between their extremes, sizes by their
    logarithm, ``categorical`` ones by a hash.  Rows are sorted along the curve (ties
    by id, then by text), so that a shard covers a compact part of every dimension
    and readers can skip files by the ranges of several columns.  Rank ``r`` of ``N``
    goes to shard ``r * n_shards // N``: counts differ by one at most.

    Returns ``id, size, text_crc32, curve, shard, slot`` and the columns in ``carry``,
    with a slot for each row from 0 without gaps.  ``size`` is the text's UTF-8 bytes and ``overhead``; a null
    text has none, and CRC 0.  Nulls in metadata go to the first step.  Repeated rows
    get a slot each; an empty table gives none.  Columns not named are not read.

    The text is read once; what is sorted is a narrow table in the shared folder.
    The sort is by range over a unique key, so equal metadata spread over tasks.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint") + overhead
    crc = F.coalesce(F.crc32(F.encode(F.col(text_col).cast("string"), "UTF-8")), F.lit(0).cast("bigint"))
    narrow = df.select(
        F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"),
        *(F.col(c).cast("double").alias(f"n{k}") for k, c in enumerate(numeric)),
        *(F.coalesce(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << bits)), F.lit(0)).cast("int").alias(f"c{k}") for k, c in enumerate(categorical)),
        *(F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)),
    )
    narrow = materialise(narrow.withColumn("bulk", F.log2(F.col("size"))))
    measured = ["bulk", *(f"n{k}" for k in range(len(numeric)))]
    bounds = narrow.agg(F.count("*").alias("rows"), *(f(c).alias(f"{f.__name__}_{c}") for c in measured for f in (F.min, F.max))).first()
    dims = [_quantised(F.col(c), bounds[f"min_{c}"], bounds[f"max_{c}"], bits) for c in measured] + [F.col(f"c{k}") for k in range(len(categorical))]
    carried = [f"carry{k}" for k in range(len(carry))]
    keyed = narrow.select("id", "size", "text_crc32", hilbert_index(dims, bits).alias("curve"), *carried)
    order = ["curve", "id", "text_crc32", "size", *carried]
    placed = materialise(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", POSITION_BITS)
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        offsets.append((r.part, before))
        before += r.n
    offsets = F.broadcast(df.sparkSession.createDataFrame(offsets, "part bigint, before bigint"))
    total = F.lit(max(bounds["rows"], 1)).cast("bigint")
    ranked = placed.withColumn("part", part).join(offsets, "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << POSITION_BITS) - 1))
    shard = F.floor(F.expr(f"rank * {n_shards} div {max(bounds['rows'], 1)}")).cast("int")
    ranked = ranked.withColumn("shard", shard)
    start = F.expr(f"(cast(shard as bigint) * {max(bounds['rows'], 1)} + {n_shards - 1}) div {n_shards}")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "curve", "shard", (F.col("rank") - start).alias("slot"), *(F.col(x).alias(c) for x, c in zip(carried, carry)))


def write_shards(df: DataFrame, path: str, n_shards: int, numeric: list[str], categorical: list[str], bits: int = 6, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``df`` as one folder of Parquet files for each shard, in slot order.

    Rows are numbered first, in a table in the shared folder, and meet their places by
    that number, so rows that share an id, or are equal, are written once each.
    """
    spark = df.sparkSession
    row, staged = _unused("row", df.columns), shared_folder(spark, "numbered")
    df.withColumn(row, F.monotonically_increasing_id()).write.parquet(staged)
    numbered = spark.read.parquet(staged)
    placed = hilbert_shards(numbered, n_shards, numeric, categorical, bits, id_col, text_col, carry=(row,))
    held = numbered.join(placed.select(row, "shard", "slot"), row).drop(row)
    held.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _unused(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
