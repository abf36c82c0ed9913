"""Token counts by prefix dynamic programming; byte-level BPE as a tree reduction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, small_batches
from .bpe import PrefixCounter, SpecialSplitter, TreeEncoder, load_bpe, load_prefix_counter
from .shared import shared_folder


def _ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The only two columns that leave the JVM; nothing else is read or can clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def prefix_tables(df: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The exact token count at every prefix of whole texts.

    For every match of the split pattern a dynamic program over its bytes gives the
    count at each prefix: the last token of a prefix is the one token that may follow
    the last token of a shorter prefix.  A text's table is made of those of its matches.

    Returns ``id, n_bytes, width, steps``: ``steps`` holds for each code point the change
    of the count, as little-endian numbers of ``width`` bytes (one, or two where a step
    needs them), so that running sums are the counts.  Special strings of the tokenizer
    file count as one token each, as its library has them by default, and as ordinary
    text where a prefix ends inside one.  A null text counts as empty; repeated rows
    each get a row; an empty table gives an empty result; other columns are not read.
    Narrow: one pass, no shuffle, and memory for one block of texts.
    """

    def run(batches):
        counter = load_prefix_counter(tokenizer_path, pattern)
        splitter = SpecialSplitter(counter.bpe.special)
        for ids, texts in blocks(batches):
            sizes, widths, tables = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), [], []
            for steps in block_steps(counter, splitter, [t or "" for t in texts.to_pylist()]):
                narrow = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
                widths.append(1 if narrow else 2)
                tables.append((steps.astype(np.int8) if narrow else steps.astype("<i2")).tobytes())
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(widths, pa.int8()), pa.array(tables, pa.binary())], ["id", "n_bytes", "width", "steps"])

    kind = df.schema[id_col].dataType.simpleString()
    return _ids_and_texts(df, id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes bigint, width tinyint, steps binary").withColumnRenamed("id", id_col)


def _last_cut(text: str) -> int:
    """Where the last chunk of a text begins: before the last space that a non-space follows."""
    at = len(text)
    while (at := text.rfind(" ", 0, at)) >= 0:
        if text[at + 1 : at + 2].strip():
            return at
    return 0


def block_steps(counter: PrefixCounter, splitter: SpecialSplitter, texts: list[str]) -> list[np.ndarray]:
    """For each text the changes of the count from each prefix to the next, special strings included."""
    split = [splitter.parts(t) for t in texts]
    plain = iter(counter.block([p for parts in split for p in parts[::2]]))
    out = []
    for parts in split:
        found = [next(plain)]
        for before, special in zip(parts[::2], parts[1::2]):
            tail = before[_last_cut(before) :]  # cut short, the special string is ordinary text that goes on from here
            inside = counter.steps(tail + special[:-1])[len(tail) :]
            found += [inside, np.array([1 - int(inside.sum())], np.int16), next(plain)]
        out.append(np.concatenate(found) if len(found) > 1 else found[0])
    return out


def write_prefix_tables(df: DataFrame, tokenizer_path: str, pattern: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``prefix_tables`` as a table in the shared folder, from which any number of budgets can be answered."""
    spark = df.sparkSession
    path = path or shared_folder(spark, "prefix-tables")
    prefix_tables(df, tokenizer_path, pattern, id_col, text_col).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def token_budgets(tables: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """Token counts and truncation from prefix tables alone; no text is read.

    Returns ``id, n_bytes, n_tokens, cut_chars``: ``n_tokens`` is the last running sum of
    a text's steps, ``cut_chars`` the most code points that cost at most ``limit`` tokens.
    """

    def run(batches):
        for ids, sizes, widths, steps in blocks(batches, 3):
            counts, cuts = [], []
            for width, packed in zip(widths.to_pylist(), steps):
                counts_at = np.cumsum(np.frombuffer(packed.as_buffer(), np.int8 if width == 1 else "<i2"), dtype=np.int64)
                n = int(counts_at[-1]) if len(counts_at) else 0
                counts.append(n)
                fits = len(counts_at) if n <= limit else int((np.flatnonzero(counts_at <= limit)[-1:] + 1).sum())
                cuts.append(fits)
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(counts, pa.int64()), pa.array(cuts, pa.int64())], ["id", "n_bytes", "n_tokens", "cut_chars"])

    kind = tables.schema[id_col].dataType.simpleString()
    rows = tables.select(F.col(id_col).alias("id"), "n_bytes", "width", "steps")
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, cut_chars bigint").withColumnRenamed("id", id_col)


def encode_tree(df: DataFrame, ranks_path: str, pattern: str, leaf_chars: int = 2048, decode: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte-level BPE ids of whole texts, and the bytes the ids decode to.

    A text is halved down to leaves of ``leaf_chars``; neighbours join by encoding a
    growing window around their boundary again, until the tokens outside cannot
    change.  Decoding concatenates decoded leaves up the same kind of tree.

    Returns ``id, ids`` (packed little-endian unsigned 32-bit) and ``decoded``.  Null
    texts count as empty and give empty binaries; repeated rows each get a row; an
    empty table gives an empty result; other columns are not read.  One narrow pass.
    """

    def run(batches):
        encoder = TreeEncoder(load_bpe(ranks_path, pattern), leaf_chars)
        for ids, texts in blocks(batches):
            packed = [encoder.encode(t) if t else b"" for t in texts.to_pylist()]
            columns = [ids, pa.array(packed, pa.binary())]
            if decode:
                columns.append(pa.array([encoder.decode(p) for p in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    return _ids_and_texts(df, id_col, text_col).mapInArrow(run, f"id {kind}, ids binary" + ", decoded binary" * decode).withColumnRenamed("id", id_col)
