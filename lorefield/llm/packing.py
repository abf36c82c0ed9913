"""Bounded-space online best-fit packing of token pieces into sequences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, small_batches
from .bpe import ChunkEncoder, SpecialSplitter, load_json_bpe


class LibraryEncoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    The file's merges are read as ranks where their order allows, which
    ``ByteBPE.from_json`` checks, so that chunks can be encoded once and kept.
    """

    def __init__(self, path: str, pattern: str):
        self.bpe = load_json_bpe(path, pattern)
        self.chunks, self.splitter = ChunkEncoder(self.bpe), SpecialSplitter(self.bpe.special)

    def encode(self, text: str) -> bytes:
        """Special strings are found first, as the library does by default."""
        first, *rest = self.splitter.parts(text)
        ids = self._plain(first)
        for special, part in zip(rest[::2], rest[1::2]):
            ids += np.array([self.bpe.special[special]], "<u4").tobytes() + self._plain(part)
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(self.chunks.packed(text)) if text else b""


class OpenBins:
    """At most ``max_open`` bins, found by free space in a bitset.

    Bit ``f`` of ``free`` is set while a bin with ``f`` tokens of space is open, so
    the tightest bin for a piece is the lowest set bit at or above its length, and
    the fullest bin, which closes first, is the lowest set bit of all.
    """

    def __init__(self, capacity: int, max_open: int, first_id: int = 0):
        self.capacity, self.max_open, self.next_id = capacity, max_open, first_id
        self.free, self.open, self.bins = 0, 0, [[] for _ in range(capacity + 1)]

    def _pop(self, space: int) -> int:
        bin_id = self.bins[space].pop()
        self.open -= 1
        if not self.bins[space]:
            self.free &= ~(1 << space)
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        """The sequence that takes the piece, and the place in it."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_id = self._pop(space)
        else:
            space, bin_id = self.capacity, self.next_id
            self.next_id += 1
        left = space - length
        if left:
            if self.open == self.max_open:
                self._pop((self.free & -self.free).bit_length() - 1)
            self.bins[left].append(bin_id)
            self.free |= 1 << left
            self.open += 1
        return bin_id, self.capacity - space


def _pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): all but the first fill a sequence."""
    n = len(ids) // 4
    head = n % capacity or min(n, capacity)
    yield 0, 0, head
    for k, start in enumerate(range(head, n, capacity), 1):
        yield k, start, capacity


def pack_best_fit(df: DataFrame, tokenizer_path: str, pattern: str, end_id: int, capacity: int = 1024, max_open: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs documents, each closed by ``end_id``, into sequences of ``capacity`` tokens.

    Online best-fit in bounded space: every task keeps at most ``max_open`` sequences
    open, puts a piece into the one it fits tightest, and when it must open one more
    it closes the fullest.  Within a block the pieces go longest first.  Only documents
    longer than a sequence are cut; their first piece takes the remainder so that the
    others fill sequences exactly.  Tasks need no exchange, and the same input split
    gives the same packing when a task runs again.

    Returns ``id, piece, start, length, ids`` (packed little-endian unsigned 32-bit),
    ``sequence_id, offset``.  A null or empty text is ``end_id`` alone; repeated rows
    are packed each for itself; an empty table gives none.  Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        encoder, end = LibraryEncoder(tokenizer_path, pattern), np.array([end_id], "<u4").tobytes()
        bins = OpenBins(capacity, max_open, TaskContext.get().partitionId() << 40)
        for ids, texts in blocks(batches):
            rows = []
            for k, text in enumerate(texts.to_pylist()):
                packed = (encoder.encode(text) if text else b"") + end
                rows += [(k, p, s, n, packed[4 * s : 4 * (s + n)]) for p, s, n in _pieces(packed, capacity)]
            rows.sort(key=lambda r: -r[3])
            places = [bins.put(r[3]) for r in rows]
            at, piece, start, length, data = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary()), pa.array([b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())],
                ["id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    small_batches(df.sparkSession)
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
