"""Exact Jaccard join of shingle sets in metric space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches
from .graph import components
from .shared import HOT_SHARE, lookup, materialise, shared_folder
from .shingles import parity_gap, set_blocks, set_digests, set_parity

#: A region of more rows is split by Voronoi cells of its own pivots, and so on.
LEAF_ROWS = 4096
#: Pivots of such a region, and how often its cells are split again at most.
PIVOTS, LEVELS = 8, 6
#: A cell that no pivot divides is split into a grid of blocks that together hold all its pairs.
CELL_ROWS = 4096
#: Bits of a shingle that name its region.  Two shingles of one name make a region with more pairs to tell apart;
#: a set that has both is a member once, by the one that comes first in its order, which leaves more pairs open.
REGION_BITS = 44
#: A shingle of more texts is a hot one: its region is gathered in parts of about so many.
PART_ROWS = 1 << 16
#: Pairs that a task holds before it hands them on.
HELD_PAIRS = 1 << 18
#: Partners that are checked against one copy of a pivot's text.
HUB_ROWS = 256


def _kept(size: np.ndarray | int, num: int, den: int):
    """How many elements, in the common order, a partner within the radius must meet: n - ceil(t n) + 1."""
    return size - -(-size * num // den) + 1


def _narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))


def _sketch_bits(rows: int) -> int:
    """Counters grow with the table, from 2**20 to 2**24; what is broadcast is 32 MB at most."""
    return int(np.clip(np.ceil(np.log2(max(rows, 1))) + 2, 20, 24))


#: Counts are kept as their logarithms, so that 16 bits hold them in order up to 2 ** 32.
LOG_STEPS = 2047


def _coded(counts: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(counts + 1.0) * LOG_STEPS).astype(np.uint16)


def _describe(docs: DataFrame, bits: int, path: str) -> tuple[DataFrame, np.ndarray]:
    """Sizes, digests and parities of all sets, and coded counts of their shingles in a table of ``2 ** bits`` counters."""

    def run(batches):
        seen = np.zeros(1 << bits, np.uint32)
        for (ids, keys), sets in set_blocks(batches):
            digest = set_digests(sets)
            for s in sets:
                seen[s >> np.uint64(64 - bits)] += 1  # a slot that two shingles of one text share counts once
            columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), keys, pa.array(map(set_parity, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], _DESCRIBED)
        part = 1 << 16
        for k in range(0, 1 << bits, part):
            if seen[k : k + part].any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 5 + [pa.nulls(1, pa.binary()), pa.array([k // part], pa.int32()), pa.array([seen[k : k + part].tobytes()])], _DESCRIBED)

    docs.mapInArrow(run, "id bigint, n bigint, h1 bigint, h2 bigint, text_key bigint, parity binary, part int, counts binary").write.option("compression", "zstd").parquet(path)
    both = docs.sparkSession.read.parquet(path)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(c, np.uint32).astype(np.uint64)
                total[k] = total[k] + got if k in total else got
        for k, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_coded(np.minimum(c, (1 << 32) - 2)).tobytes()])], ["part", "counts"])

    table = np.zeros(1 << bits, np.uint16)
    parts = both.where("part is not null").select("part", "counts").repartition("part")
    for r in parts.mapInArrow(add, "part int, counts binary").collect():  # 2 ** bits counters in all
        table[r.part << 16 : (r.part + 1) << 16] = np.frombuffer(r.counts, np.uint16)
    return both.where("part is null").select("id", "n", "h1", "h2", "text_key", "parity"), table


_DESCRIBED = ["id", "n", "h1", "h2", "text_key", "parity", "part", "counts"]


def _entries(docs: DataFrame, counts: np.ndarray, copies: dict[tuple[int, int], int], num: int, den: int) -> DataFrame:
    """``s, part, digest, id, n, pos``: each set in the regions it can share with a partner.

    A pivot is a set of one shingle; with shingles weighted by rarity its Voronoi cell
    holds the sets whose rarest shingle it is.  A set misses its first ``k`` shingles
    only with partners at a distance of ``k / |union|`` or more, so the window of a
    set reaches as many cells, in order of rarity, as keep that within the radius.
    Members of a hot cell are dealt to parts by their digests; ``part`` is -1 elsewhere.
    """
    context = docs.sparkSession.sparkContext
    shared, hot = context.broadcast(counts), context.broadcast(copies)
    bits = int(np.log2(len(counts)))
    # a counter adds up shingles that share it, so a hot one stands out from the mean of all
    hot_from = max(PART_ROWS, 4 * float(np.exp2(counts / LOG_STEPS).mean()))

    def run(batches):
        counts, kept = shared.value, hot.value
        for (ids, _), sets in set_blocks(batches):
            digest = set_digests(sets)
            out = []
            for doc, d, d2, s in zip(ids.to_pylist(), digest[:, 0].tolist(), digest[:, 1].tolist(), sets):
                if not len(s) or kept.get((d, d2), doc) != doc:
                    continue
                common = counts[s >> np.uint64(64 - bits)]
                order = np.argsort(common.astype(np.uint64) << np.uint64(48) | s >> np.uint64(16), kind="stable")[: _kept(len(s), num, den)]
                size = np.exp2(common[order] / LOG_STEPS)
                part = np.where(size > hot_from, d % np.ceil(size / PART_ROWS).astype(np.int64), -1)
                out.append((s[order] >> np.uint64(64 - REGION_BITS), part, np.full(len(order), d), np.full(len(order), doc), np.full(len(order), len(s)), np.arange(len(order))))
            if out:
                s, part, d, doc, n, pos = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(d.astype(np.int64)), pa.array(doc.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))], ["s", "part", "digest", "id", "n", "pos"])

    return docs.mapInArrow(run, "s bigint, part int, digest bigint, id bigint, n int, pos int")


def _runs(batches, keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that rows with equal first ``keys`` columns stay together."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        n = len(columns[0])
        if not n:
            continue
        same = np.ones(n, bool)
        for c in columns[:keys]:
            same &= c == c[-1]
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        held = [c[cut:] for c in columns]
        if cut:
            yield [c[:cut] for c in columns]
    if held is not None and len(held[0]):
        yield held


def _bounds(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def _regions(entries: DataFrame, path: str) -> DataFrame:
    """``s, id, n, pos, pivot``: members of the regions of two different sets or more.

    Of equal sets the least id stands for all.  A region's own pivot is its most
    central member: the one that has the shared shingle earliest for its size.
    Parts of a hot region are gathered apart, and its pivot is found by an aggregate.
    """

    def run(batches):
        for s, part, digest, ids, n, pos in _runs(batches, 2):
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != s[:-1]) | (part[1:] != part[:-1]) | (digest[1:] != digest[:-1])  # sorted by id, then place: the first is the least
            s, part, ids, n, pos = s[keep], part[keep], ids[keep], n[keep], pos[keep]
            edge = _bounds(s, part)
            size = np.diff(edge)
            many = np.repeat(size > 1, size) | (part >= 0)
            if not many.any():
                continue
            s, part, ids, n, pos = s[many], part[many], ids[many], n[many], pos[many]
            edge = _bounds(s, part)
            central = np.lexsort((ids, pos / n, part, s))  # regions stay where they are, their members go by centrality
            pivot = np.repeat(ids[central[edge[:-1]]], np.diff(edge))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s, ids, n, pos, pivot, part >= 0)], ["s", "id", "n", "pos", "pivot", "hot"])

    sorted_ = entries.repartition("s", "part").sortWithinPartitions("s", "part", "digest", "id", "pos")
    sorted_.mapInArrow(run, "s bigint, id bigint, n int, pos int, pivot bigint, hot boolean").write.parquet(path)
    regions = entries.sparkSession.read.parquet(path)
    cold, hot = regions.where("not hot").drop("hot"), regions.where("hot").select("s", "id", "n", "pos")
    if hot.isEmpty():
        return cold
    pivots = hot.groupBy("s").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("at"), "id")).alias("first"), F.count("*").alias("m")).where("m > 1")
    return cold.union(hot.join(pivots.select("s", F.col("first.id").alias("pivot")), "s").select("s", "id", "n", "pos", "pivot"))


def _possible(na, ia, nb, ib, num: int, den: int):
    """Whether sizes and places in the order leave room for the overlap that the threshold asks for."""
    need = -(-num * (na + nb) // (num + den))
    return (np.minimum(na - ia, nb - ib) >= need) & (np.minimum(na, nb) * den >= num * np.maximum(na, nb))


#: Bits of the filter of named texts at most: 16 MB.
FILTER_BITS = 27


def _named_texts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``id, text`` of the ids in ``named``, which is read twice.

    A filter with 32 bits or more for each name (eight where FILTER_BITS allows no more), sized
    by their number, lets hardly any other text leave its task; names beyond what FILTER_BITS
    can tell apart are not filtered but joined at once.
    """
    spark = docs.sparkSession
    texts, count = docs.select("id", "text"), named.count()
    least = max(16, int(np.ceil(np.log2(max(count, 1)))) + 3)
    if least <= FILTER_BITS:
        bits = min(FILTER_BITS, least + 2)
        slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits) + 1
        maps = named.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()  # 2 ** bits bits in all
        shared = spark.sparkContext.broadcast({r.k: bytes(r.bits) for r in maps})

        def pick(batches):
            table = np.zeros((1 << bits) // 8 + 8192, np.uint8)
            for k, b in shared.value.items():  # bucket k, counted from 1, holds positions from (k - 1) * 32768 + 1 on
                table[(k - 1) * 4096 : k * 4096] = np.frombuffer(b, np.uint8)
            for batch in batches:
                bucket, place = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                at = (bucket - 1) * 32768 + place
                held = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                got = batch.select([0, 1]).filter(pa.array(held.astype(bool)))
                if len(got):
                    yield got

        marked = docs.withColumn("slot", slot).select("id", "text", F.bitmap_bucket_number("slot").alias("k"), F.bitmap_bit_position("slot").alias("place"))
        texts = marked.mapInArrow(pick, "id bigint, text string")
    path = shared_folder(spark, "jaccard-texts")
    texts.join(named, "id", "left_semi").dropDuplicates(["id"]).write.parquet(path)
    return spark.read.parquet(path)


def _near_parities(sizes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that the parities of their sets leave open, so that few texts move that are not linked.

    Two sets differ in as many elements as their parities differ in bits, or in more; those that
    are linked differ in ``na + nb - 2 need`` elements at most, so no linked pair is left out.
    """
    sets = sizes.select("id", "n", "parity").dropDuplicates(["id"])
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("parity").alias(f"p{side}")), side)
    need = F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / (num + den))
    asked = pairs.select("a", "b", (F.col("na") + F.col("nb") - 2 * need).alias("most"), "pa", "pb")

    def run(batches):
        for batch in batches:
            most, left, right = (batch.column(k).to_pylist() for k in (2, 3, 4))
            yield batch.select([0, 1]).filter(pa.array([parity_gap(x, y) <= m for m, x, y in zip(most, left, right)], pa.bool_()))

    return asked.mapInArrow(run, "a bigint, b bigint")


def _verify(docs: DataFrame, sizes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b, inter, na, nb, linked`` by the whole sets of both texts, for the pairs that parities leave open.

    A pivot with many partners is copied to one group for each HUB_ROWS.
    """
    pairs = materialise(_near_parities(sizes, pairs, num, den))
    texts = _named_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    partners = pairs.groupBy("a").agg(F.count("*").alias("m")).withColumn("groups", F.ceil(F.col("m") / HUB_ROWS))
    dealt = pairs.join(partners, "a").withColumn("g", F.pmod(F.xxhash64("b"), F.col("groups")))
    right = dealt.select("a", "g", F.col("b").alias("id")).join(texts, "id").select("a", "g", F.lit(1).alias("role"), "id", "text")
    left = dealt.select("a", "g").distinct().withColumn("id", F.col("a")).join(texts, "id").select("a", "g", F.lit(0).alias("role"), "id", "text")
    return materialise(_distances(left.union(right), "a", "g").select(F.col("pivot").alias("a"), F.col("id").alias("b"), "inter", "na", "nb", (den * F.col("inter") >= num * (F.col("na") + F.col("nb") - F.col("inter"))).alias("linked")))


def _distances(rows: DataFrame, *group: str) -> DataFrame:
    """``key, pivot, id, inter, na, nb``: overlaps of each member (role 1) with the pivots (role 0) of its group.

    ``rows`` has the two columns ``group``, and ``role, id, text``.  A task holds the
    pivots of one group; members stream past them.
    """

    def run(batches):
        own, pivots = None, []
        for (a, g, role, ids), sets in set_blocks(batches, 4):
            out = []
            for x, y, kind, b, s in zip(a.to_pylist(), g.to_pylist(), role.to_pylist(), ids.to_pylist(), sets):
                if own != (x, y):
                    own, pivots = (x, y), []
                if kind == 0:
                    pivots.append((b, s))
                else:
                    out += [(x, p, b, len(np.intersect1d(whole, s, assume_unique=True)), len(whole), len(s)) for p, whole in pivots]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "pivot", "id", "inter", "na", "nb"])

    sorted_ = rows.select(*group, "role", "id", "text").repartition(*group).sortWithinPartitions(*group, "role", "id")
    return sorted_.mapInArrow(run, "key bigint, pivot bigint, id bigint, inter bigint, na bigint, nb bigint")


def _labelled(regions: DataFrame, labels: DataFrame) -> DataFrame:
    return regions.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _mixed(marked: DataFrame) -> DataFrame:
    """``s, m``: regions that still hold several components, with their rows."""
    return marked.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low <> high").select("s", "m")


def _split(docs: DataFrame, regions: DataFrame, labels: DataFrame, links: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Joins regions over LEAF_ROWS recursively; returns leaves, labels and links.

    A level takes up to PIVOTS members of each region, from different components, and
    measures all members against them by whole sets; those within the radius are linked
    through them.  A member belongs to the cell of its nearest pivot.  Two members within
    the radius ``r`` have distances from any pivot that differ by ``r`` at most, so one
    that is nearest to its own pivot by ``d`` also goes, as a boundary document, to the
    cells of the pivots within ``d + 2 r``: there it meets every partner that lives in
    them.  Cells that still hold several components are regions of the next level, unless
    they are small enough or hardly smaller than what they came from.
    """
    radius = 1 - num / den
    leaves, level = None, 0
    parts = regions.select("s", "id", "n", "pos", F.lit(True).alias("own"), F.lit(-1.0).alias("far"), F.lit(None).cast("bigint").alias("whole"))
    while True:
        marked = _labelled(parts, labels)
        mixed = materialise(_mixed(marked))
        marked = marked.join(mixed, "s")
        splits = (F.col("m") > LEAF_ROWS) & (F.col("whole").isNull() | (F.col("m") * 10 < F.col("whole") * 8)) if level < LEVELS else F.lit(False)
        done = marked.where(~splits).select("s", "id", "n", "pos", "own", "far", "m")
        leaves = done if leaves is None else leaves.union(done)
        large = materialise(marked.where(splits))
        if large.isEmpty():
            return leaves, labels, links
        buckets = large.withColumn("b", F.pmod(F.xxhash64("label", F.lit(level)), F.lit(PIVOTS)))
        pivots = buckets.groupBy("s", "b").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("at"), "id")).alias("first")).select("s", F.col("first.id").alias("pivot"))
        pivots = materialise(pivots)
        texts = _named_texts(docs, large.select("id").distinct())
        groups = F.ceil(F.col("m") / HUB_ROWS)
        members = large.withColumn("g", F.pmod(F.xxhash64("id"), groups)).select("s", "g", F.lit(1).alias("role"), "id").join(texts, "id").select("s", "g", "role", "id", "text")
        copies = large.select("s", groups.alias("groups")).distinct().join(pivots, "s").withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
        centres = copies.select("s", "g", F.lit(0).alias("role"), F.col("pivot").alias("id")).join(texts, "id").select("s", "g", "role", "id", "text")
        union = F.col("na") + F.col("nb") - F.col("inter")
        found = materialise(_distances(centres.union(members), "s", "g").select(F.col("key").alias("s"), "pivot", "id", (1 - F.col("inter") / union).alias("far"), (den * F.col("inter") >= num * union).alias("linked")))
        links = links.union(found.where("linked and pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        labels = components(links.distinct())
        homes = found.groupBy("s", "id").agg(F.min(F.struct("far", "pivot")).alias("home"))
        near = found.select("s", "pivot", "id", "far").join(homes, ["s", "id"]).where(F.col("far") <= F.col("home.far") + 2 * radius + 1e-9)
        near = near.join(large.select("s", "id", "n", "pos", F.col("m").alias("whole")), ["s", "id"])
        cell = F.xxhash64("s", "pivot")  # two cells of one number only add pairs to measure
        parts = near.select(cell.alias("s"), "id", "n", "pos", (F.col("pivot") == F.col("home.pivot")).alias("own"), "far", "whole")
        level += 1


def _open_pairs(leaves: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: pairs of a leaf that no chain of links has joined so far and no window parts.

    Members carry their distance from the leaf's pivot, -1 where it is not known.  Two
    whose distances from it differ by more than the radius are farther apart than the
    radius.  Leaves over CELL_ROWS are dealt to cells for every two blocks of members.
    """
    rows = _labelled(leaves, labels).withColumn("blocks", F.ceil(F.col("m") / CELL_ROWS).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select("s", F.least("block", "other").alias("ci"), F.greatest("block", "other").alias("cj"), "block", "id", "n", "pos", "label", "far", "own")
    radius = 1 - num / den + 1e-9

    def unique(found):
        pairs = np.unique(np.stack(list(map(np.concatenate, zip(*found)))), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches):
        found, held = [], 0
        for s, ci, cj, block, ids, n, pos, label, far, own in _runs(batches, 3):
            edge = _bounds(s, ci, cj)
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                for i in range(x, y - 1):
                    j = np.arange(i + 1, y)
                    open_ = (label[j] != label[i]) & ((ci[i] == cj[i]) | (block[j] != block[i])) & (own[j] | own[i]) & _possible(n[i], pos[i], n[j], pos[j], num, den)
                    open_ &= (far[i] < 0) | (far[j] < 0) | (np.abs(far[j] - far[i]) <= radius)
                    if open_.any():
                        j = j[open_]
                        found.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
                        held += len(j)
                        if held > HELD_PAIRS:
                            yield unique(found)
                            found, held = [], 0
        if found:
            yield unique(found)

    sorted_ = cells.repartition("s", "ci", "cj").sortWithinPartitions("s", "ci", "cj", "id")
    return sorted_.mapInArrow(run, "a bigint, b bigint").distinct()


def jaccard_components(df: DataFrame, num: int = 75, den: int = 100, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links texts whose 5-word shingle sets have a Jaccard similarity of ``num / den`` or more.

    1 - Jaccard is a metric, of radius ``1 - num / den`` here.

    1. Sets of one shingle are the pivots of the first Voronoi diagram, with shingles
       weighted by rarity.  Sets of texts are nearly all at distance 1 from each other,
       so whole texts would be pivots that tell nothing apart at this level.  Each set
       goes to its own cell and, as a boundary document, to those in its window.
    2. Inside a region the most central text is the next pivot.  Members that sizes and
       places let be within the radius, and whose parities do not tell them apart
       (``_near_parities``), are measured against it by their whole sets.
    3. Regions that still hold several components are joined again.  Those over LEAF_ROWS
       are split by Voronoi cells of their own texts, with windows for boundary documents,
       level by level (``_split``); in what is left, pairs that the triangle inequality,
       sizes, places, components and parities leave open are measured by their whole sets.

    Returns ``id, n_shingles, component_id`` (the least id reachable by links) for each
    row, and with ``digest`` ``text_key``, the xxhash64 of the text (null: empty), by which
    rows that share an id are told apart.  Equal sets are one node and need no measuring.
    A text without words (null and empty ones too) has 0 shingles and is linked with
    nothing.  Rows with null ids, or with one id and different texts, are numbered first
    and linked by their own texts; a component without an id has a null one.  An empty
    table gives none; other columns are not read.
    """
    small_batches(df.sparkSession)
    docs = _narrow(df, id_col, text_col)
    root = shared_folder(df.sparkSession, "jaccard")
    rows = docs.count()
    sizes, counts = _describe(docs, _sketch_bits(rows), f"{root}/sets")
    ids = sizes.groupBy("id").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d"))
    keep = ["n_shingles", "component_id"] + ["text_key"] * digest
    if ids.where("id is null or a <> b or c <> d").isEmpty():
        return _joined(docs, sizes, counts, root, rows, num, den).select(F.col("id").alias(id_col), *keep)
    docs.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{root}/numbered")
    numbered = df.sparkSession.read.parquet(f"{root}/numbered")
    sizes, counts = _describe(numbered.select(F.col("row").alias("id"), "text", "text_key"), _sketch_bits(rows), f"{root}/numbered-sets")
    found = _joined(numbered.select(F.col("row").alias("id"), "text", "text_key"), sizes, counts, f"{root}/by-row", rows, num, den)
    found = found.withColumnsRenamed({"id": "row", "component_id": "component"}).join(numbered.select("row", "id"), "row")
    least = found.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("copies"))
    least.write.parquet(f"{root}/least")
    return lookup(found, df.sparkSession.read.parquet(f"{root}/least"), ["component"], "copies", F.col("row")).select(F.col("id").alias(id_col), *keep)


def _joined(docs: DataFrame, sizes: DataFrame, counts: np.ndarray, root: str, rows: int, num: int, den: int) -> DataFrame:
    """``id, n_shingles, component_id, text_key``; ids are not null, and rows of one id have one set."""
    spark = docs.sparkSession
    classes = sizes.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    classes.write.parquet(f"{root}/classes")
    classes = spark.read.parquet(f"{root}/classes")
    hot = {(r.h1, r.h2): r.first for r in classes.where(F.col("copies") * HOT_SHARE >= max(rows, 1)).select("h1", "h2", F.col("first")).collect()}  # HOT_SHARE rows at most
    regions = _regions(_entries(docs, counts, hot, num, den), f"{root}/regions")
    centres = regions.where("id = pivot").select("s", F.col("n").alias("pn"), F.col("pos").alias("pp"))
    need = F.ceil(F.lit(num) * (F.col("n") + F.col("pn")) / (num + den))
    fits = (F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("pp")) >= need) & (F.least("n", "pn") * den >= F.greatest("n", "pn") * num)
    stars = materialise(regions.where("id <> pivot").join(centres, "s").where(fits).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    checked = _verify(docs, sizes, stars, num, den)
    links = checked.where("linked").select("a", "b")
    labels = components(links)
    mixed = materialise(_mixed(_labelled(regions, labels)))
    small = regions.join(mixed.where(F.col("m") <= LEAF_ROWS), "s")
    known = checked.select(F.col("a").alias("pivot"), F.col("b").alias("id"), (1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("far"))
    far = F.when(F.col("id") == F.col("pivot"), 0.0).otherwise(F.coalesce("far", F.lit(-1.0)))
    leaves = small.join(known, ["pivot", "id"], "left").select("s", "id", "n", "pos", F.lit(True).alias("own"), far.alias("far"), "m")
    if not mixed.where(F.col("m") > LEAF_ROWS).isEmpty():
        more, labels, links = _split(docs, regions.join(mixed.where(F.col("m") > LEAF_ROWS).select("s"), "s", "left_semi"), labels, links, num, den)
        leaves = leaves.union(more)
    left = materialise(_open_pairs(leaves, labels, num, den))
    if not left.isEmpty():
        more = _verify(docs, sizes, left, num, den).where("linked").select("a", "b")
        labels = components(links.union(more))
    return _with_labels(sizes, classes, labels)


def _with_labels(sizes: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Components of all rows: by the row that stands for its set, then by that row's label."""
    groups = classes.join(labels, classes["first"] == labels["node"], "left").select("h1", "h2", F.coalesce("label", "first").alias("group"), "copies")
    path = shared_folder(sizes.sparkSession, "jaccard-groups")
    groups.write.parquet(path)
    rows = lookup(sizes, sizes.sparkSession.read.parquet(path), ["h1", "h2"], "copies", F.col("id"))
    single = labels.select(F.col("node").alias("id"), "label")
    out = rows.join(single, "id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("group", "label", "id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_key")
