"""Document fingerprints from closed syncmers over words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import let

#: A longer run without white space counts as unspaced text.
UNSPACED = 64
#: Buckets of ids at most, so that their bounds fit in an expression.
MAX_BUCKETS = 10_000


def words_of(text: Column) -> Column:
    """Words between white space; each code point is one in runs of more than UNSPACED.

    Each run is told from its own length, so an edit changes the words of its own run only.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    long = lambda w: F.char_length(w) > UNSPACED
    cut = lambda w: F.when(long(w), F.split(w, "")).otherwise(F.array(w))
    return let(words, lambda ws: F.when(F.exists(ws, long), F.flatten(F.transform(ws, cut))).otherwise(ws))


def closed_syncmers(text: Column, k: int = 6, s: int = 2) -> Column:
    """Anchors ``(hash, at)``, in order: the ``k``-word runs whose least ``s``-word run is their first or last.

    ``at`` is the number of the run's first word.  Whether a run is chosen depends on its
    own words only, so an edit changes no choice beyond ``k`` words from it.  A text of
    which no run is chosen, as all of fewer than ``k`` words and some of up to
    ``2k - s - 2``, has one anchor for all of it; one without a word has none.
    """
    last = k - s
    anchor = lambda h, at: F.struct(h.alias("hash"), at.alias("at"))

    def anchors(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(s))))
        edge = lambda o, i: F.least(F.get(o, i), F.get(o, i + last))
        between = lambda o, i: F.least(edge(o, i), *(F.get(o, i + j) for j in range(1, last)))
        chosen = let(inner, lambda o: F.filter(F.sequence(F.lit(0), F.size(h) - k), lambda i: edge(o, i) <= between(o, i)))
        none = F.array().cast("array<struct<hash:bigint,at:int>>")
        runs = F.when(F.size(h) >= k, F.transform(chosen, lambda i: anchor(F.xxhash64(*(F.get(h, i + j) for j in range(k))), i))).otherwise(none)
        return let(runs, lambda r: F.when((F.size(r) == 0) & (F.size(h) > 0), F.array(anchor(F.xxhash64(h), F.lit(0)))).otherwise(r))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), anchors)


def placed(anchors: Column) -> Column:
    """A number for each anchor and its distance in words from the anchor before it.

    Two texts that share a passage have the same numbers in it wherever it stands.
    """
    return let(anchors, lambda a: F.transform(a, lambda x, i: F.xxhash64(x["hash"], x["at"] - F.get(a, i - 1)["at"])))


def likeness(a: Column, b: Column) -> Column:
    """Anchors that match by place over anchors in either, 0 to 1; 1 for two empty ones.

    An anchor matches where the other text has the same one at the same distance from
    the anchor before it, so equal words that only occur here and there do not count.
    """

    def compare(p: Column) -> Column:
        x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - n))

    return F.when(a == b, F.lit(1.0)).otherwise(let(F.array(placed(a), placed(b)), compare))


def fingerprint_text(anchors: Column) -> Column:
    """Anchors in order, each by the low 32 bits of its hash and its place, in hexadecimal."""
    code = lambda a: F.concat(F.lpad(F.lower(F.hex(a["hash"].bitwiseAND(0xFFFFFFFF))), 8, "0"), F.lit("@"), F.lower(F.hex(a["at"])))
    return F.array_join(F.transform(anchors, code), " ")


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, less one, by halving."""
    table = F.array(*(F.lit(b).cast("bigint") for b in bounds))
    step = F.array(*(F.lit(1 << j) for j in range(max(1, len(bounds)).bit_length() - 1, -1, -1)))
    found = let(table, lambda t: F.aggregate(step, F.lit(-1), lambda at, j: F.when((at + j < len(bounds)) & (F.get(t, at + j) <= value), at + j).otherwise(at)))
    return F.greatest(F.coalesce(found, F.lit(0)), F.lit(0))


def with_next(df: DataFrame, derive: dict[str, Column], rows_per_bucket: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, next`` and, for each derived column ``c``, ``c`` and ``next_c``.

    Each row has the text of the next one by ascending id, the last one the first's.
    Derived columns are computed once for each row, after the exchange.

    Ids are cut into ranges by percentiles; each range is ordered on its own, and the
    first row of a range also goes, as a guest, to the range before, so one exchange
    of the texts is enough and none is ordered as a whole.  Rows with one id follow
    each other in an order of their own; null ids come first.
    """
    ids = df.agg(F.count("*").alias("n"), F.max(F.col(id_col)).alias("top")).first()
    n_buckets = max(1, min(MAX_BUCKETS, -(-ids.n // rows_per_bucket)))
    low = -(1 << 63)
    bounds = [low]
    if n_buckets > 1 and ids.top is not None:
        shares = [k / n_buckets for k in range(1, n_buckets)]
        bounds += sorted({int(v) for v in df.agg(F.percentile_approx(id_col, shares, 10 * MAX_BUCKETS)).first()[0]})
    id_, text = F.coalesce(F.col(id_col).cast("bigint"), F.lit(low)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = df.agg(F.min(id_)).first()[0]
    own = df.select(F.col(id_col).alias("id"), id_.alias("place"), text.alias("text")).withColumn("own", _bucket(F.col("place"), bounds))
    # the least row of all is also the guest of the last range
    starts = F.array(*(F.lit(b).cast("bigint") for b in bounds))
    before = F.when((F.col("own") > 0) & (F.get(starts, F.col("own")) == F.col("place")), F.col("own") - 1)
    wraps = F.when(F.col("place") == F.lit(first), F.lit(len(bounds) - 1))
    held = own.withColumn("guest", F.explode(F.array_compact(F.array(F.lit(-1), before, F.when(wraps.isNotNull(), -2 - wraps)))))
    held = held.withColumn("bucket", F.when(F.col("guest") == -1, F.col("own")).when(F.col("guest") < -1, -2 - F.col("guest")).otherwise(F.col("guest")))
    rank = F.when(F.col("guest") == -1, 0).when(F.col("guest") >= 0, 1).otherwise(2)
    follow = W.partitionBy("bucket").orderBy(rank, "place", F.xxhash64("text"))
    held = held.repartition("bucket").withColumns(derive)
    ahead = {f"next_{c}": F.lead(c).over(follow) for c in derive}
    return held.withColumns({"next": F.lead("text").over(follow)} | ahead).where("guest = -1").select("id", "text", "next", *derive, *ahead)


def fingerprint_pairs(df: DataFrame, k: int = 6, s: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts, of edited ones, and their likeness.

    The edited text has its last half replaced by as much of the next document's
    beginning.  Returns ``id, text, edited, anchors, edited_anchors, next_anchors``.
    Null texts count as empty and repeated rows each get a row; equal texts have equal
    anchors; an empty table gives none; other columns are not read.
    """
    pairs = with_next(df, {"anchors": closed_syncmers(F.col("text"), k, s)}, id_col=id_col, text_col=text_col)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.char_length("text") - half), F.left("next", half))
    return pairs.withColumn("edited", edited).withColumn("edited_anchors", closed_syncmers(F.col("edited"), k, s)).select("id", "text", "edited", "anchors", "edited_anchors", "next_anchors")
