"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lookup, materialise

#: Bits of a position inside a partition in ``monotonically_increasing_id``.
POSITION_BITS = 33
#: Newton steps of the dual at most; sources that have not converged by then are settled by the rounding.
MAX_STEPS = 60
#: A source has converged when its expected words are so near to its target, as a share of it (or a quarter of a word).
TOLERANCE = 1e-9
#: Sums over the histogram are of decimals, so that they do not depend on the order of rows and reruns agree.
FIXED = "decimal(30,6)"
#: Passes that spend what rounding left of a target on ever smaller documents.
REPAIRS = 4


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """``df``, written once in global order, with its position in it as ``rank``, from 0.

    What meets in one task is a count for each partition, not rows.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(sorted_rows).withColumn("part", F.shiftright("at", POSITION_BITS))
    counts = placed.groupBy("part").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("part", before.alias("before")))  # a row for each partition
    position = F.col("before") + F.col("at").bitwiseAND((1 << POSITION_BITS) - 1)
    return placed.join(offsets, "part").withColumn("rank", position).drop("part", "at", "before")


def token_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``source_key, source_size`` with ``target``: weights repeat along the code-point order of the keys.

    ``share`` of all words is dealt by weight; what a source cannot take, as it is beyond
    ``cap`` times its size, is dealt anew by weight among those below, until none is above.
    The level (words for a unit of weight) only rises, so it alone is carried from round
    to round; each round is one aggregate over the sources.
    """
    ranked = materialise(_ranked(sizes, [F.col("source_key") == "n", "source_key"]))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    level, seen = 0.0, -1
    while True:
        is_full = F.col("most") < F.col("weight") * level
        got = weighed.agg(
            F.sum("source_size").alias("words"),
            F.count_if(is_full).alias("full"),
            F.sum(F.when(is_full, F.col("most"))).alias("spent"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("open"),
        ).first()
        if got.full == seen or not got.open:
            break
        seen, level = got.full, (share * (got.words or 0) - (got.spent or 0.0)) / got.open
    return weighed.select("source_key", "source_size", "documents", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def entropy_rates(hist: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``hist`` (``source_key, size, n``) with the target and the ``rate`` of documents of a source and size.

    The rates are the nearest ones to 1 in relative entropy among those of at most
    ``cap`` whose expected words meet the targets.  Their dual is convex, with a
    multiplier ``tilt`` for each source: a rate is ``min(cap, exp(tilt * size / mean))``.
    Newton steps for all sources at once: an aggregate of the histogram gives gradient
    and curvature, a step that leaves the bracket becomes its midpoint.  Sources whose
    target is ``cap`` times their words have that rate throughout.
    """
    mean = F.col("source_size") / F.col("documents")
    is_open = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(cap))
    state = materialise(targets.select(
        "source_key", "target", "source_size", mean.alias("mean"), (~is_open).alias("done"),
        F.lit(0.0).alias("tilt"), (-700.0 * mean).alias("low"), (math.log(cap) * mean).alias("high"),
    ))
    for _ in range(MAX_STEPS):
        if state.where(~F.col("done")).isEmpty():
            break
        power = F.col("tilt") * F.col("size") / F.col("mean")
        is_capped = power >= math.log(cap)
        rate = F.when(is_capped, F.lit(float(cap))).otherwise(F.exp(power))
        words = F.col("n") * F.col("size")
        sums = hist.join(state.where(~F.col("done")), "source_key").groupBy("source_key").agg(
            F.sum((words * rate).cast(FIXED)).cast("double").alias("expected"), F.sum(F.when(~is_capped, (words * rate * F.col("size") / F.col("mean")).cast(FIXED))).cast("double").alias("slope")
        )
        over = F.col("expected") - F.col("target")
        stepped = state.join(sums, "source_key", "left").withColumns({
            "met": F.abs(over) <= F.greatest(F.col("target") * TOLERANCE, F.lit(0.25)),
            "low": F.when(over < 0, F.col("tilt")).otherwise(F.col("low")),
            "high": F.when(over > 0, F.col("tilt")).otherwise(F.col("high")),
            "newton": F.when(F.col("slope") > 0, F.col("tilt") - over / F.col("slope")),
        })
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        moved = F.when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        is_done = F.col("done") | F.col("met")
        state = materialise(stepped.select("source_key", "target", "source_size", "mean", is_done.alias("done"), F.when(is_done, F.col("tilt")).otherwise(moved).alias("tilt"), "low", "high"))
    capped = (F.col("target") > 0) & (F.col("target") >= F.col("source_size") * float(cap))
    rate = F.when(F.col("size") == 0, 1.0).when(capped, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))
    return hist.join(state, "source_key").select(*hist.columns, "source_size", "target", rate.alias("rate"))


def round_rates(rated: DataFrame, cap: int) -> DataFrame:
    """``rated`` with whole ``copies``, between 0 and ``cap * n``, for each source and size.

    Running expectations, from large documents to small ones, are rounded, so that the
    words of a source miss its target by about its largest document at most.  The rest
    goes, largest first, to sizes that fit into it, and what then remains to smaller ones.
    A window holds a source's distinct sizes: with D of them it has D * D / 2 words or more.
    """
    whole = Window.partitionBy("source_key")
    falling = whole.orderBy(F.desc("size"))
    upto, before = falling.rowsBetween(Window.unboundedPreceding, 0), falling.rowsBetween(Window.unboundedPreceding, -1)
    run = F.sum(F.when(F.col("size") > 0, F.col("n") * F.col("rate")).otherwise(0.0))
    sure = rated.withColumn("run", F.floor(run.over(upto) + 0.5)).withColumn("past", F.lag("run", 1, 0).over(falling))
    out = sure.withColumn("copies", F.when(F.col("size") == 0, F.col("n")).otherwise(F.greatest(F.lit(0), F.least(F.col("run") - F.col("past"), cap * F.col("n")))).cast("bigint"))
    for _ in range(REPAIRS):
        out = out.withColumn("left", F.round(F.col("target")).cast("bigint") - F.sum(F.col("copies") * F.col("size")).over(whole))
        room = F.when(F.col("left") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("left"))
        out = out.withColumn("room", F.when(fits, room).otherwise(0))
        gone = F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0))
        more = F.when(fits, F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("left") - gone) / F.col("size"))))).otherwise(0)
        out = out.withColumn("copies", (F.col("copies") + F.signum("left") * more).cast("bigint"))
    return out.drop("run", "past", "left", "room")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken, so that sources have their target shares of words.

    Sources, in code-point order with null last, have the ``weights`` in turn; together
    they take ``share`` times all words, none more than ``cap`` times its own.  Entropy
    balancing finds the rates: documents stay as near to being taken once as the targets
    allow, and no rate exceeds ``cap``.  Rates become whole copies for each source and
    size; of documents of one source and size those with the lowest hash of the id take
    the copy more, so that reruns agree.

    Returns ``id, source, size, source_size, target, rate, copies, taken`` for every row;
    ``taken`` is ``copies * size``.  A null text has no words; documents without words
    are taken once.  Null ids, repeated ids and equal rows are dealt copies like any
    others.  An empty table gives none; without any words all targets are 0.  Columns
    not named are not read.

    Texts are read once, for their sizes.  Newton and rounding work on the histogram of
    sizes for each source; only the last step touches documents again, as narrow rows in
    a global order, so that no source or size meets in one task.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    narrow = materialise(docs.select(F.col(id_col).alias("id"), key.alias("source_key"), word_count(F.col(text_col)).alias("size")).withColumn("row", F.monotonically_increasing_id()))
    hist = materialise(narrow.groupBy("source_key", "size").agg(F.count("*").alias("n")))
    sizes = hist.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("documents"))
    rated = entropy_rates(hist, materialise(token_targets(sizes, weights, share, cap)), cap)
    plan = round_rates(rated, cap)
    dealt = _ranked(narrow, ["source_key", "size", F.xxhash64("id"), "id", "row"])
    starts = dealt.groupBy("source_key", "size").agg(F.min("rank").alias("start"))
    groups = materialise(plan.join(starts, ["source_key", "size"]))
    found = lookup(dealt.select("id", "source_key", "size", "rank"), groups, ["source_key", "size"], "n", F.col("rank"))
    base, extra = F.expr("copies div n"), F.expr("copies % n")
    copies = base + F.when(F.col("rank") - F.col("start") < extra, 1).otherwise(0)
    source = F.when(F.col("source_key") != "n", F.substring("source_key", 2, 1 << 30))
    return found.withColumn("copies", copies).select(
        F.col("id").alias(id_col), source.alias(source_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
