"""Repair of conversation structure by shortest paths over a grammar of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches
from .shared import lookup, materialise

WHITE = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the grammar ``(s?(ua)+)?``: nothing yet, after s, after u, after a.  What each role initial leads to.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The state that a new or changed turn leads to, and its role.
FILL, ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
KEEP, REROLE, DELETE, INSERT, UNMENDED = 0, 1, 2, 5, 5
LARGEST_STEP = max(REROLE + UNMENDED, INSERT, DELETE)
#: Cost of ending after the last row, from each state: nothing, or the turns that are still to be inserted.
ENDING = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 60
ENTERED_BY = {q: [p for p in range(4) if FILL[p] == q] for q in (2, 3)}
KEPT_BY = {c: {q: [p for p, t in steps.items() if t == q] for q in steps.values()} for c, steps in NEXT.items()}
#: Characters of text, and turns, in a piece of a conversation.
PIECE_CHARS, PIECE_TURNS = 1 << 20, 4096
#: Characters of text in an Arrow batch of results.
BATCH_CHARS = 4 << 20

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def dial(initials: list[str], faults: list[int], seeds: list[int]) -> list[int]:
    """Least costs from each node ``4 * row + state`` to the end, where state q costs ``seeds[q]`` more.

    Dial's queue: costs are small whole numbers, so nodes wait in a ring of buckets, one
    for each cost, and are settled from the end backwards, bucket by bucket.
    """
    n = len(initials)
    cost = [FAR] * (4 * (n + 1))
    known = [s for s in seeds if s < FAR]
    if not known:
        return cost
    now, width = min(known), max(known) - min(known) + LARGEST_STEP + 1
    ring: list[list[int]] = [[] for _ in range(width)]
    waiting = 0
    for q, s in enumerate(seeds):
        if s < FAR:
            cost[4 * n + q] = s
            ring[s % width].append(4 * n + q)
            waiting += 1
    while waiting:
        bucket = ring[now % width]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if cost[node] != now:
                continue  # it was settled at a lower cost
            row, q = divmod(node, 4)
            into = [(4 * row + p, INSERT) for p in ENTERED_BY.get(q, ())] if row < n else []
            if row:
                above, fault = 4 * (row - 1), faults[row - 1]
                into.append((above + q, DELETE))
                if fault in (SOUND, TRUNCATED):
                    extra = UNMENDED if fault == TRUNCATED else 0
                    into += [(above + p, KEEP + extra) for p in KEPT_BY.get(initials[row - 1], {}).get(q, ())]
                    into += [(above + p, REROLE + extra) for p in ENTERED_BY.get(q, ())]
            for before, step in into:
                if now + step < cost[before]:
                    cost[before] = now + step
                    ring[(now + step) % width].append(before)
                    waiting += 1
        now += 1
    return cost


def walk(initials: list[str], faults: list[int], cost: list[int], state: int) -> tuple[str, list[int], int]:
    """The ASCII-least letters along tight arcs from ``state`` before the first row; the states they lead to, and the last."""
    n, row, letters, states = len(initials), 0, [], []
    while row < n:
        now = cost[4 * row + state]
        extra = UNMENDED if faults[row] == TRUNCATED else 0
        usable = faults[row] in (SOUND, TRUNCATED)
        kept = NEXT.get(initials[row], {}).get(state)
        if cost[4 * row + 4 + state] + DELETE == now:
            letter, to, row = "D", state, row + 1
        elif cost[4 * row + FILL[state]] + INSERT == now:
            letter, to = "I", FILL[state]
        elif usable and kept is not None and cost[4 * row + 4 + kept] + KEEP + extra == now:
            letter, to, row = "K", kept, row + 1
        else:
            letter, to, row = "R", FILL[state], row + 1
        letters.append(letter)
        states.append(to)
        state = to
    return "".join(letters), states, state


@dataclass
class Run:
    """Consecutive rows of one conversation in one partition."""

    part: int
    key: str
    conv: object
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)

    @property
    def initials(self) -> list[str]:
        return [r[:1] for r in self.roles]

    def summary(self) -> dict:
        """What is added up over the runs of a conversation."""
        known = [t for t in self.turns if t is not None]
        pairs = self.initials
        return {
            "low": min(known, default=None), "high": max(known, default=None), "distinct": len(set(known)), "rows": len(self.roles),
            "first": pairs[0] if pairs else None, "last": pairs[-1] if pairs else None, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:])),
            "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(TRUNCATED),
        }


def added(one: dict, two: dict) -> dict:
    """The summary of two runs after each other."""
    if not one["rows"] or not two["rows"]:
        return one if one["rows"] else two
    out = {k: one[k] + two[k] for k in ("distinct", "rows", "illegal", "blank", "duplicate", "truncated")}
    out["distinct"] -= one["high"] is not None and one["high"] == two["low"]
    out["illegal"] += one["last"] + two["first"] not in ("su", "ua", "au")
    lows, highs = ([s[k] for s in (one, two) if s[k] is not None] for k in ("low", "high"))
    return out | {"low": min(lows, default=None), "high": max(highs, default=None), "first": one["first"], "last": two["last"]}


def counts_of(s: dict, cost: int) -> dict:
    gaps = s["high"] - s["low"] + 1 - s["distinct"] if s["low"] is not None else 0
    return {"gaps": gaps, "blank": s["blank"], "duplicate": s["duplicate"], "truncated": s["truncated"], "illegal": s["illegal"], "cost": cost}


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """The runs of a sorted partition, with the marks of a run's rows to know those that come again."""
    run, seen = None, set()
    for batch in batches:
        for part, key, conv, turn, role, text, kind, mark, later, gone in zip(*(batch.column(c).to_pylist() for c in STREAM)):
            if run is None or (run.key, run.part) != (key, part):
                if run is not None:
                    yield run
                run, seen = Run(part, key, conv), set()
            if not gone:
                run.roles.append(role)
                run.texts.append(text)
                run.turns.append(turn)
                run.faults.append(kind if kind == BLANK or not (later or mark in seen) else DUPLICATE)
                seen.add(mark)
    if run is not None:
        yield run


STREAM = ("part", "key", "conv", "turn", "role", "text", "kind", "mark", "later", "gone")
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def pieces(run: Run, counts: dict, letters: str, states: list[int], is_whole: bool) -> Iterator[dict]:
    """Rows of results: letters and repaired turns, in pieces of bounded size."""
    number, row, held, start, turns = 0, 0, 0, 0, []
    for at, (letter, state) in enumerate(zip(letters, states), 1):
        if letter == "I":
            turns.append((ROLE[state], ""))
        else:
            if letter != "D":
                turns.append((ROLE[state] if letter == "R" else run.roles[row], run.texts[row]))
                held += len(run.texts[row])
            row += 1
        if held >= PIECE_CHARS or at - start >= PIECE_TURNS:
            if at < len(letters):
                yield {"conv": run.conv, "part": run.part, "piece": number, "is_whole": False, "audit": letters[start:at], "turns": turns} | counts
                number, held, start, turns = number + 1, 0, at, []
    yield {"conv": run.conv, "part": run.part, "piece": number, "is_whole": is_whole and not number, "audit": letters[start:], "turns": turns} | counts


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + sum(len(t) for _, t in r["turns"])
        if size >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _ended(letters: str, states: list[int], state: int) -> tuple[str, list[int]]:
    """With the turns inserted after the last row."""
    while ENDING[state]:
        state = FILL[state]
        letters, states = letters + "I", [*states, state]
    return letters, states


def repair_conversations(df: DataFrame, gone: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits that give each conversation role initials ``(s?(ua)+)?``.

    Rows are taken by turn (nulls first; rows of one turn by role, then text).  A row's
    first fault counts: blank (white space only), duplicate (role and text of an earlier
    row), truncated (no ``.``, ``!`` or ``?`` at its end).  Blank and duplicate rows must go.
    Keep costs 0, Rerole 1, Delete 2, Insert 5, a truncated row that stays 5 more; of equally
    cheap repairs the one with the ASCII-least initials of edits is taken.  `dial` records
    the distances to the end, `walk` follows tight arcs from the start.

    Returns pieces of conversations, one for each but for long ones: ``conv_id, part,
    piece`` (their order), ``is_whole`` (it is all), the counts ``gaps, blank, duplicate, truncated,
    illegal, cost`` of the whole conversation, the piece's ``audit`` (initials of edits)
    and ``turns`` (repaired, as role and text).  `whole_conversations` joins pieces.

    A null role or text counts as one space, and a role with another initial cannot be
    kept.  A null id is a conversation like others.  Rows where ``gone`` holds are missing,
    but their conversations are returned, if need be without turns.  Equal rows are
    duplicates but for one.  An empty table gives none.  Other columns are not read.

    Rows are sorted by range over conversation, turn and a row number, once, with their
    texts.  A conversation with a third of all rows spreads over tasks: what is told again
    in a later one is found by an aggregate and a join of those conversations alone; each
    task then works out costs from every
    state to every state of the grammar across its run (16 numbers), the driver chains
    those of the runs that continue in another partition, and each run is walked from
    the state it is entered in.  What the driver gets is bounded by the number of partitions.
    """
    spark, kind = df.sparkSession, df.schema[conv_col].dataType.simpleString()
    small_batches(spark)
    rows = df.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("n")).alias("key"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), (F.lit(False) if gone is None else gone).alias("gone"),
    )
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    state = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    mark = F.unhex(F.sha2(F.encode(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256))
    marked = rows.select(
        "key", "conv", "turn", "role", F.when(~F.col("gone"), F.col("text")).alias("text"), F.when(~F.col("gone"), state).alias("kind"), mark.alias("mark"), "gone",
        F.left("text", F.lit(64)).alias("start"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["key", "turn", "role", "start", "mark", "row"]
    placed = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("start", "row").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    stream = materialise(placed)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        for batch in batches:
            if batch.num_rows:
                if part is None:
                    part, first = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
                last = batch.column(1)[batch.num_rows - 1].as_py()
        if part is not None:
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([first]), pa.array([last])], ["part", "first", "last"])

    ends = sorted(stream.select("part", "key").mapInArrow(edges, "part int, first string, last string").collect())  # a row for each partition
    crossing = {b.first for a, b in zip(ends, ends[1:]) if a.last == b.first}  # fewer than partitions
    schema = f"conv {kind}, part int, piece int, is_whole boolean, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, turns array<struct<role: string, text: string>>"
    arrow = pa.schema([("conv", pa.null()), ("part", pa.int32()), ("piece", pa.int32()), ("is_whole", pa.bool_()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("turns", TURNS)])

    def typed(batches: Iterator[pa.RecordBatch], results) -> Iterator[pa.RecordBatch]:
        """``results`` over the batches, in the type that conversations' ids have there."""
        first = next(batches, None)
        if first is not None:
            out = arrow.set(0, pa.field("conv", first.schema.field("conv").type))
            yield from _batched(results(b for bs in ([first], batches) for b in bs), out)

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for run in runs(batches):
            cost = dial(run.initials, run.faults, ENDING)
            letters, states = _ended(*walk(run.initials, run.faults, cost, 0))
            yield from pieces(run, counts_of(run.summary(), cost[0]), letters, states, True)

    span = F.col("key").isin(*crossing) if crossing else F.lit(False)
    out = stream.where(~span).withColumn("later", F.lit(False)).select(*STREAM).mapInArrow(lambda batches: typed(batches, mended), schema)
    if crossing:
        parts = _told_again(stream.where(span))
        found = _chained(parts)

        def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for run in runs(batches):
                counts, seeds, entry, is_last = found[run.key, run.part]
                letters, states, state = walk(run.initials, run.faults, dial(run.initials, run.faults, seeds), entry)
                if is_last:
                    letters, states = _ended(letters, states, state)
                yield from pieces(run, counts, letters, states, False)

        out = out.unionByName(parts.mapInArrow(lambda batches: typed(batches, continued), schema))
    return out.withColumnRenamed("conv", conv_col)


def _told_again(rows: DataFrame) -> DataFrame:
    """Rows of conversations that cross partitions, in their order, with whether role and text were there in a partition before."""
    told = rows.where(~F.col("gone")).groupBy("key", "mark").agg(F.min("part").alias("first"), F.max("part").alias("final"), F.count("*").alias("n"))
    firsts = materialise(told.where("final > first").drop("final"))
    marked = lookup(rows, firsts, ["key", "mark"], "n", F.col("at"))
    later = F.coalesce(F.col("part") > F.col("first"), F.lit(False))
    return materialise(marked.withColumn("later", later).repartition("part").sortWithinPartitions("at").select(*STREAM))


def _chained(parts: DataFrame) -> dict[tuple[str, int], tuple]:
    """For each run of a conversation that crosses partitions: counts, costs after it, the state it is entered in, whether it is the last."""
    alone = [[0 if q == p else FAR for q in range(4)] for p in range(4)]

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            ways = [dial(run.initials, run.faults, seeds)[:4] for seeds in alone]  # by exit, then entry
            s = run.summary()
            yield pa.record_batch([pa.array([run.key]), pa.array([run.part], pa.int32()), pa.array([[w for way in ways for w in way]], pa.list_(pa.int64())), *(pa.array([s[c]], t) for c, t in SUMMARY.items())], ["key", "part", "ways", *SUMMARY])

    names = {pa.int64(): "bigint", pa.string(): "string"}
    got = parts.mapInArrow(across, "key string, part int, ways array<bigint>, " + ", ".join(f"{c} {names[t]}" for c, t in SUMMARY.items())).collect()  # two rows for each partition at most
    runs_of: dict[str, list] = {}
    for r in sorted(got, key=lambda r: r.part):
        runs_of.setdefault(r.key, []).append(r)
    after, counts = {}, {}
    for key, own in runs_of.items():
        seeds, total = ENDING, None
        for r in own:
            s = {c: r[c] for c in SUMMARY}
            total = s if total is None else added(total, s)
        for r in reversed(own):
            after[key, r.part] = seeds
            seeds = [min(min(r.ways[4 * q + p] + seeds[q], FAR) for q in range(4)) for p in range(4)]
        counts[key] = counts_of(total, seeds[0])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            cost = dial(run.initials, run.faults, after[run.key, run.part])
            to = [walk(run.initials, run.faults, cost, p)[2] if cost[p] < FAR else p for p in range(4)]
            yield pa.record_batch([pa.array([run.key]), pa.array([run.part], pa.int32()), pa.array([to], pa.list_(pa.int32()))], ["key", "part", "to"])

    leads = {(r.key, r.part): r.to for r in parts.mapInArrow(exits, "key string, part int, to array<int>").collect()}
    found = {}
    for key, own in runs_of.items():
        entry = 0
        for r in own:
            found[key, r.part] = counts[key], after[key, r.part], entry, r is own[-1]
            entry = leads[key, r.part][entry]
    return found


SUMMARY = {"low": pa.int64(), "high": pa.int64(), "distinct": pa.int64(), "rows": pa.int64(), "first": pa.string(), "last": pa.string(), "illegal": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64()}


def whole_conversations(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_id``, counts, ``audit`` and ``repaired_sha256`` (of ``role:text`` lines) of the pieces of `repair_conversations`.

    Conversations in one piece are hashed where they are.  The hash of a longer one is
    sequential: its pieces stream in order through one task, which holds one of them.
    """
    spark = repaired.sparkSession
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    digest = F.when(F.col("is_whole"), F.sha2(F.encode(lines, "UTF-8"), 256))
    body = F.when(~F.col("is_whole") & (F.size("turns") > 0), lines)
    held = materialise(repaired.select(F.col(conv_col).alias("conv"), "part", "piece", "is_whole", *COUNTS, "audit", digest.alias("repaired_sha256"), body.alias("lines")))
    names = ["conv", *COUNTS, "audit", "repaired_sha256"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, letters, digest, started = None, [], None, False
        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv"), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for row in batch.to_pylist():
                if now is None or row["conv"] != now["conv"]:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([now | {"audit": "".join(letters), "repaired_sha256": digest.hexdigest()}], schema)
                    now, letters, digest, started = {c: row[c] for c in ("conv", *COUNTS)}, [], hashlib.sha256(), False
                letters.append(row["audit"])
                if row["lines"] is not None:
                    digest.update(("\n" if started else "").encode() + row["lines"].encode())
                    started = True
        if now is not None:
            yield pa.RecordBatch.from_pylist([now | {"audit": "".join(letters), "repaired_sha256": digest.hexdigest()}], schema)

    small_batches(spark)
    kind = held.schema["conv"].dataType.simpleString()
    long = held.where(~F.col("is_whole")).select("conv", "part", "piece", *COUNTS, "audit", "lines").repartition("conv").sortWithinPartitions("conv", "part", "piece")
    long = long.mapInArrow(hashed, f"conv {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string")
    return held.where("is_whole").select(names).unionByName(long).withColumnRenamed("conv", conv_col)


def damage_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults put into conversations, by the remainder of a row's CRC of ``conversation:turn`` (nulls: one space).

    Of 20 remainders 0 drops a row (it stays, marked in ``gone``), 1 empties its text, 2 removes
    its ``[.!?]``, 3 repeats it and 4 makes its role user.  Null roles and texts become one space.
    """
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)))
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (text_col, role_col))
    rows = df.select(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), F.pmod(F.crc32(F.encode(named, "UTF-8")), F.lit(20)).alias("fault"))
    damaged = rows.withColumns({
        text_col: F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(F.col(text_col), ".!?", "")).otherwise(F.col(text_col)),
        role_col: F.when(F.col("fault") == 4, "user").otherwise(F.col(role_col)),
    })
    repeated = damaged.withColumn("time", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return repeated.select(conv_col, turn_col, role_col, text_col, (F.col("fault") == 0).alias("gone"))
