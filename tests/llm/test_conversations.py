"""Repair of conversations against a plain search over all edits, also when conversations cross partitions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lorefield.llm import conversations
from lorefield.llm.conversations import ENDING, damage_conversations, dial, repair_conversations, walk, whole_conversations
from lorefield.llm.queries import op11_structure_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(name.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text)
        out += [] if fault == 0 else [row, row] if fault == 3 else [row]
    return out


def plain_repair(rows):
    """Dijkstra-free: all states after each row with the best (cost, letters), by the regular expression's own states."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    best = {"": (0, "", ())}  # by the shape of the initials so far

    def shape(text):  # prefixes of the grammar, told apart by what may follow
        return "" if not text else "s" if text == "s" else text[-1] if re.fullmatch(r"s?(ua)*u?", text) else None

    def put(table, key, cost, letters, made):
        if key is not None and (key not in table or (cost, letters) < table[key][:2]):
            table[key] = (cost, letters, made)

    def inserted(table):
        for _ in range(4):
            for key, (cost, letters, made) in list(table.items()):
                for role in ("user", "assistant"):
                    put(table, shape(("s" if key == "s" else "ua" if key == "a" else key) + role[0]), cost + 5, letters + "I", (*made, f"{role}:"))
        return table

    for (_, _, role, text), fault, initial in zip(rows, faults, initials):
        after = {}
        for key, (cost, letters, made) in inserted(best).items():
            put(after, key, cost + 2, letters + "D", made)
            if fault not in ("blank", "duplicate"):
                more, so_far = 5 * (fault == "truncated"), "s" if key == "s" else "ua" if key == "a" else key
                if initial:
                    put(after, shape(so_far + initial), cost + more, letters + "K", (*made, f"{role}:{text}"))
                for new in ("user", "assistant"):
                    put(after, shape(so_far + new[0]), cost + more + 1, letters + "R", (*made, f"{new}:{text}"))
        best = after
    cost, letters, made = min(v for k, v in inserted(best).items() if k in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    count = faults.count
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(made).encode()).hexdigest()


def plain(rows, damaged=True):
    kept = plain_damage(rows) if damaged else rows
    return sorted(((c, *plain_repair([r for r in kept if r[0] == c])) for c in {r[0] for r in rows}), key=repr)


def repaired(df, damaged=True):
    if damaged:
        rows = damage_conversations(df)
        pieces = repair_conversations(rows, F.col("gone"))
    else:
        pieces = repair_conversations(df)
    return sorted((tuple(r[c] for c in COLUMNS) for r in whole_conversations(pieces).collect()), key=repr)


def made(seed, n, convs=25):
    rnd = random.Random(seed)
    texts = ["a.", "b!", "c", " ", "", "é?", "a.", "x.y", None, "d. \n", "e "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    return [(rnd.choice([None, *range(convs)]), rnd.choice([None, *range(30)]), rnd.choice(roles[: rnd.choice([2, 3, 8])]), rnd.choice(texts)) for _ in range(n)]


def test_least_cost_and_letters_equal_all_prefixes_by_hand():
    rnd = random.Random(5)
    for _ in range(400):
        rows = [(1, i, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["a.", "b", " ", "c!"]) + str(i) * rnd.choice([0, 1])) for i in range(rnd.randint(0, 7))]
        want = plain_repair(rows)
        texts, faults, seen = [], [], set()
        for _, _, role, text in rows:
            faults.append(1 if not text.strip() else 2 if (role, text) in seen else 3 if text[-1] not in ".!?" else 0)
            seen.add((role, text))
            texts.append(role[:1])
        cost = dial(texts, faults, ENDING)
        letters, states, state = walk(texts, faults, cost, 0)
        letters, states = conversations._ended(letters, states, state)
        assert (cost[0], letters) == (want[5], want[6])


def test_odd_rows_equal_the_plain_version(spark):
    rows = made(1, 700)
    wider = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "key": F.lit("x"), "fault": F.lit(2), "part": F.lit(3), "gone": F.lit(True)})
    assert repaired(wider) == plain(rows)
    turns = {}
    for p in sorted(repair_conversations(wider).collect(), key=lambda p: (p.part, p.piece)):
        turns.setdefault(p.conv_id, []).extend(p.turns)
    assert len(turns) == 26 and all(GRAMMAR.fullmatch("".join(t.role[:1] for t in own)) for own in turns.values())


def test_conversations_across_partitions_equal_the_plain_version(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["a.", "b", "c!", " ", f"t{t}.", f"u{t}"])) for t in rnd.choices(range(400), k=900)]
    rows += [(1, 500, "user", "same.")] * 300 + [(1, None, "user", "a.")] * 20
    monkeypatch.setattr(conversations, "PIECE_TURNS", 50)
    found = []
    chained = conversations._chained
    monkeypatch.setattr(conversations, "_chained", lambda *a: found.append(chained(*a)) or found[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert repaired(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)
        assert sum(key == "c1" for key, _ in found[0]) > 3  # one conversation in several runs
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_dropped_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repaired(empty) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_sound_conversations_stay_and_long_texts_pass(spark):
    rows = [("x", 0, "system", "s."), ("x", 1, "user", "w" * 3_000_000 + "."), ("x", 2, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    (got,) = repaired(df, damaged=False)
    assert got[:8] == ("x", 0, 0, 0, 0, 0, 0, "KKK") and got[8] == plain(rows, damaged=False)[0][8]
    turns = repair_conversations(df).collect()
    assert [t.role for p in sorted(turns, key=lambda p: (p.part, p.piece)) for t in p.turns] == ["system", "user", "assistant"]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_the_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op11_structure_repair(spark, f"/root/testdata/sf{sf}")
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == plain(rows)
