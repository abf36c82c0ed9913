"""Exact copies, near copies, shards, fingerprints and archives against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorefield.llm import dedup, jaccard
from lorefield.llm.dedup import double_directory, exact_dedup
from lorefield.llm.fingerprint import fingerprint_pairs, likeness, with_next, words_of
from lorefield.llm.graph import components
from lorefield.llm.jaccard import jaccard_components
from lorefield.llm.sharding import hilbert_index, hilbert_shards, write_shards
from lorefield.llm.shared import lookup
from lorefield.llm.shingles import parity_gap, set_parity
from lorefield.llm.warc import MAGIC, archive_round_trip, read_warc, write_warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, label string, norm string, size string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or ""), "x", "y", "z", "u", "v") for i, t in enumerate(texts)], SCHEMA)


def corpus(seed=7, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 150))) for _ in range(n)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    for k in range(n):
        edited = texts[k].split(" ")
        for _ in range(rnd.randint(0, 4)):
            edited[rnd.randrange(len(edited))] = rnd.choice(words)
        texts.append(" ".join(edited))
        if k % 4 == 0:
            texts.append(passage + " " + texts[k][:40])
    base = texts[1].split(" ") * 2
    for _ in range(40):  # a large group of near copies
        edited = list(base)
        edited[rnd.randrange(len(edited))] = rnd.choice(words)
        texts.append(" ".join(edited))
    return texts + [None, "", " \n ", "one two", "ONE  two", "one two", "word " * 3000, " x y z u v w", texts[0].upper(), texts[0].replace(" ", "\n")]


def plain_sets(texts):
    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return sets


def plain_components(links, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_jaccard_join_equals_all_pairs(spark):
    texts = corpus()
    sets = plain_sets(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = list(zip(map(len, sets), plain_components(links, len(sets))))
    got = sorted(tuple(r) for r in jaccard_components(table(spark, texts)).collect())
    assert got == [(i, n, c) for i, (n, c) in enumerate(want)]
    assert any(c != i for i, (_, c) in enumerate(want))


@pytest.mark.parametrize("sizes", [{"CELL_ROWS": 3, "HUB_ROWS": 2, "LEAF_ROWS": 10**6, "FILTER_BITS": 4}, {"LEAF_ROWS": 4, "PIVOTS": 2, "HUB_ROWS": 3, "PART_ROWS": 2, "HELD_PAIRS": 1}, {"REGION_BITS": 6}])
def test_jaccard_join_in_parts(spark, monkeypatch, sizes):
    """Blocks of cells; Voronoi cells of texts, level by level; hot regions in parts; no filter of names."""
    for name, value in sizes.items():
        monkeypatch.setattr(jaccard, name, value)
    test_jaccard_join_equals_all_pairs(spark)


def test_jaccard_join_of_a_spread_group(spark, monkeypatch):
    """A third of the rows are edits of edits of one text: few are within the radius of one pivot."""
    monkeypatch.setattr(jaccard, "LEAF_ROWS", 8)
    levels, split = [], jaccard._named_texts
    monkeypatch.setattr(jaccard, "_named_texts", lambda *a: levels.append(1) or split(*a))
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts, held = [" ".join(word() for _ in range(60)) for _ in range(80)], [[word() for _ in range(80)]]
    while len(held) < 40:
        edited = list(rnd.choice(held[-3:]))
        for _ in range(rnd.randint(1, 3)):
            edited[rnd.randrange(80)] = word()
        held.append(edited)
    texts += [" ".join(w) for w in held]
    sets = plain_sets(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(table(spark, texts)).collect())
    assert got == list(enumerate(plain_components(links, len(sets))))
    assert len(levels) >= 3  # stars, a level of cells at least, and what was left open


def test_jaccard_join_moves_hardly_any_text_that_is_not_linked(spark, monkeypatch):
    """Rare passages before more frequent ones make many pairs that share half of their texts, and no links."""
    moved, named = [], jaccard._named_texts
    monkeypatch.setattr(jaccard, "_named_texts", lambda docs, ids: moved.append(ids.count()) or named(docs, ids))
    rnd = random.Random(3)
    words = lambda n: " ".join(f"w{rnd.randrange(10**7)}" for _ in range(n))
    rare, frequent, own = [words(100) for _ in range(10)], [words(100) for _ in range(8)], words(100)
    texts = [f"{p} {q}" for p in rare for q in frequent] + [f"{own} tail", f"{own} other tail"]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(table(spark, texts)).collect())
    assert got == [(i, i) for i in range(81)] + [(81, 80)]
    assert sum(moved) < 20  # without a look at parities, 152


def test_parities_differ_in_no_more_bits_than_sets_in_elements():
    rnd = random.Random(4)
    for sizes in [(0, 0), (1, 1), (3, 70), (64, 65), (100, 130), (300, 300), (700, 5000)]:
        for share in (0, 0.5, 1):
            a = {rnd.getrandbits(64) for _ in range(sizes[0])}
            b = set(sorted(a)[: int(share * len(a))]) | {rnd.getrandbits(64) for _ in range(sizes[1] - int(share * len(a)))}
            x, y = (set_parity(np.array(sorted(s), np.uint64)) for s in (a, b))
            assert parity_gap(x, y) == parity_gap(y, x) <= len(a ^ b)
            assert parity_gap(x, x) == 0


def test_jaccard_join_of_repeated_and_null_ids(spark):
    rnd = random.Random(6)
    long = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    near = [t + " tail" for t in long]
    rows = [(1, long[0]), (5, near[0]), (5, long[1]), (5, long[1]), (7, near[1]), (None, long[2]), (3, near[2]), (None, long[3]), (None, near[3]), (None, None), (9, ""), (9, "a b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=repr)
    want = [(1, 56, 1), (5, 57, 1), (5, 56, 5), (5, 56, 5), (7, 57, 5), (None, 56, 3), (3, 57, 3), (None, 56, None), (None, 57, None), (None, 0, None), (9, 0, 9), (9, 1, 9)]
    assert got == sorted(want, key=repr)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_components(table(spark, []).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 50
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_exact_dedup_equals_grouping(spark, monkeypatch):
    texts = corpus()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = collections.defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    for hot in (10**9, 1):  # keys that are merged before they move: none; all that have copies
        monkeypatch.setattr(dedup, "COLD_ROWS", hot)
        got = sorted(tuple(r) for r in exact_dedup(table(spark, texts), capacity=4).collect())
        assert got == [(i, groups[t][0], len(groups[t]), i == groups[t][0], hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)]
    assert exact_dedup(table(spark, []).limit(0)).count() == 0


def test_exact_dedup_of_null_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(rows).collect()), key=repr)
    assert got == sorted([(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (None, None, 1, True)], key=repr)


def test_index_files(spark, tmp_path, monkeypatch):
    """Each row lies in the bucket its key's leading bits lead to; chains number different texts of one key."""
    monkeypatch.setattr(dedup, "COLD_ROWS", 1)
    texts = corpus()
    path = f"file://{tmp_path}/index"
    index = dedup.build_index(table(spark, texts), path, capacity=4)
    directory = {r.slot: (r.bucket, r.depth) for r in spark.read.parquet(f"{path}/directory").collect()}
    depth = len(directory).bit_length() - 1
    assert len(directory) == 1 << depth and depth >= 4
    for slot, (bucket, local) in directory.items():
        assert bucket == slot >> (depth - local) << (depth - local)
    rows = index.collect()
    assert all(directory[(r.key % 2**64) >> (64 - depth)][0] == r.bucket and r.chain == 0 for r in rows)
    held = collections.Counter(r.bucket for r in rows if not r.merged)
    assert max(n for b, n in held.items()) <= 4 + 3  # a key's rows are not split
    assert any(r.merged for r in rows) and sum(r.group_size for r in rows if r.id == r.keep_id) == len(texts)
    asked = spark.createDataFrame([(1, texts[3]), (2, "not there"), (3, None), (3, "one\ttwo")], "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    got = sorted((r.doc_id, r.keep_id) for r in dedup.probe_index(spark, asked, path).collect() if r.keep_id is not None)
    assert got == sorted([(1, 3), (3, first[""]), (3, first["one two"])])


def test_chains_keep_texts_with_one_key_apart(spark, monkeypatch):
    monkeypatch.setattr(dedup.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    for hot in (10**9, 1):
        monkeypatch.setattr(dedup, "COLD_ROWS", hot)
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", None, "c", "b"])], "doc_id long, text string")
        got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(rows).collect())
        assert got == [(0, 0, 2), (1, 1, 2), (2, 0, 2), (3, 3, 1), (4, 4, 1), (5, 1, 2)]


def test_directory_doubles_until_buckets_fit():
    depth, slots = double_directory({0: 50, 1: 50, 2: 1, 15: 60}, capacity=60, max_depth=4)
    assert set(slots) == set(range(1 << depth))
    assert slots[0] != slots[(1 << depth) - 1]
    assert slots[0 if depth == 4 else 0][0] == 4  # prefixes 0 and 1 are apart only at full depth
    assert double_directory({}, 10, 4) == (0, {0: (0, 0)})
    depth, slots = double_directory({(1 << 17) + 5: 9, (1 << 17) + 4: 9}, capacity=10, max_depth=18)
    assert depth == 18 and len({slots[(1 << 17) + k] for k in (4, 5)}) == 2


def test_lookup_deals_out_hot_keys(spark, monkeypatch):
    from lorefield.llm import shared

    monkeypatch.setattr(shared, "HOT_SHARE", 2)
    rows = spark.range(400).select(F.col("id"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(-1).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = lookup(rows, groups, ["k"], "n", F.col("id")).collect()
    assert len(got) == 400 and all((r.n, r.first) == ((300, 1) if r.k == -1 else (1, r.id)) for r in got)


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2)])
def test_hilbert_curve_visits_neighbours(spark, n, bits):
    dims = [F.shiftright("id", bits * k).bitwiseAND((1 << bits) - 1).cast("int") for k in range(n)]
    rows = spark.range(1 << n * bits).select(*(d.alias(f"d{k}") for k, d in enumerate(dims))).withColumn("h", hilbert_index([F.col(f"d{k}") for k in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(rows)))
    assert all(sum(abs(a[f"d{k}"] - b[f"d{k}"]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(spark):
    texts = corpus()
    got = hilbert_shards(table(spark, texts), 7, ["doc_id"], ["lang", "source"]).collect()
    slots = collections.defaultdict(list)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
        slots[r.shard].append(r.slot)
    sizes = [len(v) for v in slots.values()]
    assert sorted(slots) == list(range(7)) and max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert hilbert_shards(table(spark, []).limit(0), 7, ["doc_id"], ["lang"]).count() == 0


def test_shards_are_written_once_a_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "en", 9), (1, "a", "en", 9), (1, "b", "fr", 9), (None, None, None, 9), (2, "c" * 5000, "en", 9)] * 5, "doc_id long, text string, lang string, row int")
    write_shards(rows, f"file://{tmp_path}/shards", 4, ["doc_id"], ["lang"])
    got = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(got.columns) == sorted([*rows.columns, "shard", "slot"])
    assert sorted(map(repr, got.select(*rows.columns).collect())) == sorted(map(repr, rows.collect()))
    slots = collections.defaultdict(list)
    for r in got.collect():
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3] and all(sorted(v) == list(range(len(v))) for v in slots.values())


def plain_hilbert(point, bits):
    """Rank by walking down the quadrants of the curve: the textbook rule for two dimensions."""
    x, y = point
    rank, s = 0, 1 << (bits - 1)
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        rank += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = (1 << bits) - 1 - x, (1 << bits) - 1 - y
            x, y = y, x
        s >>= 1
    return rank


def test_hilbert_rank_equals_a_plain_version(spark):
    bits = 4
    rows = spark.range(1 << 2 * bits).select(F.shiftright("id", bits).cast("int").alias("x"), F.col("id").bitwiseAND((1 << bits) - 1).cast("int").alias("y"))
    got = rows.select("x", "y", hilbert_index([F.col("x"), F.col("y")], bits).alias("h")).collect()
    plain = {(x, y): plain_hilbert((x, y), bits) for x in range(16) for y in range(16)}
    flipped = {(x, y): plain_hilbert((y, x), bits) for x in range(16) for y in range(16)}
    ours = {(r.x, r.y): r.h for r in got}
    assert ours in (plain, flipped)  # the curve and its mirror image are equally good


def test_files_are_pruned_by_any_dimension(spark, tmp_path):
    """Of 16 files in Hilbert order, a narrow range of either column meets about the square root."""
    rnd = random.Random(2)
    rows = spark.createDataFrame([(rnd.randrange(1000), rnd.randrange(1000), "t") for _ in range(4000)], "doc_id long, other long, text string")
    write_shards(rows, f"file://{tmp_path}/shards", 16, ["doc_id", "other"], [])
    spans = spark.read.parquet(f"file://{tmp_path}/shards").groupBy("shard").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("doc_id", "other") for f in (F.min, F.max))).collect()
    for column in ("doc_id", "other"):
        met = [sum(r[f"min_{column}"] <= low + 20 and r[f"max_{column}"] >= low for r in spans) for low in range(0, 980, 20)]
        assert sum(met) / len(met) < 8  # all 16 if files held random rows


def test_fingerprints(spark):
    texts = corpus()
    rows = fingerprint_pairs(table(spark, texts)).select("*", likeness(F.col("anchors"), F.col("edited_anchors")).alias("near")).collect()
    whole = [t or "" for t in texts]
    by_text = {}
    for r in rows:
        n, after = len(whole[r.id]), whole[(r.id + 1) % len(whole)]
        assert r.text == whole[r.id]
        assert r.edited == whole[r.id][: n - n // 2] + after[: n // 2]
        assert by_text.setdefault(r.text, r.anchors) == r.anchors
        assert 0 <= r.near <= 1
    assert len(rows) == len(texts)
    assert [r.next_anchors for r in rows if r.id == len(texts) - 1] == [r.anchors for r in rows if r.id == 0]
    assert fingerprint_pairs(table(spark, []).limit(0)).count() == 0


def test_an_edit_far_away_leaves_anchors(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[:100] + ["new"] + words[101:])]
    a, b = (r.anchors for r in sorted(fingerprint_pairs(table(spark, texts)).collect(), key=lambda r: r.id))
    assert len({x.hash for x in a} & {x.hash for x in b}) > 0.8 * len(a)


def test_syncmers_equal_a_plain_version(spark):
    """Every run of six words, its five inner pairs of words, and the least of them at an edge."""
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 2) for _ in range(n)) for n in (0, 1, 5, 6, 7, 8, 9, 40, 400) for _ in range(3)]
    rows = {r.id: r for r in fingerprint_pairs(table(spark, texts)).collect()}
    words = [t.split() for t in texts]
    pairs = spark.createDataFrame([(a, b) for a, b in {p for w in words for p in zip(w, w[1:])}], "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()
    inner = {(r.a, r.b): r.h for r in pairs}
    for i, w in enumerate(words):
        scores = [inner[p] for p in zip(w, w[1:])]
        want = [k for k in range(len(w) - 5) if min(scores[k : k + 5]) in (scores[k], scores[k + 4])]
        got = [a.at for a in rows[i].anchors]
        assert got == (want or ([0] if w else []))
        whole = [a.hash for a in rows[i].anchors]
        assert len(set(zip(whole, (tuple(w[k : k + 6]) for k in want)))) == len(set(tuple(w[k : k + 6]) for k in want)) or not want


def test_likeness_counts_matches_by_place(spark):
    rnd = random.Random(13)
    texts = [" ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(60)) for _ in range(12)]
    for r in fingerprint_pairs(table(spark, texts)).select("*", likeness(F.col("anchors"), F.col("next_anchors")).alias("near")).collect():
        marks = [{(x.hash, x.at - y.at if y else None) for x, y in zip(a, [None, *a])} for a in (r.anchors, r.next_anchors)]
        assert abs(r.near - len(marks[0] & marks[1]) / len(marks[0] | marks[1])) < 1e-9
    shifted = [" ".join(f"w{i}" for i in range(100)), " ".join(["new", "start"] + [f"w{i}" for i in range(100)])]
    near = fingerprint_pairs(table(spark, shifted)).select(likeness(F.col("anchors"), F.col("next_anchors")).alias("near")).first().near
    assert near > 0.8  # a passage keeps its matches wherever it stands


def test_next_texts_of_repeated_ids_in_many_ranges(spark):
    rows = [(i // 3, f"text {i}") for i in range(90)] + [(None, "none"), (5, "text 15")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = with_next(df, {"n": F.char_length("text")}, rows_per_bucket=7).collect()
    assert len(got) == len(rows) and collections.Counter(r.text for r in got) == collections.Counter(r.next for r in got)
    order = lambda i: -1 if i is None else i
    ids = {t: i for i, t in rows}
    for r in got:
        after = order(ids[r.next])
        assert after in (order(r.id), order(r.id) + 1) or (order(r.id), after) == (29, -1)


def test_short_texts_have_fingerprints_of_their_own(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n "] + [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(n)) for n in (1, 5, 6, 7, 8, 9) for _ in range(40)]
    prints = [r.anchors for r in sorted(fingerprint_pairs(table(spark, texts)).collect(), key=lambda r: r.id)]
    assert prints[:3] == [[]] * 3 and all(prints[3:])
    assert len({tuple(map(tuple, p)) for p in prints[3:]}) == len(prints) - 3


def test_unspaced_runs_are_cut_by_themselves(spark):
    rnd = random.Random(4)
    run = "".join(rnd.choice("漢字文章語句読点我你他😀abc") for _ in range(600))
    assert spark.range(1).select(words_of(F.lit("ab " + run + " cd"))).first()[0] == ["ab", *run, "cd"]
    spaced = " ".join(f"w{i}" for i in range(300))
    texts = [run, spaced, run[:10] + "新" + run[10:], spaced]
    near = {r.id: r.near for r in fingerprint_pairs(table(spark, texts)).select("id", likeness(F.col("anchors"), F.col("edited_anchors")).alias("near")).collect()}
    assert near[0] > 0.3 and near[1] > 0.1  # half of 120 anchors, and 240 from the unspaced half
    prints = {r.id: {a.hash for a in r.anchors} for r in fingerprint_pairs(table(spark, texts)).collect()}
    assert len(prints[0] & prints[2]) > 0.8 * len(prints[0])


def pages(spark):
    long = "<p>" + "x" * 200 + "</p>"
    trap = f"<pre>{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n{MAGIC}</pre>" + "y" * 120
    html = [long, "short", "short", None, "", long, trap, trap, MAGIC, f"tail {MAGIC}", "é" * 90, "\r\n\r\n" * 40, long]
    return spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1" if i % 2 else None, h, "c") for i, h in enumerate(html)], "page_id long, url string, html string, id string"), html


def test_archives_round_trip(spark):
    df, html = pages(spark)
    first = {}
    want = []
    for i, h in enumerate(html):
        data = (h or "").encode()
        to = first.setdefault(data, i) if len(data) >= 100 else i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if to != i else "response", to if to != i else None))
    assert sorted(tuple(r) for r in archive_round_trip(df).collect()) == want
    assert archive_round_trip(df.limit(0)).count() == 0


def test_archives_of_repeated_rows(spark):
    long, other = "<p>" + "x" * 200, "<p>" + "y" * 200
    rows = [(1, "u", long), (1, "u", long), (2, "u", long), (3, "u", other), (3, "v", long), (4, "u", other), (None, "u", long), (None, None, "s")]
    got = sorted(((r.page_id, r.payload_digest[:6], r.record_type, r.refers_to) for r in archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=repr)
    a, b, c = (hashlib.sha256(x.encode()).hexdigest()[:6] for x in (long, other, "s"))
    want = [(1, a, "response", None)] * 2 + [(2, a, "revisit", 1), (3, a, "revisit", 1), (3, b, "response", None), (4, b, "revisit", 3), (None, a, "revisit", 1), (None, c, "response", None)]
    assert got == sorted(want, key=repr)


def test_magic_inside_payloads_is_no_record(spark, tmp_path):
    df, html = pages(spark)
    write_warc(df, f"file://{tmp_path}/w", records_per_file=3)
    rows = read_warc(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r.id for r in rows) == list(range(len(html)))
    assert all(r.digest == r.payload_sha256 for r in rows if r.type == "response")


def test_headers_of_any_length(spark, tmp_path):
    rows = [(i, f"http://x/{i}/" + "é" * (70_000 if i % 3 == 1 else 1), f"<p>{i}</p>") for i in range(7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_warc(df.coalesce(1), f"file://{tmp_path}/w")
    assert sorted((r.id, r.url, r.payload_bytes) for r in read_warc(spark, f"file://{tmp_path}/w").collect()) == [(i, u, len(h)) for i, u, h in rows]


def test_a_chain_that_ends_early_is_an_error(spark, tmp_path):
    write_warc(pages(spark)[0].coalesce(1), f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("part-*")
    data = file.read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "part-0").write_bytes(data.replace(b"Content-Length: 5", b"Content-Length: 6"))
    with pytest.raises(ValueError, match="1 of the files"):
        read_warc(spark, f"file://{tmp_path}/cut")


def test_records_have_their_date_and_revisits_a_profile(spark, tmp_path):
    from datetime import UTC, datetime

    from lorefield.llm.warc import SAME_PAYLOAD, write_warc

    pages = spark.createDataFrame([(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200), (3, "http://c/", "")], "page_id bigint, url string, html string")
    write_warc(pages, f"file://{tmp_path}/w", date=datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC))
    heads = [r.split("\r\n\r\n")[0] for f in (tmp_path / "w").glob("*.txt") for r in f.read_bytes().decode().split("WARC/1.1\r\n")[1:]]
    assert len(heads) == 3 and all("WARC-Date: 2024-05-06T07:08:09Z" in h for h in heads)
    assert [f"WARC-Profile: {SAME_PAYLOAD}" in h for h in sorted(heads, key=lambda h: "<urn:page:2>" in h.split("WARC-Date")[0])] == [False, False, True]
