"""Mixing against targets dealt by hand, and the conditions of the optimum."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorefield.llm.mixing import mix_sources
from lorefield.llm.queries import op13_source_mix

SCHEMA = "doc_id bigint, text string, source string"


def plain_targets(sizes):
    """Reshares the excess, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def check(rows, docs, near=1.0):
    words = sorted(((d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in docs), key=repr)
    assert sorted(((r.doc_id, r.source, r.size) for r in rows), key=repr) == words
    sizes = defaultdict(int)
    for _, s, n in words:
        sizes[s] += n
    target, taken = plain_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2 and abs(r.copies - r.rate) < 2
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= near for s in sizes)
    for s in sizes:  # the exponential tilt: below the bound, log(rate) is one multiple of the size throughout a source
        tilts = [math.log(r.rate) / r.size for r in rows if r.source == s and r.size and r.rate < 2]
        assert not tilts or max(tilts) - min(tilts) < 1e-9


def made(seed, n, sources):
    rnd = random.Random(seed)
    return [(i, " ".join(["w"] * max(1, int(rnd.expovariate(1 / 40)))), rnd.choice(sources)) for i in range(n)]


def test_rates_and_copies_meet_the_targets(spark):
    docs = made(1, 1500, ["a", "a", "a", "a", "a", "b", "é", "z", "Z", None, "𝄞"])
    df = spark.createDataFrame(docs, SCHEMA).repartition(6).withColumns({"size": F.lit("x"), "n": F.lit(1), "rank": F.lit(2), "id": F.lit(3), "target": F.lit(0)})
    rows = mix_sources(df).collect()
    check(rows, docs)
    again = mix_sources(spark.createDataFrame(docs[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(rows) == sorted(again)


def test_odd_rows(spark):
    docs = made(2, 60, ["a", "b", None, ""]) + [(None, "x y z", "a"), (None, None, "a"), (5, "", "b"), (5, "", "b"), (7, " \t\n", None), (8, "long " * 30_000, "c"), (9, "a\x1cb\x85c\xa0d", "a")]
    docs += [(1000, "one two three four", "hot")] * 120
    check(mix_sources(spark.createDataFrame(docs, SCHEMA)).collect(), docs, near=30_000)


def test_equal_rows_share_copies(spark):
    docs = [(1, "a b", "s1")] * 90 + [(2, "c d e", "s2")] * 20 + [(3, "f", "s3")] * 40
    rows = mix_sources(spark.createDataFrame(docs, SCHEMA)).collect()
    check(rows, docs, near=2)


def test_tables_without_words(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_other_weights_and_bounds(spark):
    docs = made(3, 400, ["a", "b"])
    rows = mix_sources(spark.createDataFrame(docs, SCHEMA), weights=(1, 3), share=0.5, cap=3).collect()
    words = sum(r.size for r in rows)
    for s, want in (("a", words / 8), ("b", 3 * words / 8)):
        assert abs(sum(r.taken for r in rows if r.source == s) - want) <= 1


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_meets_targets(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    got = op13_source_mix(spark, f"/root/testdata/sf{sf}")
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "rate"] and dict(got.dtypes)["taken"] == "bigint"
    source = {d.doc_id: d.source for d in docs}
    taken, target = defaultdict(int), {}
    for r in got.collect():
        assert r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 0.05 * t for s, t in target.items())
