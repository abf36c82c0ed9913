"""The pipeline's stages against plain versions, and its queries' contracts."""

import re

import pytest

import corpus_pipeline
from lorefield.llm import queries as Q

from ..compare import differences, views
from .test_copies import plain_components, plain_sets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    assert differences(spark, views(SF), Q.queries()[name], Q.oracle_sql()[name], SF) == ""


def test_stages_keep_what_a_plain_version_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    kept = by_name["language ID"](spark, docs, SF)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in kept.collect()} == want
    kept = by_name["toxicity"](spark, docs, SF)
    toxic = {r.doc_id for r in Q.op3_toxicity(spark, SF).collect() if r.toxic}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - toxic
    rows = sorted((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect())
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    kept = by_name["exact dedup"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == set(first.values()) and kept.columns == docs.columns
    sets = plain_sets([t for _, t in rows])
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    group = plain_components(links, len(sets))
    kept = by_name["n-gram Jaccard join"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {rows[i][0] for i, c in enumerate(group) if i == c}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(0 < r.length <= 1024 and r.offset + r.length <= 1024 for r in rows)


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, sha string, kept string, id string, label string, key_0 long"


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, empty and repeated rows, null ids, and columns with names that the stages use."""
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words), (None, words.replace(" ", "  ")), (2, words + " more"), (2, words + " more"), (3, None), (4, ""), (None, None), (5, "½ 12"), (6, "a b"), (None, "Only here")]
    docs = spark.createDataFrame([(i, t, "en" if i else None, None, None, "s", "k", None, "l", 7) for i, t in rows], AWKWARD)
    got = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        got[name] = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
        assert all(r.sha == "s" and r.kept == "k" and r.key_0 == 7 for r in kept.collect())
    assert got["language ID"] == sorted([r for r in rows if r[1] and any(c.isalpha() for c in r[1])], key=repr)
    assert got["toxicity"] == sorted(rows, key=repr)
    exact = [(1, words), (2, words + " more"), (2, words + " more"), (3, None), (5, "½ 12"), (6, "a b"), (None, "Only here")]
    assert got["exact dedup"] == sorted(exact, key=repr)
    near = [(1, words), (3, None), (4, ""), (None, None), (5, "½ 12"), (6, "a b"), (None, "Only here")]
    assert got["n-gram Jaccard join"] == sorted(near, key=repr)
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert packed.count() == len(rows) and corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0
