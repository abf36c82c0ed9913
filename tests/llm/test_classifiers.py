"""Language and severity models: held-out accuracy, and tables made to be awkward."""

import math
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from lorefield.llm import langid, toxicity
from lorefield.llm.queries import held_out, language_model

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.label_languages(docs, language_model(docs), carry=("lang",)).where(held_out()).select("lang_pred", "carried.lang", "score", "spans").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.spans for r in rows)


def test_language_edges(spark):
    train = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate([("the house and the garden", "en"), ("la maison et le jardin", "fr"), ("дом и сад", "ru"), ("x", None), (None, "en")] * 3)], "doc_id long, text string, lang string, words string")
    model = langid.fit_language_model(train)
    assert model.languages == ["en", "fr", "ru"]
    texts = [None, "", "123 ½ ² Ⅷ ①", "the garden", "сад", "the house and the garden la maison et le jardin", "漢字", "İx"]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, id string, lang_pred string")
    got = {r.doc_id: r for r in langid.label_languages(df, model, penalty=1.0).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and not got[0].spans and got[2].score == 0
    assert (got[3].lang_pred, got[4].lang_pred) == ("en", "ru")
    assert [s.lang for s in got[5].spans] == ["en", "fr"] and texts[5][got[5].spans[1].start : got[5].spans[1].end] == "la maison et le jardin"
    assert got[6].lang_pred in model.languages
    assert langid.label_languages(df.limit(0), model).count() == 0
    empty = langid.fit_language_model(train.limit(0))
    assert {r.lang_pred for r in langid.label_languages(df, empty).collect()} == {"und"}


def test_long_words_are_read_whole(spark):
    lines = {"en": "the house and the garden", "fr": "la maison et le jardin", "ru": "дом и сад", "zh": "漢字文章"}
    train = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate([*lines.items()] * 3)], "doc_id long, text string, lang string")
    model = langid.fit_language_model(train)
    texts = ["сад" * 20 + "house" * 2000, "house" * 20 + "漢字文章" * 500, "maison" * 10 + "house" * 100, "сад漢字", "я" * 60 + "é" * 61 + " дом1сад"]
    got = {r.doc_id: r for r in langid.label_languages(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["en", "zh", "en"]
    assert abs(got[0].score - 10000 / 10060) < 1e-9 and abs(got[1].score - 2000 / 2100) < 1e-9
    assert [(s.start, s.end, s.lang) for s in got[0].spans] == [(0, 60, "ru"), (60, 10060, "en")]
    assert [(s.start, s.end, s.lang) for s in got[3].spans] == [(0, 3, "ru"), (3, 5, "zh")]
    assert [got[i].n_words for i in range(5)] == [1, 1, 1, 1, 3]


def test_pieces_hold_each_letter_once():
    every = "".join(c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000)
    assert "".join(langid.WORD.findall(every)) == "".join(c for c in every if unicodedata.category(c)[0] == "L")
    for text in (every, "a" * 130 + "b1" * 3, "ñ" * 61, "漢" * 200 + "かなabc々ー", "x_y 1", ""):
        pieces = langid.piece_pattern(text).findall(text)
        assert "".join(pieces) == "".join(langid.WORD.findall(text)) and all(len(p) <= 60 for p in pieces)


def test_viterbi_equals_trying_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, k = int(rng.integers(1, 7)), 3
        rows = rng.normal(size=(n, k)).astype(np.float32) * 3
        label = langid.viterbi(rows, np.arange(n), np.array([0]), np.array([n]), 1.5)
        score = lambda p: sum(rows[i, s] for i, s in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(score([(c // k**i) % k for i in range(n)]) for c in range(k**n))
        assert abs(score(label.tolist()) - best) < 1e-4


def plain_labels(model, text, penalty):
    """Scores letter by letter and Viterbi by a plain table, for one text."""
    low = langid.lowered(text)
    pieces = langid.piece_pattern(low).findall(low)
    n, best, back = len(model.languages), None, []
    for piece in pieces:
        own = [float(x) for x in model.words([piece])[0]]
        if best is None:
            best = own
            continue
        came, now = [], []
        for k in range(n):
            options = [(best[j] - (0 if j == k else penalty), j == k, -j) for j in range(n)]
            top = max(options)
            came.append(-top[2])
            now.append(top[0] + own[k])
        back.append(came)
        best = now
    state = max(range(n), key=lambda k: (best[k], -k))
    states = [state]
    for came in reversed(back):
        state = came[state]
        states.append(state)
    weight = [0] * n
    for piece, k in zip(pieces, reversed(states)):
        weight[k] += len(piece)
    top = max(range(n), key=lambda k: (weight[k], -k))
    return model.languages[top], weight[top] / sum(weight)


def test_labels_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_model(docs)
    sample = docs.where("char_length(text) < 2500").limit(60)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.label_languages(sample, model).collect()}
    agree = [abs(got[r.doc_id][1] - want[1]) < 1e-6 and got[r.doc_id][0] == want[0] for r in sample.collect() if (want := plain_labels(model, r.text, 6.0))]
    assert np.mean(agree) > 0.98  # float32 sums may tip a tie


def test_word_scores_equal_sums_over_letter_pairs_and_triples(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the house", "en"), ("la maison", "fr")] * 3)], "doc_id long, text string, lang string")
    model = langid.fit_language_model(docs)
    from lorefield.llm.shingles import SEEDS, mix

    def bucket(codes, plus):
        with np.errstate(over="ignore"):
            h = sum((np.uint64(c) * s for c, s in zip(codes, SEEDS)), np.uint64(plus))
            return int(mix(h) % np.uint64(len(model.weights)))

    for word in ("the", "maison", "zz"):
        marked = [ord(c) for c in f"<{word}>"]
        grams = [bucket(marked[i : i + w], w) for w in (2, 3) for i in range(len(marked) - w + 1)]
        with np.errstate(over="ignore"):
            whole = sum((mix(np.uint64(c) * SEEDS[0] + np.uint64(i) * SEEDS[3]) for i, c in enumerate(marked)), np.uint64(0))
        grams.append(int(mix(whole) % np.uint64(len(model.weights))))
        total = sum(model.weights[g] for g in grams) / np.sqrt(2 * len(word) + 2)
        want = np.maximum(total - total.max(), -12)
        assert np.allclose(model.words([word])[0], want, atol=1e-4)


def test_more_languages_than_a_byte_counts(spark):
    rows = np.full((300, 300), -9.0, np.float32)
    np.fill_diagonal(rows, 0)
    label = langid.viterbi(rows, np.arange(300), np.array([0]), np.array([300]), 1.0)
    assert label.tolist() == list(range(300))


def test_labels_beyond_the_bound_are_not_learnt(spark):
    train = spark.createDataFrame([(i, "word one two", f"l{i % 7}" if i % 7 < 3 or i < 14 else "l0") for i in range(70)], "doc_id long, text string, lang string")
    assert langid.fit_language_model(train, max_languages=3).languages == ["l0", "l1", "l2"]


def test_ordinal_fit_orders_thresholds_and_shares_weights():
    rows = [[]] * 60 + [[0]] * 40 + [[0, 1]] * 40
    weights, thresholds = toxicity.fit_ordinal(rows, np.array([0] * 60 + [1] * 40 + [2] * 40), 2)
    assert thresholds[0] < thresholds[1] and weights[0] > 0 and weights[1] > 0


def test_grades_equal_a_plain_version(spark):
    """Scores, threshold probabilities and expected severity from the model's numbers, word by word."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_severity(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    rows = {r.doc_id: r for r in toxicity.grade_severity(docs, model).collect()}
    for r in docs.collect():
        words = {w for w in re.findall(r"[^\W\d_]+", toxicity.lowered(r.text or ""))}
        words = {w for x in words for w in toxicity.WORD.findall(x)}
        held = {f for w in words for f in [w] + [w[:n] + "*" for n in (4, 5, 6) if len(w) > n]}
        score = sum(w for f, w in zip(model.features, model.weights) if f in held)
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        got = rows[r.doc_id]
        assert abs(got.severity - sum(above)) < 1e-9 and abs(got.p_toxic - above[0]) < 1e-9 and got.toxic == (above[0] >= 0.5)
        mass = [1 - above[0], above[0] - above[1], above[1]]
        assert got.grade == mass.index(max(mass))


def test_ordinal_gradient_is_that_of_the_likelihood():
    """A fit to its end has no slope left: moving any parameter lowers the likelihood."""
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(5, rng.integers(0, 4), replace=False).tolist()) for _ in range(200)]
    grades = np.array([min(2, len(r) // 2 + int(rng.random() < 0.3)) for r in rows])
    weights, thresholds = toxicity.fit_ordinal(rows, grades, 5, steps=4000, rate=0.02)

    def loss(w, t):
        total = 0.5e-5 * float((w**2).sum()) * len(rows)
        for r, g in zip(rows, grades):
            p = 1 / (1 + np.exp(-(t - w[r].sum())))
            total -= math.log(np.concatenate([p, [1.0]])[g] - np.concatenate([[0.0], p])[g])
        return total

    base = loss(weights, thresholds)
    for k in range(5):
        for step in (-0.05, 0.05):
            moved = weights.copy()
            moved[k] += step
            assert loss(moved, thresholds) > base
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = thresholds.copy()
            moved[k] += step
            assert loss(weights, moved) > base


def test_severity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_severity(docs, labels.where("doc_id % 4 <> 0"))
    pred = toxicity.grade_severity(docs.where("doc_id % 4 = 0"), model).withColumnRenamed("toxic", "pred").join(labels, "doc_id")
    got = {(r.pred, r.toxic): r["count"] for r in pred.groupBy("pred", "toxic").count().collect()}
    assert got.get((True, 1), 0) > 0.85 * (got.get((True, 1), 0) + got.get((False, 1), 0))
    assert got.get((True, 0), 0) < 0.02 * got[False, 0]


def test_severity_edges(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["you moron", "dear friend", None, "", "moron moron", "MORON"] * 8)], "doc_id long, text string, grade string")
    labels = docs.where(F.col("doc_id") < 40).select("doc_id", F.coalesce(F.lower("text").contains("moron").cast("int"), F.lit(0)).alias("toxic"))
    model = toxicity.fit_severity(docs, labels, min_docs=2)
    rows = {r.doc_id: r for r in toxicity.grade_severity(docs, model).collect()}
    assert len(rows) == 48 and all(0 <= r.severity <= 2 for r in rows.values())
    assert toxicity.grade_severity(docs.limit(0), model).count() == 0
    none = toxicity.fit_severity(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.grade_severity(docs, none).collect())
