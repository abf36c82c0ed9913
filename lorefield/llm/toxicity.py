"""Severity grades by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, map_carrying, small_batches
from .langid import WORD, lowered
from .shared import materialise

#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6)
#: Features that a task counts before it hands their counts on, and words whose features it keeps.
HELD_FEATURES = 40_000
HELD_WORDS = 60_000


def word_features(word: str) -> list[str]:
    """A word, and its beginnings marked as such."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weight of a text's features), one weight for all thresholds."""

    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray
    at: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.at = {f: k for k, f in enumerate(self.features)}

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k; its sum over k is the expected grade."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_features: int, steps: int = 600, l2: float = 1e-5, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the cumulative-link likelihood.

    Thresholds stay in order because their gaps are exponentials.
    """
    n_grades = int(grades.max()) + 1 if len(grades) else 1
    cuts = max(1, n_grades - 1)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(row))
    params = np.zeros(n_features + cuts)
    params[n_features] = 2.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    if not len(rows):
        return params[:n_features], params[n_features:]
    at_grade = np.arange(cuts)[None, :] == grades[:, None]
    at_below = np.arange(cuts)[None, :] == grades[:, None] - 1
    for step in range(1, steps + 1):
        weights, gaps = params[:n_features], params[n_features:]
        theta = gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])
        score = np.bincount(row, weights[col], len(rows))
        p = _sigmoid(theta[None, :] - score[:, None])  # P(grade <= k)
        upper = np.where(at_grade.any(axis=1), (p * at_grade).sum(axis=1), 1.0)
        lower = (p * at_below).sum(axis=1)
        mass = np.maximum(upper - lower, 1e-12)
        slope = p * (1 - p)
        d_theta = (slope * at_grade - slope * at_below) / mass[:, None]
        d_score = -d_theta.sum(axis=1)
        g_theta = -d_theta.mean(axis=0)
        g_weights = -np.bincount(col, d_score[row], n_features) / len(rows) + l2 * weights
        later = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([g_weights, later[:1], later[1:] * np.exp(gaps[1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights, gaps = params[:n_features], params[n_features:]
    return weights, gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])


def fit_severity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = 16_000, max_features: int = 1_024, min_docs: int = 6, split_positive: bool = True, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits a model on at most ``sample`` labelled rows, those whose ids hash lowest.

    Features are whole words and word beginnings; those whose documents differ most
    in grade from the rest are kept.  A label may be any grade from 0 upward.  With
    ``split_positive``, a label of two values gets a third grade: positives that hold
    more indicative words than the median positive are severe (2), others mild (1).
    Rows with a null id, label or text are left out; without any, the model says 0.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64(F.col("id").cast("string")), "id", "grade").limit(sample)  # the bound that the broadcast below relies on
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = text.join(F.broadcast(chosen), "id").select("grade", "text").dropDuplicates(["text", "grade"])
    small_batches(docs.sparkSession)
    rows = materialise(rows)  # a row for each sampled label, but for repeated ids; read three times

    def count(batches):
        docs_with, positive = Counter(), Counter()

        def flush():
            names = list(docs_with)
            for k in range(0, len(names), 10_000):
                part = names[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([docs_with[f] for f in part], pa.int64()), pa.array([positive[f] for f in part], pa.int64())], ["feature", "n", "pos"])
            docs_with.clear()
            positive.clear()

        for grades, texts in blocks(batches):
            for grade, body in zip(grades.to_pylist(), texts.to_pylist()):
                held = {f for w in set(WORD.findall(lowered(body))) for f in word_features(w)} | {""}  # "" counts the rows
                docs_with.update(held)
                if grade > 0:
                    positive.update(held)
                if len(docs_with) > HELD_FEATURES:
                    yield from flush()
        yield from flush()

    counted = rows.mapInArrow(count, "feature string, n bigint, pos bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    counted = counted.where((F.col("feature") == "") | (F.col("n") >= min_docs))
    all_docs, all_pos = next(((r.n, r.pos) for r in counted.where("feature = ''").collect()), (0, 0))
    if not all_docs or not all_pos:
        return OrdinalModel([], np.zeros(0), np.array([4.0]))
    base = all_pos / all_docs
    lift = (F.col("pos") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1e-9)
    top = counted.where("feature <> ''").withColumn("lift", lift).orderBy(F.desc(F.abs("lift")), "feature").limit(max_features).collect()
    model = OrdinalModel([r.feature for r in top], np.zeros(len(top)), np.array([0.0]))
    at = model.at

    def select(batches):
        for grades, texts in blocks(batches):
            ids = [sorted({at[f] for w in set(WORD.findall(lowered(body))) for f in word_features(w) if f in at}) for body in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([grades, pa.array(ids, pa.list_(pa.int32()))], ["grade", "ids"])

    fitted = rows.mapInArrow(select, "grade int, ids array<int>").limit(sample).toArrow()  # the limit is reached only where ids repeat
    ids, grades = fitted.column("ids").to_pylist(), np.array(fitted.column("grade").to_pylist(), np.int64)
    if split_positive and grades.max(initial=0) == 1:
        telling = {k for k, r in enumerate(top) if r.lift > 0 and r.pos >= 0.5 * r.n}
        hits = np.array([len(telling.intersection(r)) for r in ids])
        grades = grades + ((grades == 1) & (hits > np.median(hits[grades == 1])))
    model.weights, model.thresholds = fit_ordinal(ids, grades, len(top))
    return model


def grade_severity(df: DataFrame, model: OrdinalModel, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Severity of whole texts.

    Returns ``id, grade`` (the most likely one), ``severity`` (the expected grade),
    ``p_toxic`` (that the grade is over 0), ``toxic`` (``p_toxic`` of 0.5 or more) and
    ``evidence`` (features with a weight of 1 or more that the text holds, by name).
    A null or empty text has no features and gets what the thresholds alone say;
    repeated rows each get a row; an empty table gives none; other columns are not
    read, but for those in ``carry``, which pass through as ``carried``.  One narrow pass.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most max_features names and weights

    def run(batches):
        model = shared.value
        at, known = model.at, {}
        telling = {k for k, w in enumerate(model.weights) if w >= 1}
        for ids, texts, *others in blocks(batches):
            scores, evidence = [], []
            for text in texts.to_pylist():
                held: set[int] = set()
                for w in set(WORD.findall(lowered(text or ""))):
                    own = known.get(w)
                    if own is None:
                        own = tuple(at[f] for f in word_features(w) if f in at)
                        if len(known) >= HELD_WORDS:
                            known.clear()
                        if len(w) <= 40:
                            known[w] = own
                    held.update(own)
                scores.append(sum(model.weights[k] for k in sorted(held)))
                evidence.append(sorted(model.features[k] for k in held & telling))
            above = model.above(np.array(scores, np.float64))
            mass = np.column_stack([np.ones(len(above)), above]) - np.column_stack([above, np.zeros(len(above))])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(mass.argmax(axis=1), pa.int32()), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5), pa.array(evidence, pa.list_(pa.string())), *others],
                ["id", "grade", "severity", "p_toxic", "toxic", "evidence", *(f"carry{k}" for k in range(len(others)))],
            )

    schema = f"id {kind}, grade int, severity double, p_toxic double, toxic boolean, evidence array<string>"
    return map_carrying(df, run, schema, id_col, text_col, carry)
