"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, map_carrying, small_batches
from .shingles import SEEDS, mix

#: Code points below U+0370 that are word characters, but numbers and not letters: superscripts and fractions.
_LATIN_LETTER = r"[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]"


def _letter_ranges(start: int = 0, end: int = 0x110000) -> list[str]:
    """The letters (Unicode's categories L) from ``start`` to ``end`` as ranges of a character class."""
    is_letter = [chr(c).isalpha() for c in range(start, end)] + [False]
    edges = [c for c in range(len(is_letter)) if is_letter[c] != (c > 0 and is_letter[c - 1])]
    return [f"{chr(start + a)}-{chr(start + b - 1)}" for a, b in zip(edges[::2], edges[1::2])]


WORD = re.compile(f"[{''.join(_letter_ranges())}]+")
UNDETERMINED = "und"
#: First code point of each range and its script (fixed values of the Unicode blocks).
SCRIPTS = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB80, "tamil"),
    (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "other"),
    (0x20000, "han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_KINDS = np.array([_NAMES.index(name) for _, name in SCRIPTS])
#: Words that are looked at together.
SCORED_WORDS = 20_000
#: Letters of a piece at most: longer words are scored in several.
PIECE_LETTERS = 60


def _piece_pattern() -> re.Pattern:
    """Matches up to PIECE_LETTERS letters of one script."""
    ranges: dict[str, list[str]] = {}
    for (start, name), (end, _) in zip(SCRIPTS, [*SCRIPTS[1:], (0x110000, "")]):
        ranges.setdefault(name, []).extend(_letter_ranges(start, end))
    return re.compile("|".join(f"[{''.join(found)}]{{1,{PIECE_LETTERS}}}" for found in ranges.values()))


PIECE = _piece_pattern()
LATIN_PIECE = re.compile(f"{_LATIN_LETTER}{{1,{PIECE_LETTERS}}}")
#: The first code point that may belong to another script than Latin.
_BEYOND_LATIN = re.compile(f"[{chr(SCRIPTS[1][0])}-{chr(0x10FFFF)}]")


def piece_pattern(text: str) -> re.Pattern:
    """The pattern whose matches are the pieces of ``text``: its words, cut where the
    script changes and after every PIECE_LETTERS letters, so that each letter is in one."""
    return PIECE if _BEYOND_LATIN.search(text) else LATIN_PIECE


def lowered(text: str) -> str:
    """Lower case, letter by letter where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


class Letters:
    """Pieces of words as one array of code points, each between marks, for work on all at once."""

    def __init__(self, words: list[str]):
        text = "".join([f"<{w}>" for w in words])
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.sizes = np.array([len(w) + 2 for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(words)), self.sizes)

    def grams(self, buckets: int):
        """(bucket of each letter pair, triple and word; the words' numbers), the same in every process."""
        c, n = self.codes, np.uint64(buckets)
        for width in (2, 3):
            h = sum(c[k : len(c) - width + 1 + k] * SEEDS[k] for k in range(width)) + np.uint64(width)
            yield (mix(h) % n).astype(np.int64), self.owner[: len(h)], self.owner[: len(h)] == self.owner[width - 1 :]
        place = (np.arange(len(c)) - self.starts[self.owner]).astype(np.uint64)
        whole = np.add.reduceat(mix(c * SEEDS[0] + place * SEEDS[3]), self.starts)
        yield (mix(whole) % n).astype(np.int64), np.arange(len(self.sizes)), np.ones(len(self.sizes), bool)

    def scripts(self) -> np.ndarray:
        """The script, by number, of most letters of each word; the first by name wins a tie."""
        if not len(self.sizes) or self.codes.max() < _STARTS[1]:
            return np.full(len(self.sizes), _NAMES.index("latin"))
        kind = _KINDS[np.searchsorted(_STARTS, self.codes, side="right") - 1]
        inside = np.ones(len(self.codes), bool)
        inside[self.starts] = inside[self.starts + self.sizes - 1] = False
        tally = np.bincount(self.owner[inside] * len(_NAMES) + kind[inside], minlength=len(self.sizes) * len(_NAMES))
        return tally.reshape(-1, len(_NAMES)).argmax(axis=1)


@dataclass
class LanguageModel:
    """Log-probabilities of hashed letter n-grams for each language, and the scripts each is written in."""

    languages: list[str]
    weights: np.ndarray  # buckets x languages, float32
    scripts: dict[str, np.ndarray]  # candidates of a script, as a mask over languages

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of lower-cased words, a row each; languages that a word's script rules out fall far behind."""
        letters, n = Letters(words), len(words)
        total = np.zeros((n, len(self.languages)))
        for bucket, owner, valid in letters.grams(len(self.weights)):
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(owner[valid], self.weights[bucket[valid], k], n)
        total /= np.sqrt(2 * letters.sizes - 2)[:, None]
        fits = np.stack([self.scripts.get(name, np.zeros(len(self.languages), bool)) for name in _NAMES])[letters.scripts()]
        scores = np.where(fits, np.maximum(total - np.where(fits, total, -np.inf).max(axis=1, keepdims=True, initial=-1e9), -12), -30)
        scores[~fits.any(axis=1)] = 0
        return scores.astype(np.float32)


def fit_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, max_languages: int = 512, buckets: int = 1 << 16) -> LanguageModel:
    """Naive Bayes over letter n-grams, from about ``per_language`` rows of each language.

    The sample is bounded: a row is taken when a hash of its id falls below the
    language's share, so long and short texts and all sources are alike, and of more
    than ``max_languages`` labels the most frequent ones are learnt (ties by name).
    Words are counted where the rows are, into tables of fixed size.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    found = sorted((r.lang, r.n) for r in sizes)
    languages = [lang for lang, _ in found]
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), {})
    at = {lang: k for k, lang in enumerate(languages)}
    spark = labelled.sparkSession
    share = spark.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in found], "lang string, share double")  # max_languages rows
    taken = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_003)).alias("draw"))
    taken = taken.join(F.broadcast(share), "lang").where(F.col("draw") < F.col("share") * 1_000_003).select("lang", "text")
    small_batches(spark)

    def count(batches):
        grams, scripts = np.zeros((len(languages), buckets), np.float64), Counter()
        for langs, texts in blocks(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(langs.to_pylist(), texts.to_pylist()):
                words.setdefault(lang, Counter()).update(piece_pattern(low := lowered(text)).findall(low))
            for lang, counted in words.items():
                listed = list(counted)
                for at_ in range(0, len(listed), SCORED_WORDS):
                    part = listed[at_ : at_ + SCORED_WORDS]
                    letters, n = Letters(part), np.array([counted[w] for w in part])
                    for j, m in zip(*np.unique(letters.scripts(), return_counts=True)):
                        scripts[at[lang], _NAMES[j]] += int(m)
                    for bucket, owner, valid in letters.grams(buckets):
                        # a word counts less and less with each time: templates must not drown the rest
                        grams[at[lang]] += np.bincount(bucket[valid], np.sqrt(n)[owner[valid]], buckets)
        k, bucket = grams.nonzero()
        weight = np.rint(grams[k, bucket] * 1024).astype(np.int64)  # whole numbers add up alike in any order
        by_script = [(j, -1 - _NAMES.index(name), n * 1024) for (j, name), n in scripts.items()]
        columns = list(zip(*by_script)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array([*a, *b], t) for a, b, t in zip((k.tolist(), bucket.tolist(), weight.tolist()), columns, (pa.int32(), pa.int32(), pa.int64()))], ["k", "bucket", "weight"])

    total, by_script = np.zeros((len(languages), buckets), np.float64), {}
    # at most a row for each language and bucket
    table = taken.mapInArrow(count, "k int, bucket int, weight bigint").groupBy("k", "bucket").agg(F.sum("weight").alias("weight")).toArrow()
    for k, bucket, weight in zip(*(table.column(c).to_pylist() for c in ("k", "bucket", "weight"))):
        if bucket >= 0:
            total[k, bucket] = weight / 1024
        else:
            by_script.setdefault(_NAMES[-1 - bucket], np.zeros(len(languages)))[k] = weight / 1024
    smooth = total + 0.5
    weights = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T
    weights -= weights.mean(axis=1, keepdims=True)
    letters = sum(by_script.values(), np.zeros(len(languages)))
    fits = {s: n / np.maximum(letters, 1) >= 0.005 for s, n in by_script.items()}
    return LanguageModel(languages, weights.astype(np.float32), {s: m for s, m in fits.items() if m.any()})


class WordScores:
    """Rows of a score matrix, one for each word met lately."""

    def __init__(self, model: LanguageModel, entries: int = 200_000):
        self.model, self.entries = model, entries
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)), np.float32)

    def block(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The rows' numbers for each list of words; words not met yet are scored together."""
        if len(self.at) > self.entries:
            self._reset()
        fresh = sorted(set().union(*texts).difference(self.at))
        parts = [fresh[k : k + SCORED_WORDS] for k in range(0, len(fresh), SCORED_WORDS)]
        self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh))))
        if parts:
            self.rows = np.concatenate([self.rows, *map(self.model.words, parts)])
        return [np.fromiter(map(self.at.__getitem__, words), np.int32, len(words)) for words in texts]


def viterbi(rows: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, for many word lists at once.

    ``ids`` holds the lists one after another.  Step ``t`` handles word ``t`` of every
    list that has one; lists go longest first, so these are a prefix.
    """
    n_lang = rows.shape[1]
    kind = np.min_scalar_type(max(n_lang - 1, 0))
    if not len(ids):
        return np.empty(0, kind)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    own = np.arange(n_lang, dtype=kind)
    back = np.empty((len(ids), n_lang), kind)
    best = np.zeros((len(starts), n_lang), np.float32)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        n = active[t]
        at = starts[:n] + t
        held = best[:n]
        if t:
            arg = held.argmax(axis=1)
            moved = (held[np.arange(n), arg] - penalty)[:, None]
            stay = held >= moved
            back[at] = np.where(stay, own, arg[:, None].astype(kind))
            held = np.where(stay, held, moved)
        best[:n] = held + rows[ids[at]]
    label = np.empty(len(ids), kind)
    state = best.argmax(axis=1).astype(kind)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return label


def label_languages(df: DataFrame, model: LanguageModel, penalty: float = 6.0, spans: bool = True, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels the words of whole texts, and each text by the language of most of its letters.

    A word is a run of letters; it is scored in pieces, of one script and of
    PIECE_LETTERS letters at most, each of which gets a label.  Most words are one piece.

    Returns ``id, lang_pred, score`` (the share of letters in words of that language,
    0 to 1), ``n_words`` and, with ``spans``, ``spans``: runs of pieces of one language
    as (start, end, lang), by code points.  A null text, or one without a letter, is
    ``und`` with score 0 and no spans; of languages that tie, the first by name wins.
    Repeated rows each get a row; an empty table gives none; other columns are not
    read, but for those in ``carry``, which pass through as ``carried``.  One narrow pass; the model's size is fixed and travels with the tasks.
    """
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats: a few MB

    def run(batches):
        model = shared.value
        scores = WordScores(model)
        for ids, texts, *others in blocks(batches):
            texts = [lowered(t or "") for t in texts.to_pylist()]
            words = [piece_pattern(t).findall(t) if model.languages else [] for t in texts]
            held = scores.block(words)
            letters = [np.fromiter(map(len, w), np.int32, len(w)) for w in words]
            sizes = [len(w) for w in words]
            sizes = np.array(sizes, np.int64)
            starts = np.cumsum(sizes) - sizes
            label = viterbi(scores.rows, np.concatenate(held), starts, sizes, penalty)
            n_words = [len(WORD.findall(t)) if len(w) and (w.max() == PIECE_LETTERS or _BEYOND_LATIN.search(t)) else len(w) for t, w in zip(texts, letters)]
            preds, shares, runs = [], [], []
            for text, start, n, weight in zip(texts, starts.tolist(), sizes.tolist(), letters):
                own = label[start : start + n]
                if n:
                    by_lang = np.bincount(own, weight, len(model.languages))
                    preds.append(model.languages[int(by_lang.argmax())])
                    shares.append(float(by_lang.max() / by_lang.sum()))
                else:
                    preds.append(UNDETERMINED)
                    shares.append(0.0)
                if spans:
                    runs.append(_runs(text, own, model.languages))
            columns = [ids, pa.array(preds), pa.array(shares, pa.float64()), pa.array(n_words, pa.int64())] + ([pa.array(runs, pa.list_(span))] if spans else [])
            yield pa.RecordBatch.from_arrays([*columns, *others], [*["id", "lang_pred", "score", "n_words", "spans"][: len(columns)], *(f"carry{k}" for k in range(len(others)))])

    schema = f"id {kind}, lang_pred string, score double, n_words bigint" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return map_carrying(df, run, schema, id_col, text_col, carry)


def _runs(text: str, label: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of pieces of one language; a span ends with its last piece."""
    if not len(label):
        return []
    pattern = piece_pattern(text)
    if (label == label[0]).all():  # from the first letter to the last one
        end = len(text)
        while not text[end - 1].isalpha():
            end -= 1
        return [{"start": pattern.search(text).start(), "end": end, "lang": languages[label[0]]}]
    turns = np.append(np.flatnonzero(np.diff(label.astype(np.int64), prepend=-1)), len(label)).tolist()
    places = [m.span() for m in pattern.finditer(text)]
    return [{"start": places[a][0], "end": places[b - 1][1], "lang": languages[label[a]]} for a, b in zip(turns, turns[1:])]
