"""Language identification by interpolated Kneser-Ney character models.

One model per language, over the letters of a word between a start and an end sign. The n-grams of all languages lie
in one array of sorted 64-bit hashes, with a column of log-probabilities and one of back-off weights for each language.
A text's language is the one of lowest cross-entropy per character; ties go to the language first in order.

The score is the probability of that language among the learned ones, at the temperature that calibration texts ask
for, times the probability that the text is in a learned language at all: its cross-entropy against those
of calibration texts, with more room for short texts. `reject_below` of `keep_known` acts on this score.

Defined results: null texts and texts without a letter are `und`, score 0, and so are all texts if nothing was
learned. Texts of any length are read whole. Equal texts get equal results, repeated rows a row each. Columns other than
key, text and, in learning, language are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import SharedModel, kept_by, map_arrow, slices
from sluice.llm.sampling import fold, labelled_sample

ORDER = 5
#: Bounds of the learning sample of each language.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 2_000_000
#: Signs that a character of no learned language shares a probability with.
SIGNS = 5000
MEMO_ENTRIES = 200_000
START, STOP = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")
_RNG = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RNG.integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    found = _WORD.findall(text.lower())
    found = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found]
    return [w for w in found if w]


class Grams:
    """Hashes of all n-grams of a list of words; entry [n - 1][i] is that of the n characters up to place i."""

    def __init__(self, words: list[str]):
        chars = np.frombuffer("".join(f"{START}{w}{STOP}" for w in words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.word = np.repeat(np.arange(len(words)), sizes)
        #: Place within the word; the start sign is at 0 and is not predicted.
        self.at = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.hashes, h = [], np.zeros(len(chars), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(ORDER):
                back = np.concatenate([np.zeros(min(n, len(chars)), np.uint32), chars[: max(0, len(chars) - n)]])
                h = h + (back.astype(np.uint64) + np.uint64(1)) * _FACTORS[n]
                x = h ^ (h >> np.uint64(29))
                self.hashes.append((x * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(n))


def _kneser_ney(weights: Counter) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """(hashes, log-probabilities) of each order 1..ORDER and (hashes, log back-off weights) of each context length 0..ORDER-1."""
    words = sorted(weights)
    g = Grams(words)
    weight = np.array([weights[w] for w in words], np.float64)[g.word]
    probs, backs = [], []
    for n in range(1, ORDER + 1):
        places = np.flatnonzero((g.at >= 1) & (g.at >= n - 1))
        keys, first, inverse = np.unique(g.hashes[n - 1][places], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weight[places])
        if n < ORDER:  # as many as the different characters that stand before, unless nothing can
            longer = np.flatnonzero(g.at >= n)
            _, one = np.unique(g.hashes[n][longer], return_index=True)
            seen = np.bincount(np.searchsorted(keys, g.hashes[n - 1][longer[one]]), minlength=len(keys))
            count = np.where(g.at[places[first]] == n - 1, count, seen)
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        if n == 1:
            context = np.zeros(len(keys), np.uint64)
        else:
            context = g.hashes[n - 2][places[first] - 1]
        contexts, of = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(of, count), np.bincount(of)
        back = discount * kinds / total
        below = np.full(len(keys), 1 / SIGNS)
        if n > 1:
            under_keys, under = probs[-1]
            below = np.exp(under[np.searchsorted(under_keys, g.hashes[n - 2][places[first]])])
        probs.append((keys, np.log(np.maximum(count - discount, 0) / total[of] + back[of] * below)))
        backs.append((contexts, np.log(back)))
    return probs, backs


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray  # sorted hashes of n-grams of all orders
    logp: np.ndarray  # [key, language]; NaN where the language lacks the n-gram
    back: np.ndarray  # [key, language]; 0 where the language lacks the context
    back0: np.ndarray  # [language]
    mean: np.ndarray  # cross-entropy of calibration texts, per language
    spread: np.ndarray  # and the standard deviation of a character's
    temperature: float

    def __post_init__(self) -> None:
        self.padded = np.append(self.keys, np.uint64(0))  # so that -1 is a place

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability [word, language] and predicted characters of each word."""
        if not words:
            return np.zeros((0, len(self.langs))), np.zeros(0)
        g = Grams(words)
        n_chars = len(g.at)
        score = np.full((n_chars, len(self.langs)), -np.log(SIGNS))
        before = np.zeros(n_chars, np.int64) - 1  # index of the context among the keys
        for n in range(1, ORDER + 1):
            h = g.hashes[n - 1]
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = -1
            at[self.padded[at] != h] = -1
            at[g.at < n - 1] = -1
            if n == 1:
                score = score + self.back0
            else:
                context = np.concatenate([[-1], before[:-1]])
                score = score + np.where((context >= 0)[:, None], self.back[context], 0.0)
            own = self.logp[at]
            known = (at >= 0)[:, None] & ~np.isnan(own)
            score = np.where(known, own, score)
            before = at
        predicted = g.at >= 1
        sums = np.stack([np.bincount(g.word[predicted], score[predicted, k], len(words)) for k in range(len(self.langs))], axis=1)
        return sums, np.bincount(g.word[predicted], minlength=len(words)).astype(np.float64)

    def decide(self, logp: np.ndarray, chars: float) -> tuple[str, float]:
        """Language and score of a text from its log-probabilities and predicted characters."""
        if not chars or not self.langs:
            return "und", 0.0
        entropy = -logp / chars
        best = int(np.argmin(entropy))
        among = np.exp((entropy[best] - entropy) * min(chars, 200.0) / self.temperature)
        room = self.mean[best] + 1.0 + 6.0 * self.spread[best] / np.sqrt(chars) - entropy[best]
        return self.langs[best], float(1 / among.sum() / (1 + np.exp(-np.clip(8.0 * room, -500, 500))))


def train(sample: list[tuple[str, str]]) -> Model:
    """A model of (language, text) pairs; every fifth text of a language calibrates instead, if there are five."""
    texts: dict[str, list[str]] = {}
    for lang, text in sample:
        texts.setdefault(lang, []).append(text)
    langs, learned = [], []
    for lang in sorted(texts):
        own = [t for k, t in enumerate(texts[lang]) if len(texts[lang]) < 5 or k % 5]
        if weights := Counter(chain.from_iterable(map(words_of, own))):
            langs.append(lang)
            learned.append(_kneser_ney(weights))
    n = len(langs)
    arrays = [keys for probs, backs in learned for keys, _ in [*probs, *backs[1:]]]
    keys = np.unique(np.concatenate(arrays)) if arrays else np.zeros(0, np.uint64)
    logp, back = np.full((len(keys) + 1, n), np.nan), np.zeros((len(keys) + 1, n))  # the last row stands for "absent"
    back0 = np.zeros(n)
    for k, (probs, backs) in enumerate(learned):
        for own, values in probs:
            logp[np.searchsorted(keys, own), k] = values
        for own, values in backs[1:]:
            back[np.searchsorted(keys, own), k] = values
        back0[k] = backs[0][1][0]
    model = Model(langs, keys, logp, back, back0, np.zeros(n), np.ones(n), 1.0)
    margins = []
    for k, lang in enumerate(langs):
        each = [t for j, t in enumerate(texts[lang]) if len(texts[lang]) < 5 or not j % 5]
        words = [w for t in each for w in words_of(t)]
        sums, chars = model.score_words(words)
        if len(words):
            model.mean[k] = -sums[:, k].sum() / chars.sum()
            model.spread[k] = np.sqrt((((-sums[:, k] - model.mean[k] * chars) ** 2).sum() / chars.sum()))
            if n > 1:
                margins.append((np.sort(-sums.sum(axis=0))[1] + sums[:, k].sum()) / chars.sum())
    # a text of 20 characters with a third of the usual margin is to score about 0.9
    model.temperature = max(0.05, min(margins) * 20 / 3 / np.log(9 * max(1, n - 1))) if margins and min(margins) > 0 else 1.0
    return model


class _Scorer:
    """Scores of pieces between blanks, kept by a worker."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((MEMO_ENTRIES + 1, len(model.langs) + 1))

    def _fresh(self, pieces: list[str]) -> np.ndarray:
        per = [words_of(p) for p in pieces]
        sums, chars = self.model.score_words([w for ws in per for w in ws])
        owner = np.repeat(np.arange(len(pieces)), [len(ws) for ws in per])
        cols = [np.bincount(owner, c, len(pieces)) for c in [*sums.T, chars]]
        return np.stack(cols, axis=1)

    def batch(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        split = [t.split() for t in texts]
        needed = {p for ps in split for p in ps}
        missing = sorted(needed - self.rows.keys())
        if len(self.rows) + len(missing) > MEMO_ENTRIES:
            self.rows.clear()
            missing = sorted(needed)
        if len(missing) > MEMO_ENTRIES:  # more different pieces than the memo holds: text by text
            for ps in split:
                yield self._decide(np.concatenate([self._fresh(ps[k : k + 65536]).sum(axis=0)[None] for k in range(0, len(ps), 65536)] or [self.table[:0]]).sum(axis=0))
            return
        at = len(self.rows)
        for k in range(0, len(missing), 16384):
            some = missing[k : k + 16384]
            self.table[at + k : at + k + len(some)] = self._fresh(some)
        self.rows.update(zip(missing, range(at, at + len(missing)), strict=True))
        for ps in split:
            rows = np.fromiter(map(self.rows.__getitem__, ps), np.int64, len(ps))
            yield self._decide(self.table[rows].sum(axis=0))

    def _decide(self, sums: np.ndarray) -> tuple[str, float]:
        return self.model.decide(sums[:-1], sums[-1])


_SCORERS: dict[int, _Scorer] = kept_by(__name__)


def _scorer(model) -> _Scorer:
    if model.bid not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.bid] = _Scorer(model.value)
    return _SCORERS[model.bid]


def _predict(model: SharedModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(model)
    for batch in slices(batches):
        found = list(scorer.batch([t or "" for t in batch.column(1).to_pylist()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["key", "lang_pred", "score"])


def _kept(model: SharedModel, at: int, below: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(model)
    for batch in slices(batches):
        keep = [lang != "und" and score >= below for lang, score in scorer.batch([t or "" for t in batch.column(at).to_pylist()])]
        yield batch.filter(pa.array(keep, pa.bool_()))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Models of the languages in the rows whose key's crc32 modulo 5 is not 0, from a sample bounded by
    SAMPLE_DOCS and SAMPLE_CHARS for each language."""
    sample = labelled_sample(docs.where(fold(key, 5) != 0).select(key, text, lang), key, lang, text, SAMPLE_DOCS, SAMPLE_CHARS)
    return train([(r[0], r[1]) for r in sample])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of each row."""
    shared = SharedModel(docs.sparkSession, model)
    return map_arrow(docs.select(key, text), _predict, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double", shared)


def keep_known(docs: DataFrame, model: Model, text: str = "text", reject_below: float = 0.3) -> DataFrame:
    """The rows whose text is in a learned language, with all their columns."""
    shared = SharedModel(docs.sparkSession, model)
    return map_arrow(docs, _kept, docs.schema, shared, docs.columns.index(text), reject_below)


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
