"""Toxic span tagging by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled weakly first: a word, or the beginning of a word, that is met in
many different surroundings in toxic documents and hardly ever in clean ones is a marker. A two-state chain
is then trained on the tokens of the sample. A token's features are its marker strength in steps, whether only a beginning of
a word (an affix) says so, the strength of the tokens beside it, and whether it is shouted. Forward-backward
marginals of markers and their neighbours give the document's score through a logistic fit; runs of tokens whose marginal
reaches one half are the offending offsets.

Away from markers all tokens have the same features, so the chain is multiplied through such a stretch at once, by
a power of a 2 x 2 matrix; results are those of going token by token. Tokens are parts between white space, of any
number. Defined results: null text is empty; a text without markers gets the score that the fit gives to no evidence; if the
sample lacks one of the two labels, every score is that label's share (0 without a sample). Equal texts, equal scores.
Other columns are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm._common import SharedModel, kept_by, map_arrow, slices
from sluice.llm.sampling import fold, labelled_sample

#: Bounds of the learning sample, for each of the two labels.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 12_000_000
#: A marker's least number of different surroundings in toxic documents, and its least log-odds.
LEAST_PLACES, LEAST_ODDS = 4, 2.5
#: Lengths of beginnings of words that may be markers, besides whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Marker strengths that the chain tells apart; 0 is no marker.
STEPS = 6
#: Numbers of values of a token's features: strength, affix only, strength beside it (none, weak, strong), shouted. Their
#: combinations are numbered; 0 is a token that is no marker and has none beside it.
PARTS = (STEPS, 2, 3, 2)
CODES = math.prod(PARTS)
#: Strength from which a neighbour is strong.
STRONG = 3
SEGMENT = 128
ROUNDS = 150
#: What the driver works on at a time while it trains; all are worked on. Places of features, parts of all places, segments.
PLACES_AT_ONCE, PARTS_OF_PLACES, SEGMENTS_AT_ONCE = 1 << 19, 8, 2048
MEMO_ENTRIES = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")


def features(token: str) -> list[str]:
    """Words in a token, in lower case, and their beginnings (marked by a trailing star)."""
    words = _WORD.findall(token.lower())
    return words + [f for n in BEGINNINGS for f in _beginnings(words, n)]


def _beginnings(words: list[str], n: int) -> list[str]:
    return [f"{word[:n]}*" for word in words if len(word) > n]


def parts_of(code: int) -> tuple[int, ...]:
    """The features that a combination stands for."""
    found = []
    for n in reversed(PARTS):
        found.append(code % n)
        code //= n
    return tuple(found[::-1])


#: For each combination a row with a one for each value of a feature that it has.
_FEATURES = np.array([[float(value == v) for value, n in zip(parts_of(c), PARTS, strict=True) for v in range(n)] for c in range(CODES)])


class _Places:
    """The tokens of texts, as numbers, each with a number for the two tokens around it; equal places are kept once."""

    def __init__(self, texts: list[str]):
        numbers: dict[str, int] = {"": 0}
        flat = array("i", [0])
        for text in sorted(set(texts)):  # copies of a document count once
            flat.extend([numbers.setdefault(token, len(numbers)) for token in text.lower().split()])
            flat.append(0)
        at = np.array(flat, np.int32)
        del flat
        around, n = np.zeros(max(0, len(at) - 2), np.int32), 0
        for part in range(PARTS_OF_PLACES):  # numbers are given by parts of the tokens before, as sorting takes several arrays
            rows = np.flatnonzero((at[:-2] % PARTS_OF_PLACES == part) & (at[1:-1] > 0))
            found, number = np.unique(at[rows].astype(np.int64) << 32 | at[rows + 2], return_inverse=True)
            around[rows], n = number + n, n + len(found)
        inner = at[1:-1] > 0
        pairs = _distinct(at[1:-1][inner].astype(np.int64) << 32 | around[inner])
        self.tokens, self.around = list(numbers), (pairs & 0xFFFFFFFF).astype(np.int32)
        self.first = np.searchsorted(pairs, np.arange(len(numbers) + 1) << 32)

    def counts(self, n: int) -> dict[str, int]:
        """Number of different surroundings of each feature of one sort: whole words (n = 0) or beginnings of n letters."""
        numbers: dict[str, int] = {}
        owner, feature = array("i"), array("i")
        for k, token in enumerate(self.tokens):
            words = [token] if token.isalpha() else _WORD.findall(token)
            for f in set(_beginnings(words, n) if n else words):
                owner.append(k)
                feature.append(numbers.setdefault(f, len(numbers)))
        own, of = np.array(feature, np.int32), np.array(owner, np.int32)
        order = np.argsort(own, kind="stable")
        own, of = own[order], of[order]
        many = self.first[of + 1] - self.first[of]
        ends = np.searchsorted(own, np.arange(len(numbers)), "right")  # of the features, which are not cut
        rows = np.cumsum(many)[ends - 1] if len(numbers) else ends
        seen, a = np.zeros(len(numbers), np.int64), 0
        while a < len(numbers):
            done = rows[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(rows, done + PLACES_AT_ONCE, "right")))
            some = slice(ends[a - 1] if a else 0, ends[b - 1])
            start = np.repeat(self.first[of[some]] - np.cumsum(many[some]) + many[some], many[some])
            start += np.arange(len(start))
            places = _distinct(np.repeat(own[some].astype(np.int64) - a << 32, many[some]) | self.around[start])
            seen[a:b] = np.bincount(places >> 32, minlength=b - a)
            a = b
        return dict(zip(numbers, seen.tolist(), strict=True))


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; the given array is sorted in place."""
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def find_markers(toxic: list[str], clean: list[str]) -> dict[str, int]:
    """Strength 1..STEPS-1 of each marker. Copies of a document share surroundings and so count once.

    Places are numbers in arrays, and one sort of feature is counted at a time, some features after others, so that the
    driver's memory stays at a few times that of the sample."""
    sorts, total = (0, *BEGINNINGS), [1, 1]
    often, other = {}, {}
    places = _Places(toxic)
    for n in sorts:
        seen = places.counts(n)
        total[1] += sum(seen.values())
        often[n] = {f: k for f, k in seen.items() if k >= LEAST_PLACES}
    del places, seen
    places = _Places(clean)
    for n in sorts:
        seen = places.counts(n)
        total[0] += sum(seen.values())
        other |= {f: seen.get(f, 0) for f in often[n]}
    del places, seen
    found = {}
    for kept in often.values():
        for f, k in kept.items():
            odds = math.log((k + 0.5) / total[1]) - math.log((other[f] + 0.5) / total[0])
            if odds >= LEAST_ODDS:
                found[f] = 1 + min(STEPS - 2, int(odds - LEAST_ODDS))
    # a beginning says nothing of its own if a shorter one is as strong
    return {f: s for f, s in found.items() if not any(found.get(f"{f.rstrip('*')[:n]}*", 0) >= s for n in BEGINNINGS if n < len(f.rstrip("*")))}


@dataclass
class Chain:
    """Log-potentials: of state 1 against 0 for each observation, and of each step between states."""

    emit: np.ndarray
    step: np.ndarray

    def __post_init__(self) -> None:
        blank = np.exp(self.step + np.array([0.0, self.emit[0]])[None, :])
        values, vectors = np.linalg.eig(blank)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        self._ratio, self._vectors, self._inverse = values[1] / values[0], vectors, np.linalg.inv(vectors)
        self._steps, self._emit = np.exp(self.step), np.exp(self.emit)

    def _stretch(self, n: int) -> np.ndarray:
        """The n-th power of the matrix of a token that is no marker, scaled."""
        return (self._vectors * np.array([1.0, self._ratio**n])) @ self._inverse

    def marginals(self, at: list[int], seen: list[int], n: int) -> list[float]:
        """Probability of state 1 at the places `at` with observations `seen`, of n tokens."""
        forward, alpha, last = [], np.ones(2), -1
        for place, s in zip(at, seen, strict=True):
            if place - last > 1:
                alpha = alpha @ self._stretch(place - last - 1)
            alpha = (alpha @ self._steps) * np.array([1.0, self._emit[s]])
            alpha = alpha / alpha.sum()
            forward.append(alpha)
            last = place
        beta, found, after = np.ones(2), [0.0] * len(at), n
        for k in range(len(at) - 1, -1, -1):
            if after - at[k] > 1:
                beta = self._stretch(after - at[k] - 1) @ beta
            both = forward[k] * beta
            found[k] = float(both[1] / both.sum())
            beta = self._steps @ (np.array([1.0, self._emit[seen[k]]]) * beta)
            beta = beta / beta.sum()
            after = at[k]
        return found


class _Segments:
    """Different segments, the longest first, with their numbers: row i of an array has the i-th tokens, of the first `many[i]` segments."""

    def __init__(self, kinds: list[tuple[tuple[bytes, bytes], int]]):
        length = np.array([len(o) for (o, _), _ in kinds])
        self.many = [int((length > i).sum()) for i in range(length[0])]
        self.obs, self.state = (np.zeros((length[0], len(kinds)), np.uint8) for _ in range(2))
        for k, ((o, s), _) in enumerate(kinds):
            self.obs[: len(o), k], self.state[: len(s), k] = np.frombuffer(o, np.uint8), np.frombuffer(s, np.uint8)
        self.weight, self.length = np.array([n for _, n in kinds], np.float64), length

    def weights(self) -> np.ndarray:
        return (np.arange(len(self.many))[:, None] < self.length) * self.weight

    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of observations in state 1, and of steps between states, as labelled."""
        w = self.weights()
        step = np.bincount((2 * self.state[:-1] + self.state[1:]).ravel(), w[1:].ravel(), 4)
        return np.bincount(self.obs.ravel(), (w * self.state).ravel(), CODES), step.reshape(2, 2)

    def expected(self, emit: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same as a chain expects them; by ratios of state 1 to state 0, forward up to a token and backward after it."""
        w, e = self.weights(), emit[self.obs]
        forward, backward = np.zeros_like(e), np.ones_like(e)
        forward[0] = e[0]
        for i in range(1, len(e)):
            k = self.many[i]
            r = forward[i - 1, :k]
            forward[i, :k] = e[i, :k] * (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r)
        for i in range(len(e) - 2, -1, -1):
            k = self.many[i + 1]
            r = e[i + 1, :k] * backward[i + 1, :k]
            backward[i, :k] = (m[1, 0] + m[1, 1] * r) / (m[0, 0] + m[0, 1] * r)
        both = forward * backward
        found = np.bincount(self.obs.ravel(), (w * both / (1 + both)).ravel(), CODES)
        r, q = forward[:-1], (e * backward)[1:]
        each = w[1:] / (m[0, 0] + m[0, 1] * q + r * (m[1, 0] + m[1, 1] * q))
        zero, one = (each * q).sum(), each * r
        return found, m * np.array([[each.sum(), zero], [one.sum(), (one * q).sum()]])


def fit_chain(observed: list[np.ndarray], states: list[np.ndarray]) -> Chain:
    """Gradient ascent on the conditional log-likelihood of the states, over all segments of the documents; SEGMENTS_AT_ONCE of
    them are in work at a time, as each takes 128 numbers in a dozen arrays."""
    cut = ((o[k : k + SEGMENT].tobytes(), s[k : k + SEGMENT].tobytes()) for o, s in zip(observed, states, strict=True) for k in range(0, len(o), SEGMENT))
    kinds = sorted(Counter(cut).items(), key=lambda kind: -len(kind[0][0]))  # segments without markers are mostly alike
    parts = [_Segments(kinds[k : k + SEGMENTS_AT_ONCE]) for k in range(0, len(kinds), SEGMENTS_AT_ONCE)]
    del kinds
    seen_emit, seen_step = np.zeros(CODES), np.zeros((2, 2))
    for part in parts:
        emit, steps = part.seen()
        seen_emit, seen_step = seen_emit + emit, seen_step + steps
    n = _FEATURES.shape[1]
    weights, step = np.zeros(n), np.zeros((2, 2))
    mean, square = np.zeros(n + 4), np.zeros(n + 4)
    total = max(1.0, sum(float(part.weight @ part.length) for part in parts))
    for t in range(1, ROUNDS + 1):
        more_emit, more_step = seen_emit, seen_step
        for part in parts:
            emit, steps = part.expected(np.exp(_FEATURES @ weights), np.exp(step))
            more_emit, more_step = more_emit - emit, more_step - steps
        grad = np.concatenate([_FEATURES.T @ more_emit, more_step.ravel()]) / total - 1e-6 * np.concatenate([weights, step.ravel()])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        move = 0.15 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-12)
        weights, step = weights + move[:n], step + move[n:].reshape(2, 2)
    return Chain(_FEATURES @ weights, step)


def _evidence(marginals: list[float]) -> tuple[float, float]:
    """Of a document: minus the logarithm of the probability that no marker is toxic, and the expected number that are."""
    return min(20.0, -sum(math.log1p(-min(p, 1 - 1e-9)) for p in marginals)), math.log1p(sum(marginals))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small penalty; x has a column of ones."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (y - p) - 0.05 * beta)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return beta


@dataclass
class Model:
    markers: dict[str, int]
    chain: Chain | None
    beta: np.ndarray
    share: float

    def own(self, token: str) -> int:
        """Strength, affix and shout of a token by itself, as a combination without neighbours; 0 if it is no marker."""
        found = [(self.markers.get(f, 0), f.endswith("*")) for f in features(token)]
        strength = max((s for s, _ in found), default=0)
        if not strength:
            return 0
        affix = all(a for s, a in found if s == strength)
        return (strength * PARTS[1] + affix) * PARTS[2] * PARTS[3] + (token.isupper() or "!" in token)

    def score(self, marginals: list[float]) -> float:
        if self.chain is None:
            return self.share
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.beta @ np.array([1.0, *_evidence(marginals)]))))))


def train(sample: list[tuple[int, str]]) -> Model:
    """A model of (label, text) pairs, label 1 for toxic."""
    toxic, clean = [t for y, t in sample if y == 1], [t for y, t in sample if y == 0]
    if not toxic or not clean:
        return Model({}, None, np.zeros(3), 1.0 if toxic else 0.0)
    model = Model(find_markers(toxic, clean), None, np.zeros(3), len(toxic) / len(sample))
    tagger = _Tagger(model)
    observed = [tagger.observe(text.split()) for text in [*toxic, *clean]]
    marker = np.array([parts_of(c)[0] > 0 for c in range(CODES)])
    states = [marker[o] * np.uint8(k < len(toxic)) for k, o in enumerate(observed)]
    model.chain = fit_chain([o for o in observed if len(o)], [s.astype(np.uint8) for s in states if len(s)])
    x = np.array([[1.0, *_evidence(tagger.marginals(o))] for o in observed])
    model.beta = fit_logistic(x, np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return model


class _Tagger:
    """A model with what it says of the tokens that a worker has met by themselves."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def observe(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for token in set(tokens).difference(memo):
            memo[token] = self.model.own(token)
        own = np.frombuffer(bytes(map(memo.__getitem__, tokens)), np.uint8)
        if not own.any():
            return own
        strength = own // (PARTS[1] * PARTS[2] * PARTS[3])
        beside = np.maximum(np.append(strength[1:], 0), np.insert(strength[:-1], 0, 0))
        return own + PARTS[3] * ((beside > 0).astype(np.uint8) + (beside >= STRONG))

    def marginals(self, observed: np.ndarray) -> list[float]:
        at = np.flatnonzero(observed)
        if not len(at) or self.model.chain is None:
            return []
        return self.model.chain.marginals(at.tolist(), observed[at].tolist(), len(observed))

    def score(self, text: str) -> float:
        return self.model.score(self.marginals(self.observe(text.split())))

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end (characters) and least marginal of each run of toxic tokens."""
        places = [m.span() for m in _TOKEN.finditer(text)]
        observed = self.observe([text[a:b] for a, b in places])
        found: list[list] = []
        last = -2
        for k, p in zip(np.flatnonzero(observed).tolist(), self.marginals(observed), strict=False):
            if p >= 0.5:
                if k == last + 1:
                    found[-1][1:] = [places[k][1], min(p, found[-1][2])]
                else:
                    found.append([*places[k], p])
                last = k
        return [tuple(f) for f in found]


_TAGGERS: dict[int, _Tagger] = kept_by(__name__)


def _tagger(model: SharedModel) -> _Tagger:
    if model.bid not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[model.bid] = _Tagger(model.value)
    return _TAGGERS[model.bid]


def _score(model: SharedModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tagger = _tagger(model)
    for batch in slices(batches):
        scores = [tagger.score(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["key", "score"])


def _judged(model: SharedModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tagger = _tagger(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
    for batch in slices(batches):
        scores, found = [], []
        for text in batch.column(1).to_pylist():
            marginals = tagger.marginals(tagger.observe((text or "").split()))
            scores.append(tagger.model.score(marginals))
            spans = tagger.spans(text) if max(marginals, default=0.0) >= 0.5 else []
            found.append([dict(zip(("start", "end", "marginal"), s, strict=True)) for s in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["key", "score", "spans"])


def _kept(model: SharedModel, at: int, limit: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tagger = _tagger(model)
    for batch in slices(batches):
        yield batch.filter(pa.array([tagger.score(t or "") < limit for t in batch.column(at).to_pylist()], pa.bool_()))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the labelled rows whose key's crc32 modulo 3 is not 1, from a sample bounded by SAMPLE_DOCS and
    SAMPLE_CHARS for each label. Keys are chosen before texts are read, so only bounded rows are broadcast."""
    known = labels.where((fold(key, 3) != 1) & F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).alias("_label")).distinct()
    order = F.xxhash64(F.col("_key").cast("string"), F.lit("chosen"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    place = F.shiftrightunsigned(order, 12) / float(1 << 52)
    some = [known.where((F.col("_label") == y) & (place < min(1.0, 2.0 * SAMPLE_DOCS / n))) for y, n in counts.items()]
    if not some:
        return train([])
    chosen = some[0] if len(some) == 1 else some[0].union(some[1])
    chosen = chosen.withColumn("_n", F.row_number().over(W.partitionBy("_label").orderBy(order, "_key"))).where(F.col("_n") <= SAMPLE_DOCS).drop("_n")
    rows = docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("_key"))
    return train([(r[0], r[1]) for r in labelled_sample(rows, key, "_label", text, SAMPLE_DOCS, SAMPLE_CHARS)])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of each row."""
    shared = SharedModel(docs.sparkSession, model)
    return map_arrow(docs.select(key, text), _score, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double", shared)


def judged(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and spans (start, end, marginal) of each row; offsets in characters."""
    shared = SharedModel(docs.sparkSession, model)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, spans array<struct<start:long,end:long,marginal:double>>"
    return map_arrow(docs.select(key, text), _judged, schema, shared)


def tag(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans of each row."""
    return judged(docs, model, key, text).select(key, "spans")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.7) -> DataFrame:
    """The rows that score below the limit, with all their columns."""
    return map_arrow(docs, _kept, docs.schema, SharedModel(docs.sparkSession, model), docs.columns.index(text), limit)


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = judged(docs, learn(docs, labels))
    shown = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), shown.alias("toxic_spans"))
