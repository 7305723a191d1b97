"""Toxicity by a linear-chain conditional random field over tokens.

Labels are of whole documents, so token labels are induced: features of tokens (the word, its beginnings)
are counted by document in Spark over the labelled sample; those that stand in toxic documents far beyond chance
mark the toxic tokens of toxic documents. A two-state chain (clean, toxic) is then trained on these tokens and their
surroundings by maximum likelihood, with gradients from forward-backward. Every document is tagged by
forward-backward marginals: tokens whose marginal passes one half give spans, and the marginals together,
through two fitted weights, give the document's score.

Runs of tokens without a known feature have equal factors; their part of the chain is a matrix power, so a
text costs its informative tokens, and is exact at any length.

Defined results: null text counts as empty, and texts without tokens score as any clean text; without labels of
both kinds all scores are 0; repeated rows are scored each for itself; a null label is no label.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import ddl, frugal, materialize, texts_of

#: Labelled documents the model is fitted on (the least by hash of their ids), and features kept.
SAMPLE_DOCS, MAX_FEATURES = 20_000, 4_000
#: A feature must stand in so many toxic documents, and be so many times likelier there than in clean ones.
LEAST_DOCS, LEAST_LIFT = 4, 12.0
RADIUS, EPOCHS, L2 = 3, 150, 1e-3
_TOKEN = re.compile(r"[^\W_]+")
#: Steps between informative tokens whose matrix powers are kept; longer ones are made of squares.
_POWERS = 512


def words_of(text: str) -> list[str]:
    """The tokens of a text, lower-cased: as many, and in the same order, as in the text as it is."""
    low = text.lower()
    # A letter whose lower case is longer would move the borders of tokens.
    return _TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in _TOKEN.findall(text)]


def features_of(word: str) -> list[str]:
    """The word and its beginnings of 3 to 6 letters."""
    return [f"={word}", *(f"^{word[:k]}" for k in range(3, 7) if len(word) >= k)]


def _labelled(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str, sample_docs: int) -> DataFrame:
    """Text and label of the sample: a lookup table of at most sample_docs ids goes to all tasks, no text moves."""
    picked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("__label"))
    picked = picked.orderBy(F.xxhash64(key), key).limit(sample_docs)
    return docs.select(key, text).join(F.broadcast(picked), key).select(F.col(text).alias("text"), F.col("__label").cast("int").alias("label"))


def _document_features(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = set(words_of(text))
                count[int(label > 0)].update({f for w in words for f in features_of(w)})
            both = [(f, n, 0) for f, n in count[1].items()] + [(f, 0, n) for f, n in count[0].items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in both], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], names=["feature", "toxic", "clean"])

    return sample.mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def pick_features(sample: DataFrame) -> list[str]:
    """Features that mark toxic documents, the strongest first."""
    totals = {r["label"]: r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return []
    least = max(LEAST_DOCS, 0.01 * totals[1])
    lift = (F.col("toxic") / totals[1]) / ((F.col("clean") + 0.5) / totals[0])
    found = _document_features(sample).where((F.col("toxic") >= least) & (lift >= LEAST_LIFT))
    return [r["feature"] for r in found.orderBy(F.desc(lift), "feature").limit(MAX_FEATURES).collect()]


def _windows(sample: DataFrame, known: dict[str, int], fraction: float) -> tuple[list[list[list[int]]], list[list[int]], np.ndarray]:
    """Token windows as lists of feature numbers, their tags, and how often each occurs: around all marked tokens, and everywhere else by fraction.

    Equal windows are counted in Spark, so that their number follows the features more than the texts' lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                found = [[known[f] for f in features_of(w) if f in known] for w in words]
                hits = [k for k, x in enumerate(found) if x]
                every = max(1, int((2 * RADIUS + 1) / fraction))
                for k in sorted({*hits, *range(RADIUS, len(words), every)}):
                    a, b = max(0, k - RADIUS), min(len(words), k + RADIUS + 1)
                    xs.append(json.dumps(found[a:b]))
                    ys.append(json.dumps([int(label > 0 and bool(x)) for x in found[a:b]]))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.string()), pa.array(ys, pa.string())], names=["x", "y"])

    rows = sample.mapInArrow(run, "x string, y string").groupBy("x", "y").agg(F.count("*").alias("n")).orderBy("x", "y").collect()
    return [json.loads(r["x"]) for r in rows], [json.loads(r["y"]) for r in rows], np.array([r["n"] for r in rows], dtype=float)


def train_chain(xs: list[list[list[int]]], ys: list[list[int]], n_features: int, times: np.ndarray | None = None) -> dict:
    """Weights of the chain by gradient ascent (Adam) on the log-likelihood of tags, all windows at once, each as often as `times` says."""
    times = np.ones(len(xs)) if times is None else times
    n, t = len(xs), max(map(len, xs))
    length = np.array([len(x) for x in xs])
    tags = np.zeros((n, t), dtype=int)
    where, which = [], []
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        tags[k, : len(y)] = y
        for j, fs in enumerate(x):
            where += [k * t + j] * len(fs)
            which += fs
    where, which = np.array(where, dtype=int), np.array(which, dtype=int)
    live = np.arange(t)[None] < length[:, None]
    w = np.zeros(n_features + 1 + 4)  # emissions of toxic, its bias, transitions
    m, v = np.zeros_like(w), np.zeros_like(w)
    pair_seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair_seen[a, b] = times @ ((tags[:, :-1] == a) & (tags[:, 1:] == b) & live[:, 1:]).sum(axis=1)
    for step in range(1, EPOCHS + 1):
        emit = np.bincount(where, w[which], n * t).reshape(n, t) + w[n_features]
        e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], axis=2)
        move = np.exp(w[-4:].reshape(2, 2))
        alpha, scale = np.empty((n, t, 2)), np.ones((n, t))
        alpha[:, 0] = e[:, 0] / 2
        for k in range(t):
            if k:
                alpha[:, k] = np.where(live[:, k, None], (alpha[:, k - 1] @ move) * e[:, k], alpha[:, k - 1])
            scale[:, k] = alpha[:, k].sum(axis=1)
            alpha[:, k] /= scale[:, k, None]
        beta = np.ones((n, t, 2))
        pair = np.zeros((2, 2))
        for k in range(t - 2, -1, -1):
            ahead = e[:, k + 1] * beta[:, k + 1]
            joint = alpha[:, k, :, None] * move * ahead[:, None, :]
            joint *= (live[:, k + 1] / joint.sum(axis=(1, 2)))[:, None, None]
            pair += np.tensordot(times, joint, 1)
            back = ahead @ move.T
            beta[:, k] = np.where(live[:, k + 1, None], back / back.sum(axis=1, keepdims=True), 1.0)
        gamma = alpha * beta
        gamma = (gamma[:, :, 1] / gamma.sum(axis=2)) * live
        off = ((tags * live - gamma) * times[:, None]).ravel()
        g = np.concatenate([np.bincount(which, off[where], n_features), [off.sum()], (pair_seen - pair).ravel()]) / times.sum() - L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"emit": w[:n_features], "bias": float(w[n_features]), "move": np.exp(w[-4:].reshape(2, 2))}


class ToxicityModel:
    """A trained chain, the numbers of its features, and the document weights (slope and intercept of the score)."""

    def __init__(self, features: list[str], chain: dict | None):
        self.known = {f: k for k, f in enumerate(features)}
        self.chain, self.slope, self.intercept = chain, 1.0, 0.0
        self.cache: dict[str, float] = {}
        if chain:
            step = chain["move"] * np.array([1.0, np.exp(chain["bias"])])[None, :]
            power, self.powers = np.eye(2), []
            for _ in range(_POWERS):
                self.powers.append(power)
                power = power @ step
                power = power / power.sum()
            self.squares = [step / step.sum()]
            for _ in range(40):
                power = self.squares[-1] @ self.squares[-1]
                self.squares.append(power / power.sum())

    def run(self, n: int) -> np.ndarray:
        """The n-th power of a step over a token without features, up to a factor."""
        if n < _POWERS:
            return self.powers[n]
        power = np.eye(2)
        for k in range(n.bit_length()):
            if n >> k & 1:
                power = power @ self.squares[k]
        return power / power.sum()

    def gain(self, word: str) -> float:
        """What a word's features add to the emission of toxic; 0 for a word without any."""
        found = self.cache.get(word)
        if found is None:
            found = float(sum(self.chain["emit"][self.known[f]] for f in features_of(word) if f in self.known))
            if len(self.cache) < 100_000:
                self.cache[word] = found
        return found

    def marginals(self, words: list[str]) -> list[tuple[int, float]]:
        """(token, probability of toxic) of the informative tokens, by forward-backward over the whole text."""
        get, cache = self.gain, self.cache
        told = [(k, g) for k, w in enumerate(words) if (g := cache[w] if w in cache else get(w))]
        if not told:
            return []
        bias = np.exp(self.chain["bias"])
        run = self.run
        move, emits = self.chain["move"], [np.array([1.0, bias * np.exp(np.clip(g, -30, 30))]) for _, g in told]
        alphas, at = [], -1
        alpha = None
        for (k, _), e in zip(told, emits, strict=True):
            if alpha is None:
                alpha = np.array([0.5, 0.5]) * e if k == 0 else (np.array([0.5, 0.5 * bias]) @ run(k - 1) @ move) * e
            else:
                alpha = (alpha @ run(k - at - 1) @ move) * e
            alpha = alpha / alpha.sum()
            alphas.append(alpha)
            at = k
        beta, out = run(len(words) - 1 - at) @ np.ones(2), []
        for j in range(len(told) - 1, -1, -1):
            both = alphas[j] * beta
            out.append((told[j][0], float(both[1] / both.sum())))
            if j:
                beta = run(told[j][0] - told[j - 1][0] - 1) @ (move @ (emits[j] * beta))
                beta = beta / beta.sum()
        return out[::-1]

    def weight(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        """Expected number of toxic tokens among the informative ones, and their marginals."""
        if not self.chain:
            return 0.0, []
        found = self.marginals(words_of(text))
        return sum(p for _, p in found), found

    def score(self, weight: float) -> float:
        if not self.chain:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log1p(20 * weight) + self.intercept, -30, 30))))

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}


def _fit_score(weights: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve on the documents' weights, by Newton steps."""
    x = np.stack([np.log1p(20 * weights), np.ones_like(weights)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-1 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (labels - p) - 1e-1 * w)
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """A model fitted on at most sample_docs labelled documents. Only its features and windows come to the driver."""
    sample = materialize(_labelled(docs, labels, key, label, text, sample_docs), "labelled")
    features = pick_features(sample)
    if not features:
        return ToxicityModel([], None)
    known = {f: k for k, f in enumerate(features)}
    xs, ys, times = _windows(sample, known, 0.02)
    model = ToxicityModel(features, train_chain(xs, ys, len(features), times))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.weight(t)[0] for t in texts_of(batch.column(0))], pa.float64()), batch.column(1)], names=["weight", "label"])

    pairs = sample.mapInArrow(weigh, "weight double, label int").toPandas()
    model.slope, model.intercept = _fit_score(pairs["weight"].to_numpy(), (pairs["label"] > 0).to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, score and spans of every row: spans are (s, e) code points of the tokens tagged toxic.

    A column to keep that is itself called score or spans gives way to the operator's.
    """
    keep = tuple(c for c in keep if c.lower() not in ("score", "spans"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights
    kept = docs.select(*keep, F.col(text).alias("text of the row"))
    schema = ddl(docs.select(*keep), "score double", "spans array<struct<s:int,e:int>>")
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            scores, spans = [], []
            for text in texts_of(batch.column(batch.num_columns - 1)):
                weight, found = tagger.weight(text)
                scores.append(tagger.score(weight))
                toxic = {k for k, p in found if p >= 0.5}
                spans.append([{"s": m.start(), "e": m.end()} for k, m in enumerate(_TOKEN.finditer(text)) if k in toxic] if toxic else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(spans, span)], names=[*keep, "score", "spans"])

    return kept.mapInArrow(frugal(run), schema)


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of docs that score under `least`, whole and in place: no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            clean = [tagger.score(tagger.weight(t)[0]) < least for t in texts_of(batch.column(at))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
