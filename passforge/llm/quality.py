"""Quality classifier by Bradley-Terry pairwise ranking (operator 3).

A document is described by a fixed vector of surface statistics of its text (never its
id, language, source or label). Preference pairs are (a document marked good, one marked
bad); the weights maximise the likelihood that the good one wins, i.e. the logistic loss
on the difference of the two feature vectors. The learned score ranks documents; the
threshold is the quantile of the training scores at the share of bad labels, and the
reported score is a logistic of the distance from that threshold, so it is 0.5 there.

Learning uses about ``max_labelled`` labelled documents outside the held-out fold (chosen
by a hash of the id, never above twice that) and ``max_pairs`` pairs; both are parameters. Only the
feature vectors of that sample reach the driver. Scoring is one pass over all documents.

Defined cases: a null text equals the empty text, whose features are zero; a label row
without a document or with a null label teaches nothing; without labels of both kinds
every score is 0.5; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, crc_mod, text_or_empty

FOLDS, HELD_OUT = 3, 1
MAX_LABELLED = 20_000
MAX_PAIRS = 60_000

_KIND = np.zeros((6, 256))
for _b in range(256):
    _c = chr(_b)
    _KIND[0, _b] = 0x41 <= _b <= 0x5A                      # capital
    _KIND[1, _b] = 0x61 <= _b <= 0x7A or _b >= 0x80        # other letters (and parts of them)
    _KIND[2, _b] = 0x30 <= _b <= 0x39                      # digit
    _KIND[3, _b] = _b < 0x80 and _c in ".,;:?'\"()-"       # prose punctuation
    _KIND[4, _b] = 0x21 <= _b <= 0x7E and not _c.isalnum() and _c not in ".,;:?'\"()-"  # other signs
    _KIND[5, _b] = _b == 0x20 or 0x09 <= _b <= 0x0D        # blank
_SIGNS = frozenset(b for b in range(128) if _KIND[4, b])


def features(text: str) -> list[float]:
    """Surface statistics of one text; all zero for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    kinds = _KIND @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    counts = Counter(words)
    top = counts.most_common(3)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends_sign = sum(w[-1] in _SIGNS for w in words)
    bare = sum(1 for w in words if len(w) == 1 and w[0] in _SIGNS)
    shout = sum(w.isupper() and len(w) > 1 for w in words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    stops = sum(w[-1] in b".?!" for w in words)
    long_words = sum(len(w) > 24 for w in words)
    letters = kinds[0] + kinds[1]
    base = [
        *(kinds / size), kinds[0] / max(1.0, letters), len(counts) / n, (len(counts) / n) * np.log1p(n) / 8,
        top[0][1] / n, sum(c for _, c in top) / n, ends_sign / n, bare / n, shout / n, same / max(1, n - 1),
        stops / n, long_words / n, (size - kinds[5]) / n / 10, len(set(lines)) / max(1, len(lines)),
        np.log1p(n) / 8, np.log1p(n / max(1, len(lines))) / 5,
    ]
    signs = kinds[4] / size
    base += [np.log1p(100 * signs), np.log1p(100 * shout / n), np.log1p(100 * same / max(1, n - 1)),
             np.log1p(100 * bare / n), float(signs > 0.04), float(shout > 0.3 * n), float(same > 0.3 * n),
             float(bare > 0.15 * n), float(n < 5)]
    return [float(x) for x in base]


N_FEATURES = 30


@dataclass
class Ranker:
    """Linear Bradley-Terry scores: ``weights`` on standardised features, cut at ``threshold``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.threshold) / self.spread
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Bradley-Terry weights by Newton steps on the logistic loss of feature differences."""
    d = x.shape[1] if x.size else N_FEATURES
    pos, neg = x[good], x[~good]
    if not len(pos) or not len(neg):
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(seed)
    m = min(max_pairs, max(4 * (len(pos) + len(neg)), 1000))
    diff = (pos[rng.integers(len(pos), size=m)] - neg[rng.integers(len(neg), size=m)]) / scale
    w = np.zeros(d)
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance that the bad one wins
        grad = diff.T @ p / m - ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / m + ridge * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w = w + step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-6:
            break
    raw = ((x - mean) / scale) @ w
    ordered = np.sort(raw)
    k = int((~good).sum())  # as many documents below the threshold as there are bad labels
    threshold = float((ordered[k - 1] + ordered[min(k, len(ordered) - 1)]) / 2)
    spread = max(1e-6, float(np.std(raw)) / 4)
    return Ranker(mean, scale, w, threshold, spread)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", fold: Column | None = None) -> Ranker:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    chosen = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .filter(fold if fold is not None else crc_mod(id_col, FOLDS) != HELD_OUT)
              .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__good")))
    chosen = bounded_sample(chosen, F.col("__id"), max_labelled)
    # at most 2 max_labelled rows of two numbers are broadcast
    rows = docs.select(F.col(id_col).alias("__doc"), text_or_empty(text_col).alias("__text")).join(
        F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    vectors = rows.select("__id", "__good", _features_udf()("__text").alias("x")).toPandas()
    if not len(vectors):
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, bool))
    vectors = vectors.sort_values(["__id", "__good"], kind="stable")
    return fit(np.stack(vectors["x"].to_numpy()), (vectors["__good"] == 1).to_numpy())


def _features_udf():
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t) for t in texts], dtype=object)
    return run


def score_column(model: Ranker, text: Column) -> Column:
    """Score (0 to 1) of a text column."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), N_FEATURES)
            yield pd.Series(model.score(x), dtype="float64")
    return run(text_or_empty(text))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    bound_batches(docs.sparkSession)
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, FOLDS) == HELD_OUT).alias("held_out"),
                      score_column(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score reaches 0.5, with their own columns."""
    bound_batches(docs.sparkSession)
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return docs.filter(score_column(model, F.col(text_col)) >= 0.5)
