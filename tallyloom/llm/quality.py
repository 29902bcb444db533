"""Quality classifier: a Bradley-Terry model of documents, learned from preference pairs.

Every pair of a good and a bad labelled document says that the good one is preferred. The model gives a
document the score ``w . x``; the probability that i is preferred to j is the logistic function of
``w . (x_i - x_j)``, whose loss is minimised by Newton steps with a ridge. The scores of the training
documents then fix the threshold: the quantile that sets the most of them right. Published scores are
logistic in the distance from it and equal ``CUT`` there.

The features describe the form of the text alone: shares of character classes, repetition of words,
neighbouring words and lines, lengths. They are expanded into steps at training quantiles, so that
either end of a feature's range can speak against a document.

Fitting uses a bounded sample of the labelled rows (``sample_rows``, by hash of the id) and as many
``pairs``; scoring covers every row. Defined results: a null text counts as empty and is scored; rows
without label or with contradicting labels teach nothing, nor do null ids; of several rows with one id one teaches; an
empty table gives an empty one; without both classes all documents get the
score ``CUT`` and are kept; repeated rows are scored each; a column of an output's name is replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT = 0.7
_CLASSES = np.zeros(256, np.int8)  # 0: other
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\r\x0b\x0c", b".,;:'\"-()", b"!?", b"$%#&*@^~", b"|<>{}[]=_\\/+`"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 10
_CLASS_OF = np.eye(11)[_CLASSES]
_SYMBOLS = b"!?$%#&*@^~|<>{}[]=_\\/+`"
FEATURES = 25


def features(text: str) -> np.ndarray:
    """The form of a whole text as ``FEATURES`` numbers."""
    raw = text.encode()
    n = max(len(raw), 1)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_OF / n
    words = raw.split()
    m = max(len(words), 1)
    kinds = set(words)
    lines = raw.split(b"\n")
    letters = share[1] + share[2] + share[10]
    ends = sum(w[-1] in _SYMBOLS for w in words)
    lone = sum(len(w) == 1 and not w.isalnum() for w in words)
    stops = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    return np.array([
        *share,
        share[2] / max(letters, 1e-9),
        (len(raw) - share[3] * n - len(words)) / m,
        max(map(len, words), default=0) ** 0.5,
        np.log1p(m),
        len(kinds) / m,
        np.log(len(kinds) + 1) / np.log(m + 1.5),
        sum(map(operator.eq, words, words[1:])) / m,
        sum(map(operator.eq, words, words[2:])) / m,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        ends / m,
        lone / m,
        np.log1p(m / (stops + 1)),
        sum(map(bytes.isupper, words)) / m,
    ])


@dataclass
class RankModel:
    """Steps of the features, weights of the steps, and the score at the threshold."""

    steps: np.ndarray  # [features, steps]
    weights: np.ndarray
    threshold: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :, None] > self.steps[None]).reshape(len(x), -1).astype(np.int8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x).astype(np.float64) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        away = np.clip(self.raw(x) - self.threshold, -40, 40)
        out = 1 / (1 + np.exp(-away) * (1 - CUT) / CUT)
        return np.where(away >= 0, np.maximum(out, CUT), np.minimum(out, np.nextafter(CUT, 0)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights that minimise the mean logistic loss of the differences ``good - bad`` with a ridge."""
    w = np.zeros(good.shape[1])
    for _ in range(rounds):
        gradient, hessian = ridge * w, ridge * np.eye(len(w))
        for at in range(0, len(good), 2048):  # the differences of all pairs at once would be the driver's largest array
            diff = good[at : at + 2048].astype(np.float64) - bad[at : at + 2048]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            gradient -= diff.T @ p / len(good)
            hessian += (diff * (p * (1 - p))[:, None]).T @ diff / len(good)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_arrays(x: np.ndarray, y: np.ndarray, pairs: int = 20_000, steps: int = 7, ridge: float = 1e-3, seed: int = 7) -> RankModel:
    """A model of feature rows ``x`` with labels ``y`` (0 or 1)."""
    none = RankModel(np.full((FEATURES, 1), np.inf), np.zeros(FEATURES), 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return none
    # both classes count alike in the steps, so that the rarer one is resolved too
    at = np.linspace(0, 1, steps + 2)[1:-1]
    cuts = np.sort(np.concatenate([np.quantile(x[good], at, axis=0), np.quantile(x[bad], at, axis=0)]).T, axis=1)
    model = RankModel(cuts, np.zeros(cuts.size), 0.0)
    rng = np.random.default_rng(seed)
    expanded = model.expand(x)
    i, j = (rng.permutation(np.resize(rng.permutation(k), pairs)) for k in (good, bad))
    model.weights = bradley_terry(expanded[i], expanded[j], ridge)
    scores = expanded.astype(np.float64) @ model.weights
    order = np.argsort(scores, kind="stable")
    ranked, right = scores[order], y[order]
    # cut before position k: the bad ones below and the good ones from there on are right
    won = np.concatenate([[0], np.cumsum(right == 0)]) + np.concatenate([np.cumsum((right == 1)[::-1])[::-1], [0]])
    able = np.concatenate([[True], ranked[1:] > ranked[:-1], [True]])
    best = np.flatnonzero(able & (won == won[able].max()))
    k = best[len(best) // 2]
    below = ranked[k - 1] if k else ranked[0] - 1
    above = ranked[k] if k < len(ranked) else ranked[-1] + 1
    model.threshold = (below + above) / 2
    return model


def held_out(id_col: str) -> Column:
    """True for the rows that must teach nothing: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_rows(docs: DataFrame) -> DataFrame:
    """(id, y, x): the features of the rows of (id, y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "").tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    return docs.select("id", "y", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, **options) -> RankModel:
    """Learns from at most ``sample_rows`` labelled rows that aren't held out."""
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("other"))
        .where("y = other")
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
        .select("id", "y")
    )
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = _feature_rows(taught).groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect()  # sample_rows small rows
    x = np.array([r.x for r in rows]).reshape(-1, FEATURES)
    order = np.lexsort([*x.T])  # the order of rows must not matter
    return fit_arrays(x[order], np.array([r.y for r in rows], np.int64)[order], **options)


def score(docs: DataFrame, model: RankModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds ``out_col``, the score (0 to 1) of every row's whole text."""
    schema = T.StructType([*(f for f in docs.schema if f.name != out_col), T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column(text_col).to_pylist()]
            scores = model.score(np.array(x).reshape(-1, FEATURES))
            kept = [n for n in batch.schema.names if n != out_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(scores, pa.float64())], [*kept, out_col])

    return docs.mapInArrow(run, schema)
