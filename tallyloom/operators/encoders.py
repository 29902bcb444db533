"""Encoders: from token arrays to unit vectors, as Arrow UDFs over numpy.

``HashedNgrams`` needs no training. ``NeuralBundle`` runs a trained bundle (``.npz``): a character CNN with a
highway layer, attention pooling over tokens, and a pointer over number tokens (transformer layers, a
two-way LSTM, a scorer). No trained bundle is part of this repository; ``random_bundle`` makes one of the right
shapes for tests and timing.
"""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tokens import MAX_CHARS, MAX_TOKENS, PAD, char_ids, padded, special_ids

DIM = 64


@dataclass(frozen=True)
class HashedNgrams:
    """Counts of character 1- to 3-grams of words and numbers in ``dim`` places, brought to length one.

    The place is arithmetic on code points, so SQL can repeat it: with codes c1, c2, c3 of a gram (0 where it is
    shorter), (c1 * 961 + c2 * 31 + c3 + 7 * length) mod dim. A text without such tokens gives NaN components, whose
    scores are NaN and pass no gate.
    """

    dim: int = DIM

    def __call__(self, token_array: Column | str) -> Column:
        spoken = F.transform(F.filter(token_array, lambda t: t["type"] <= 1), lambda t: t["token"])
        return self.of_words(F.array_join(spoken, " "))

    def of_words(self, words: Column | str) -> Column:
        """The vector of words and numbers with spaces between them, as ``tokens.words`` gives those of a whole text."""
        dim = self.dim

        # not deterministic to the planner, which would else run it again for a filter on its result
        @F.pandas_udf("array<double>")
        def encode(texts: pd.Series) -> pd.Series:
            out: list[np.ndarray] = []
            part: list[str] = []
            size = 0
            for own in texts:
                part.append(own)
                size += len(own)
                if size > _CHARACTERS_AT_ONCE:
                    out.extend(_gram_vectors(part, dim))
                    part, size = [], 0
            out.extend(_gram_vectors(part, dim))
            return pd.Series(out)

        return _with_nan(encode.asNondeterministic()(words))


_CHARACTERS_AT_ONCE = 500_000


def _gram_vectors(rows: list[str], dim: int) -> np.ndarray:
    """[rows, dim]: counts of the grams of each row's words, brought to length one; NaN for a row without words."""
    c = np.frombuffer(" ".join([*rows, ""]).encode("utf-32-le"), np.int32)  # a space ends each row
    row = np.repeat(np.arange(len(rows), dtype=np.int32) * dim, np.fromiter(map(len, rows), np.int64, len(rows)) + 1)
    one = c != 32
    two = one[1:] & one[:-1]
    three = two[1:] & one[:-2]
    places = [(row[one], (c * 961 + 7)[one]), (row[1:][two], (c[:-1] * 961 + c[1:] * 31 + 14)[two]), (row[2:][three], (c[:-2] * 961 + c[1:-1] * 31 + c[2:] + 21)[three])]
    counts = sum(np.bincount(r + (p & dim - 1 if dim & dim - 1 == 0 else p % dim), minlength=len(rows) * dim) for r, p in places).reshape(-1, dim).astype(np.float64)
    length = np.sqrt((counts**2).sum(axis=1, keepdims=True))
    return np.where(length > 0, counts / np.where(length > 0, length, 1), np.nan)


def _with_nan(vector: Column) -> Column:
    """Pandas hands NaN over as null; this makes it NaN again."""
    return F.transform(vector, lambda x: F.coalesce(x, F.lit(float("nan"))))


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Along the last axis; a row of -inf alone gives NaN."""
    with np.errstate(invalid="ignore"):
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def _layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    mean = x.mean(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(axis=-1, keepdims=True) + 1e-5) * weight + bias


@dataclass
class Weights:
    """Named arrays of a bundle below a prefix."""

    arrays: dict[str, np.ndarray]
    prefix: str = ""

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[self.prefix + name]

    def below(self, name: str) -> "Weights":
        return Weights(self.arrays, f"{self.prefix}{name}.")

    def linear(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self[f"{name}.weight"].T + self[f"{name}.bias"]


#: Rows that the neural stages hold at once: attention keeps heads x tokens x tokens numbers for each, however large the Arrow batch is.
ROWS_AT_ONCE = 128
_WORDS_AT_ONCE = 1024


def slices(rows: int) -> list[slice]:
    """Slices of at most ``ROWS_AT_ONCE`` rows."""
    return [slice(k, min(k + ROWS_AT_ONCE, rows)) for k in range(0, rows, ROWS_AT_ONCE)]


def stacked(n: int, chars: pd.Series, *others: pd.Series) -> list[np.ndarray]:
    """Arrays of the inputs' rows: character ids [rows, n, chars] and the others [rows, n]."""
    return [np.stack(chars).reshape(len(chars), n, MAX_CHARS), *map(np.stack, others)]


def _width(types: np.ndarray) -> int:
    """Places up to the last one that is no pad in any row, one at least."""
    return int(np.flatnonzero((types != PAD).any(axis=0))[-1:].sum()) + 1


def character_cnn(w: Weights, ids: np.ndarray) -> np.ndarray:
    """[n, chars] character ids to [n, dim]: widths 1, 2 and 3, maximum over places, highway, projection."""
    if len(ids) > _WORDS_AT_ONCE:
        return np.concatenate([character_cnn(w, ids[k : k + _WORDS_AT_ONCE]) for k in range(0, len(ids), _WORDS_AT_ONCE)])
    x = w["char_embed.weight"][ids]
    pooled = []
    for k in (1, 2, 3):
        kernel, bias = w[f"conv{k}.weight"], w[f"conv{k}.bias"]  # [filters, channels, k]
        pad = 0 if k == 1 else 1
        wide = np.pad(x, ((0, 0), (pad, pad), (0, 0)))
        places = wide.shape[1] - k + 1
        y = sum(wide[:, j : j + places] @ kernel[:, :, j].T for j in range(k)) + bias
        pooled.append(_relu(y).max(axis=1))
    h = np.concatenate(pooled, axis=1)
    gate = _sigmoid(w.linear("highway.gate", h))
    h = gate * _relu(w.linear("highway.transform", h)) + (1 - gate) * h
    return w.linear("project", h)


def _heads(x: np.ndarray, heads: int) -> np.ndarray:
    b, n, d = x.shape
    return x.reshape(b, n, heads, d // heads).transpose(0, 2, 1, 3)


def attention(w: Weights, query: np.ndarray, keys: np.ndarray, is_pad: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray]:
    """Multi-head attention of [b, q, d] over [b, n, d]; (values, weights averaged over the heads)."""
    d = query.shape[-1]
    qw, kw, vw = np.split(w["in_proj_weight"], 3)
    qb, kb, vb = np.split(w["in_proj_bias"], 3)
    q, k, v = _heads(query @ qw.T + qb, heads), _heads(keys @ kw.T + kb, heads), _heads(keys @ vw.T + vb, heads)
    scores = q @ k.transpose(0, 1, 3, 2) / np.sqrt(d // heads)
    weights = _softmax(np.where(is_pad[:, None, None, :], -np.inf, scores))
    out = (weights @ v).transpose(0, 2, 1, 3).reshape(query.shape)
    return w.linear("out_proj", out), weights.mean(axis=1)


def pooled_vector(w: Weights, chars: np.ndarray, types: np.ndarray, is_number: np.ndarray, heads: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, [b, n, chars] to [b, dim], and the attention on their tokens."""
    full = chars.shape[1]
    n = _width(types)  # pads get no attention
    chars, types, is_number = chars[:, :n], types[:, :n], is_number[:, :n]
    b, n, c = chars.shape
    # a word is run through the CNN once for all its occurrences in the batch
    distinct, back = np.unique(chars.reshape(b * n, c), axis=0, return_inverse=True)
    tokens = character_cnn(w.below("char_cnn"), distinct)[back.reshape(-1)].reshape(b, n, -1)
    tokens = np.concatenate([tokens, w["num_embed.weight"][is_number]], axis=-1)
    query = np.broadcast_to(w["query"], (b, 1, tokens.shape[-1]))
    out, weights = attention(w.below("cross_attn"), query, tokens, types == PAD, heads)
    v = w.linear("projector.2", _relu(w.linear("projector.0", out[:, 0])))
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12), _widened(weights[:, 0], full)


def _widened(weights: np.ndarray, n: int) -> np.ndarray:
    """[b, n] attention: 0 for the pads left out, NaN where a text has nothing else."""
    rest = np.where(np.isnan(weights[:, :1]), np.nan, 0.0)
    return np.concatenate([weights, np.repeat(rest, n - weights.shape[1], axis=1)], axis=1)


def _lstm(w: Weights, x: np.ndarray, suffix: str) -> np.ndarray:
    """One direction over [b, n, d]; gates in the order input, forget, cell, output."""
    wi, wh, bias = w[f"weight_ih{suffix}"], w[f"weight_hh{suffix}"], w[f"bias_ih{suffix}"] + w[f"bias_hh{suffix}"]
    given = x @ wi.T + bias
    h = np.zeros((len(x), wh.shape[1]))
    c, out = h, []
    for t in range(x.shape[1]):
        i, f, g, o = np.split(given[:, t] + h @ wh.T, 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.stack(out, axis=1)


def pointer_scores(w: Weights, chars: np.ndarray, types: np.ndarray, is_number: np.ndarray, specials: np.ndarray, aff: np.ndarray, heads: int = 4, layers: int = 3) -> np.ndarray:
    """[b, 1 + n] scores: no designation, then every token, -inf for those that are no number.

    The LSTM runs over all places, pads too, so inputs must have the width that the bundle was trained with.
    """
    full, full_types, full_numbers = types.shape[1], types, is_number
    n = min(_width(types) + 1, full)
    if all((a[:, n:] == a[:, n - 1 : n]).all() for a in (types, is_number, specials)):
        # a row's last pads are equal through the encoder, which knows no places: one stands for all
        chars, types, is_number, specials = chars[:, :n], types[:, :n], is_number[:, :n], specials[:, :n]
    b, n, c = chars.shape
    distinct, back = np.unique(chars.reshape(b * n, c), axis=0, return_inverse=True)
    words = character_cnn(w.below("char_cnn"), distinct)[back.reshape(-1)].reshape(b, n, -1)
    x = np.where((types == 0)[..., None], words, w["special_embed.weight"][specials])
    x = np.concatenate([x, w["num_feature_embed.weight"][is_number]], axis=-1)
    pad = types == PAD
    for k in range(layers):
        layer = w.below(f"encoder.{k}")
        x = _layer_norm(x + attention(layer.below("self_attn"), x, x, pad, heads)[0], layer["norm1.weight"], layer["norm1.bias"])
        x = _layer_norm(x + layer.linear("linear2", _relu(layer.linear("linear1", x))), layer["norm2.weight"], layer["norm2.bias"])
    x = np.concatenate([x, np.repeat(x[:, -1:], full - n, axis=1)], axis=1)
    lstm = w.below("lstm")
    both = np.concatenate([_lstm(lstm, x, ""), _lstm(lstm, x[:, ::-1], "_reverse")[:, ::-1]], axis=-1)
    context = np.broadcast_to(w["aff_embed.weight"][aff][:, None], (b, full, w["aff_embed.weight"].shape[1]))
    scores = w.linear("scorer", np.concatenate([both, context], axis=-1))[..., 0]
    scores = np.where((full_numbers == 1) & (full_types != PAD), scores, -np.inf)
    return np.concatenate([np.full((b, 1), float(np.ravel(w["null_score"])[0])), scores], axis=1)


def random_bundle(seed: int = 0, affiliations: int = 5, hidden: int = 512, dim: int = DIM) -> dict[str, np.ndarray]:
    """Arrays of the right names and shapes with random values."""
    rng = np.random.default_rng(seed)
    out: dict[str, np.ndarray] = {}

    def put(name: str, *shape: int) -> None:
        out[name] = rng.standard_normal(shape) * 0.1

    def linear(name: str, outer: int, inner: int) -> None:
        put(f"{name}.weight", outer, inner)
        put(f"{name}.bias", outer)

    def cnn(p: str) -> None:
        put(f"{p}char_cnn.char_embed.weight", 50, 16)
        out[f"{p}char_cnn.char_embed.weight"][0] = 0
        for k, filters in ((1, 32), (2, 64), (3, 128)):
            put(f"{p}char_cnn.conv{k}.weight", filters, 16, k)
            put(f"{p}char_cnn.conv{k}.bias", filters)
        for name in ("gate", "transform"):
            linear(f"{p}char_cnn.highway.{name}", 224, 224)
        linear(f"{p}char_cnn.project", dim, 224)

    def attend(p: str, d: int) -> None:
        put(f"{p}in_proj_weight", 3 * d, d)
        put(f"{p}in_proj_bias", 3 * d)
        linear(f"{p}out_proj", d, d)

    for p in ("union.", "affiliation."):
        cnn(p)
        put(f"{p}num_embed.weight", 2, 8)
        put(f"{p}query", 1, 1, dim + 8)
        attend(f"{p}cross_attn.", dim + 8)
        linear(f"{p}projector.0", 128, dim + 8)
        linear(f"{p}projector.2", dim, 128)
    p, d = "pointer.", dim + 16
    cnn(p)
    put(f"{p}special_embed.weight", 1015, dim)
    put(f"{p}num_feature_embed.weight", 2, 16)
    for k in range(3):
        attend(f"{p}encoder.{k}.self_attn.", d)
        linear(f"{p}encoder.{k}.linear1", 4 * d, d)
        linear(f"{p}encoder.{k}.linear2", d, 4 * d)
        for norm in ("norm1", "norm2"):
            out[f"{p}encoder.{k}.{norm}.weight"], out[f"{p}encoder.{k}.{norm}.bias"] = np.ones(d), np.zeros(d)
    for suffix in ("", "_reverse"):
        put(f"{p}lstm.weight_ih{suffix}", 4 * hidden, d)
        put(f"{p}lstm.weight_hh{suffix}", 4 * hidden, hidden)
        put(f"{p}lstm.bias_ih{suffix}", 4 * hidden)
        put(f"{p}lstm.bias_hh{suffix}", 4 * hidden)
    put(f"{p}aff_embed.weight", affiliations, dim)
    linear(f"{p}scorer", 1, 2 * hidden + dim)
    put(f"{p}null_score", 1)
    return out


_BUNDLES: dict[str, dict[str, np.ndarray]] = {}


@dataclass(frozen=True)
class NeuralBundle:
    """A bundle file that every worker can read; loaded once in each Python process."""

    path: str
    max_tokens: int = MAX_TOKENS
    arrays: dict | None = field(default=None, compare=False, repr=False)

    def weights(self) -> dict[str, np.ndarray]:
        if self.arrays is not None:
            return self.arrays
        if self.path not in _BUNDLES:
            with np.load(self.path, allow_pickle=False) as f:
                _BUNDLES[self.path] = {k: f[k].astype(np.float64) for k in f.files}
        return _BUNDLES[self.path]

    def _inputs(self, token_array: Column | str) -> list[Column]:
        full = padded(token_array, self.max_tokens)
        flat = F.flatten(F.transform(full, lambda t: char_ids(t["token"])))
        return [flat, F.transform(full, lambda t: t["type"].cast("int")), F.transform(full, lambda t: t["is_number"].cast("int"))]

    def vector(self, token_array: Column | str, stage: str) -> Column:
        """Unit vectors by the encoder of ``stage`` (``union`` or ``affiliation``); NaN for texts without tokens."""
        own, n = self, self.max_tokens

        @F.pandas_udf("array<double>")
        def encode(chars: pd.Series, types: pd.Series, numbers: pd.Series) -> pd.Series:
            if not len(chars):
                return pd.Series([], dtype=object)
            w = Weights(own.weights(), f"{stage}.")
            return pd.Series([v for k in slices(len(chars)) for v in pooled_vector(w, *stacked(n, chars[k], types[k], numbers[k]))[0]])

        return _with_nan(encode(*self._inputs(token_array)))

    def attention(self, token_array: Column | str, stage: str) -> Column:
        """The weights of a text's ``max_tokens`` places in the pooling of ``stage``, averaged over the heads; NaN without tokens."""
        own, n = self, self.max_tokens

        @F.pandas_udf("array<double>")
        def attend(chars: pd.Series, types: pd.Series, numbers: pd.Series) -> pd.Series:
            if not len(chars):
                return pd.Series([], dtype=object)
            w = Weights(own.weights(), f"{stage}.")
            return pd.Series([v for k in slices(len(chars)) for v in pooled_vector(w, *stacked(n, chars[k], types[k], numbers[k]))[1]])

        return _with_nan(attend(*self._inputs(token_array)))

    def place(self, token_array: Column | str, aff: Column | str) -> Column:
        """Place (from 1) of the designation, 0 for none; ``aff`` is the index of the affiliation as context."""
        own, n = self, self.max_tokens

        @F.pandas_udf("int")
        def point(chars: pd.Series, types: pd.Series, numbers: pd.Series, specials: pd.Series, aff: pd.Series) -> pd.Series:
            if not len(chars):
                return pd.Series([], dtype="int32")
            w = Weights(own.weights(), "pointer.")
            places = [pointer_scores(w, *stacked(n, chars[k], types[k], numbers[k], specials[k]), aff[k].to_numpy()).argmax(axis=1) for k in slices(len(chars))]
            return pd.Series(np.concatenate(places).astype(np.int32))

        return point(*self._inputs(token_array), special_ids(padded(token_array, n)), F.col(aff) if isinstance(aff, str) else aff)


def save_bundle(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays as a compressed ``.npz`` that ``NeuralBundle`` reads."""
    np.savez_compressed(path, **{k: v.astype(np.float32) for k, v in arrays.items()})


def warm_start(arrays: dict[str, np.ndarray], path: str, prefix: str) -> dict[str, np.ndarray]:
    """``arrays`` with the character CNN below ``prefix`` taken from another bundle's ``char_cnn.``; as it was, with a warning, without one."""
    found: dict[str, np.ndarray] = {}
    if os.path.exists(path):
        with np.load(path, allow_pickle=False) as f:
            found = {prefix + k[k.index("char_cnn.") :]: f[k].astype(np.float64) for k in f.files if "char_cnn." in k}
    if not found:
        warnings.warn(f"no character CNN in {path}; it starts from random values", stacklevel=2)
    return arrays | {k: v for k, v in found.items() if k in arrays}


def cross_entropy(scores: np.ndarray, labels: np.ndarray) -> float:
    """Mean loss of the right place among scores [b, places], -inf where a place can't be chosen."""
    top = scores.max(axis=1)
    return float(np.mean(top + np.log(np.exp(scores - top[:, None]).sum(axis=1)) - scores[np.arange(len(scores)), labels]))
