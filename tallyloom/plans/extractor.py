"""The extraction plan: text in, record out, one row for one row.

Stage 1 holds the text's vector against one centroid; what stays below the threshold is no organisation. Stage 2
takes the nearest of the affiliations' centroids, and none if it isn't near enough. Stage 3 points at the
number token that designates the local unit. A record is a struct (is_union, union_score, affiliation,
affiliation_unrecognized, designation, aff_score); designation is null for other texts, empty without number.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import passes
from ..functions.tokens import MAX_TOKENS, char_ids, designation_decode, last_number, padded, pointer, special_ids, tokens, words
from ..functions.vectors import TINY, dot, nearest
from ..operators.centroids import LIMIT_LITERALS, vector_sums
from ..operators.encoders import HashedNgrams, NeuralBundle, Weights, pointer_scores, pooled_vector, slices, stacked

#: Classes that don't train affiliations: no affiliation, unknown, several.
NOT_AFFILIATIONS = ("UNAFF", "UNK", "MULTI")
NOT_A_UNION = "UNK"
RECORD = ("is_union", "union_score", "affiliation", "affiliation_unrecognized", "designation", "aff_score")


def last_wins(token: Column, index: Column) -> Column:
    """The rule by which the last number of a text designates."""
    return index + 1


@dataclass
class CentroidModel:
    """Centroids of the stages over one encoder, and the rule that scores number tokens."""

    union_centroid: list[float]
    affiliations: list[str]
    affiliation_centroids: list[list[float]]
    encoder: Callable[[Column], Column] = field(default_factory=HashedNgrams)
    number_score: Callable[[Column, Column], Column] = last_wins

    def save(self, path: str) -> None:
        """Writes the centroids as JSON; encoder and rule are code."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps({"union": self.union_centroid, "affiliations": self.affiliations, "centroids": self.affiliation_centroids}))

    @classmethod
    def load(cls, path: str, **options: Any) -> "CentroidModel":
        stored = json.loads(Path(path).read_text())
        return cls(stored["union"], stored["affiliations"], stored["centroids"], **options)

    def record(self, token_array: Column, union_threshold: float, affiliation_threshold: float, df: DataFrame) -> DataFrame:
        """``df`` (with the token column ``_tokens``) with a column ``_record``.

        The vector is computed once. All that follows is native and cheap, so the gate is a condition in the
        same projection and nothing is split or joined.
        """
        designation = designation_decode(token_array, pointer(token_array, self.number_score))
        return self._record(self.encoder(token_array), designation, union_threshold, affiliation_threshold, df)

    @property
    def needs_words_only(self) -> bool:
        """Whether words and numbers say all that encoder and rule ask of a text, so that ``record_of_words`` is its record."""
        return isinstance(self.encoder, HashedNgrams) and self.number_score is last_wins

    def record_of_words(self, words: Column, union_threshold: float, affiliation_threshold: float, df: DataFrame) -> DataFrame:
        """``record`` by the column of ``tokens.words``, without an array of tokens."""
        return self._record(self.encoder.of_words(words), last_number(words), union_threshold, affiliation_threshold, df)

    def _record(self, vector: Column, designation: Column, union_threshold: float, affiliation_threshold: float, df: DataFrame) -> DataFrame:
        steps = df.withColumn("_vector", vector)
        steps = steps.withColumn("_union_score", dot("_vector", F.array(*map(F.lit, self.union_centroid))))
        steps = steps.withColumn("_is_union", passes("_union_score", union_threshold))
        named = list(zip(self.affiliations, self.affiliation_centroids))
        best = nearest("_vector", named) if named else F.lit(None).cast("struct<score:double,idx:int>")
        steps = steps.withColumn("_best", F.when(F.col("_is_union"), best))
        names = F.array(*map(F.lit, self.affiliations)) if named else F.array().cast("array<string>")
        affiliation = F.when(passes("_best.score", affiliation_threshold), F.get(names, F.col("_best.idx")))
        steps = steps.withColumn("_aff", affiliation).withColumn("_desig", F.when(F.col("_is_union"), designation))
        record = F.struct(
            F.col("_is_union").alias("is_union"),
            F.col("_union_score").alias("union_score"),
            F.col("_aff").alias("affiliation"),
            (F.col("_is_union") & F.col("_aff").isNull()).alias("affiliation_unrecognized"),
            F.col("_desig").alias("designation"),
            F.col("_best.score").alias("aff_score"),
        )
        return steps.withColumn("_record", record).drop("_vector", "_union_score", "_is_union", "_best", "_aff", "_desig")


@dataclass
class NeuralModel:
    """A trained bundle with its centroids. All three stages run in one Arrow UDF, the later ones on gated rows alone."""

    bundle: NeuralBundle
    union_centroid: list[float]
    affiliations: list[str]
    affiliation_centroids: list[list[float]]

    def save(self, path: str) -> None:
        """Writes the centroids and the bundle's place as JSON."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        stored = {"bundle": self.bundle.path, "max_tokens": self.bundle.max_tokens}
        Path(path).write_text(json.dumps(stored | {"union": self.union_centroid, "affiliations": self.affiliations, "centroids": self.affiliation_centroids}))

    @classmethod
    def load(cls, path: str) -> "NeuralModel":
        """A model of ``save``; a bundle's relative path counts from the file."""
        stored = json.loads(Path(path).read_text())
        bundle = NeuralBundle(str(Path(path).parent / stored["bundle"]), stored.get("max_tokens", MAX_TOKENS))
        return cls(bundle, stored["union"], stored["affiliations"], stored["centroids"])

    def attention(self, df: DataFrame, text_col: str = "text", stage: str = "union") -> DataFrame:
        """Adds ``attention``: the weight of each token of a text in the pooling of ``stage``, pads left out."""
        with_tokens = df.withColumn("_tokens", tokens(text_col, self.bundle.max_tokens))
        return with_tokens.withColumn("attention", F.slice(self.bundle.attention("_tokens", stage), 1, F.size("_tokens"))).drop("_tokens")

    def record(self, token_array: Column, union_threshold: float, affiliation_threshold: float, df: DataFrame) -> DataFrame:
        bundle, n = self.bundle, self.bundle.max_tokens
        union, names, centroids = np.array(self.union_centroid), list(self.affiliations), np.array(self.affiliation_centroids)

        def none(rows: int) -> pd.DataFrame:
            return pd.DataFrame({"is_union": [False] * rows, "union_score": np.nan, "affiliation": pd.Series([None] * rows, dtype=object), "affiliation_unrecognized": [False] * rows, "place": pd.array([None] * rows, "Int32"), "aff_score": pd.array([None] * rows, "Float64")})

        def some(w: dict[str, np.ndarray], c: np.ndarray, t: np.ndarray, m: np.ndarray, s: np.ndarray) -> pd.DataFrame:
            out = none(len(c))
            score = pooled_vector(Weights(w, "union."), c, t, m)[0] @ union
            with np.errstate(invalid="ignore"):
                own = np.flatnonzero(score >= union_threshold)  # NaN is out
            out["union_score"] = score
            if len(own):
                v = pooled_vector(Weights(w, "affiliation."), c[own], t[own], m[own])[0]
                similar = v @ centroids.T
                best = similar.argmax(axis=1)
                top = similar[np.arange(len(own)), best]
                known = top >= affiliation_threshold
                place = pointer_scores(Weights(w, "pointer."), c[own], t[own], m[own], s[own], np.where(known, best, 0)).argmax(axis=1)
                out.loc[own, "is_union"] = True
                out.loc[own, "affiliation"] = [names[b] if k else None for b, k in zip(best, known)]
                out.loc[own, "affiliation_unrecognized"] = ~known
                out.loc[own, "place"] = place
                out.loc[own, "aff_score"] = top
            return out

        @F.pandas_udf("is_union boolean, union_score double, affiliation string, affiliation_unrecognized boolean, place int, aff_score double")
        def stages(chars: pd.Series, types: pd.Series, numbers: pd.Series, specials: pd.Series) -> pd.DataFrame:
            w = bundle.weights()
            # each slice is done with before the next one is stacked
            return pd.concat([some(w, *stacked(n, chars[k], types[k], numbers[k], specials[k])) for k in slices(len(chars))] or [none(0)], ignore_index=True)

        full = padded(token_array, n)
        inputs = [F.flatten(F.transform(full, lambda x: char_ids(x["token"]))), F.transform(full, lambda x: x["type"].cast("int")), F.transform(full, lambda x: x["is_number"].cast("int")), special_ids(full)]
        steps = df.withColumn("_r", stages(*inputs))
        special = {
            "union_score": F.coalesce("_r.union_score", F.lit(float("nan"))),  # pandas hands NaN over as null
            "designation": F.when(F.col("_r.is_union"), designation_decode(token_array, F.col("_r.place"))),
        }
        record = F.struct(*(special.get(f, F.col(f"_r.{f}")).alias(f) for f in RECORD))
        return steps.withColumn("_record", record).drop("_r")


@contextlib.contextmanager
def encoder_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def load_model(path: str) -> CentroidModel | NeuralModel:
    """The model of a JSON file, a trained one if the file names a bundle."""
    return (NeuralModel if "bundle" in json.loads(Path(path).read_text()) else CentroidModel).load(path)


@dataclass
class Extractor:
    """The plan over a model; ``transform`` works on batch and streaming frames alike."""

    model: CentroidModel | NeuralModel
    union_threshold: float = 0.5
    affiliation_threshold: float = 0.80
    max_tokens: int | None = MAX_TOKENS

    def transform(self, df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
        """``df`` with the six fields of the record, named with ``prefix``; same-named columns are replaced."""
        whole = self.max_tokens is None and getattr(self.model, "needs_words_only", False)
        with_tokens = df.withColumn("_tokens", words(text_col) if whole else tokens(text_col, self.max_tokens))
        record = self.model.record_of_words if whole else self.model.record
        done = record(F.col("_tokens"), self.union_threshold, self.affiliation_threshold, with_tokens).drop("_tokens")
        return self._with_fields(done, df, prefix)

    def transform_encoded(self, df: DataFrame, vector_col: str, number_col: str, prefix: str = "") -> DataFrame:
        """``transform`` of a table that holds each text's vector and last number (``encode_whole``), for a model of the same encoder."""
        done = self.model._record(F.col(vector_col), F.col(number_col), self.union_threshold, self.affiliation_threshold, df)
        return self._with_fields(done, df, prefix)

    def _with_fields(self, done: DataFrame, df: DataFrame, prefix: str) -> DataFrame:
        kept = [c for c in df.columns if c not in {prefix + f for f in RECORD}]
        return done.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"_record.{f}").alias(prefix + f) for f in RECORD))

    def extract(self, spark: SparkSession, text: str) -> dict:
        """The record of one text."""
        return self.extract_batch(spark, [text])[0]

    def extract_batch(self, spark: SparkSession, texts: list[str], batch_size: int = 256) -> list[dict]:
        """Records in the order of the texts, which the caller holds in memory anyway; the encoder gets ``batch_size`` at once."""
        if not texts:
            return []
        df = spark.createDataFrame(list(enumerate(texts)), "_i bigint, text string")
        with encoder_batches(spark, batch_size):
            return [{f: r[f] for f in RECORD} for r in self.transform(df).orderBy("_i").collect()]


def fit(labelled: DataFrame, text_col: str = "text", class_col: str = "aff_abbr", negatives: DataFrame | None = None, least: int = 5, encoder: Callable | None = None, max_tokens: int | None = MAX_TOKENS) -> CentroidModel:
    """Centroids from labelled texts, of their first ``max_tokens`` tokens (all if None).

    Texts of every class but the unknown one teach stage 1, and classes of ``least`` rows or more, without the
    special ones, stage 2. ``negatives`` (text) are accepted for symmetry with trained encoders and teach nothing here: a mean
    of positives has no use for them. Texts are encoded once, and one row of sums for each class to be kept comes to the
    driver; more than ``LIMIT_LITERALS`` classes are an error, because a model is a literal of its plans
    (``mean_vectors`` and ``nearest_centroid`` take any number).
    """
    encode = encoder or HashedNgrams()
    vector = encode.of_words(words(text_col)) if max_tokens is None and isinstance(encode, HashedNgrams) else encode(tokens(text_col, max_tokens))
    return fit_vectors(labelled.select(F.col(class_col).alias("class"), vector.alias("v")), "class", "v", least, encode)


def encode_whole(df: DataFrame, text_col: str, encoder: HashedNgrams, vector_col: str, number_col: str) -> DataFrame:
    """Replaces a column of texts by the vector and the last number of each whole text."""
    read = df.withColumn("_words", words(text_col)).drop(text_col)
    return read.withColumn(vector_col, encoder.of_words("_words")).withColumn(number_col, last_number("_words")).drop("_words")


def fit_vectors(labelled: DataFrame, class_col: str, vector_col: str, least: int = 5, encoder: Callable | None = None) -> CentroidModel:
    """``fit`` from vectors that ``encoder`` has made."""
    encode = encoder or HashedNgrams()
    rows = labelled.select(F.col(class_col).alias("class"), F.col(vector_col).alias("v")).where(~F.exists("v", F.isnan))
    dim = getattr(encode, "dim", None) or len((rows.select("v").head() or {"v": []})["v"])
    sums = vector_sums(rows, "class", "v", dim)
    taught = F.coalesce(F.col("class") != NOT_A_UNION, F.lit(True))
    kept = F.col("class").isNotNull() & ~F.col("class").isin(*NOT_AFFILIATIONS) & (F.col("n") >= least)
    # the classes that aren't kept are one row for stage 1
    sums = sums.where(taught).select(F.when(kept, F.col("class")).alias("class"), "n", *(F.col("sums")[i].alias(f"s{i}") for i in range(dim)))
    found = sums.groupBy("class").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(dim))).limit(LIMIT_LITERALS + 2).collect()
    if sum(r["class"] is not None for r in found) > LIMIT_LITERALS:
        raise ValueError(f"more than {LIMIT_LITERALS} classes")
    vectors = {r["class"]: np.array([r[f"s{i}"] for i in range(dim)]) for r in found}

    def unit(v: np.ndarray) -> list[float]:
        n = sum(r["n"] for r in found) or 1
        return (v / n / max(float(np.linalg.norm(v / n)), TINY)).tolist()

    named = sorted(c for c in vectors if c is not None)
    return CentroidModel(unit(sum(vectors.values(), np.zeros(dim))), named, [unit(vectors[c]) for c in named], encoder=encode)
