"""Near duplicates among embeddings by spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes it if their cosine is at least ``alpha``. The directions are
all pairs of one code word for the first half of the (randomly rotated) coordinates and one for the
second, so ``words ** 2`` filters need only ``2 * words`` products, and the filters that a vector passes
are listed by decoding: only the largest products of the halves can make up one. ``alpha`` is where a random vector passes
``FILTERS_EACH`` filters on average, taken from the distribution of the product, which is known. Some vectors pass few or none at
that, the more of them the larger the code (0.6 % none at 10,000 vectors, 1.6 % at 100 million, where 10 % of the
pairs at 0.95 would be lost), so each vector also takes its ``LEAST_FILTERS`` nearest filters. Two vectors at a small angle pass common
filters almost surely; others rarely do. Vectors are joined on filters, pairs too far apart by 128 sign bits are
dropped (``SIGN_BITS_APART`` lies so far out that a true pair is lost with a probability below one in a million),
and the rest is verified by the cosine in double precision.

The code grows with the number of vectors so that a filter keeps ``PER_FILTER`` of them on average:
the work stays in proportion to the vectors and the links. Nothing is capped: a filter that many vectors
pass is split by the adaptive join, and equal vectors are one class that is looked up once. A pair of random direction at cosine 0.95 is
found with probability 0.99 or more up to 100 million vectors of 64 components, nearer ones more surely.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length don't link; equal vectors link with each other; every input row
gives one row, repeated ids too; only the id and vector columns are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import drop_written, written

FILTERS_EACH = 48
LEAST_FILTERS = 32
PER_FILTER = 8
SIGN_BITS_APART = 38


def _largest(products: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``m`` largest of each row, in descending order."""
    at = np.argpartition(-products, m - 1, axis=1)[:, :m] if m < products.shape[1] else np.broadcast_to(np.arange(m), products.shape)
    values = np.take_along_axis(products, at, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(values, order, axis=1)


def words_for(vectors: int, filters_each: int) -> int:
    """Code words of each half for so many vectors."""
    return max(16, math.ceil(math.sqrt(vectors * filters_each / PER_FILTER)))


def _alpha(one: int, two: int, share: float) -> float:
    """The cosine that a random vector has with a filter with probability ``share``; halves of ``one`` and ``two`` coordinates.

    The product is (sin(f) cos(a) + cos(f) cos(b)) / sqrt(2): f tells how a vector's length is dealt to the halves, a and b
    are its angles to the code words. Their densities are powers of sines and cosines.
    """

    def angles(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Angles between a code word and the vector's part of ``k`` coordinates, and their probabilities."""
        at = np.linspace(0, math.pi, n)
        p = np.exp((k - 2) * np.log(np.maximum(np.sin(at), 1e-12))) if k > 1 else np.where((at == 0) | (at == math.pi), 1.0, 0.0)
        return at, p / p.sum()

    (a, p), (b, q) = angles(one, 401), angles(two, 4001)
    split = np.linspace(0, math.pi / 2, 201)[1:-1]
    weight = np.exp((one - 1) * np.log(np.sin(split)) + (two - 1) * np.log(np.cos(split)))
    weight /= weight.sum()
    upto = np.cumsum(q) - q / 2  # that the second angle is at most b
    low, high = 0.0, 1.0
    for _ in range(30):
        alpha = (low + high) / 2
        need = (alpha * math.sqrt(2) - np.sin(split)[:, None] * np.cos(a)) / np.cos(split)[:, None]
        over = np.where(need <= 1, np.interp(np.arccos(np.clip(need, -1, 1)), b, upto), 0)
        low, high = (alpha, high) if weight @ over @ p > share else (low, alpha)
    return high


class ProductCode:
    """Filters for vectors of ``dim`` components."""

    def __init__(self, dim: int, words: int, seed: int = 11):
        rng = np.random.default_rng([seed, dim, words])
        self.dim, self.words = dim, words
        wide = max(dim, 2)
        self.rotation = np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dim]
        self.half = wide // 2
        self.codes = []
        for k in (self.half, wide - self.half):
            c = rng.standard_normal((words, k))
            self.codes.append((c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(2)).T)
        self.signs = np.random.default_rng(seed).standard_normal((wide, 128))

    @functools.cached_property
    def alpha(self) -> float:
        return _alpha(self.half, max(self.dim, 2) - self.half, min(0.5, FILTERS_EACH / self.words**2))

    def _nearest(self, turned: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``each`` nearest filters of every row and the products with them, in descending order."""
        m = min(each, self.words)
        # the i-th largest of one half with the j-th of the other has i * j - 1 filters before it
        one, two = np.array([(i, j) for i in range(m) for j in range(min(m, each // (i + 1)))]).T
        (i1, v1), (i2, v2) = _largest(turned[:, : self.half] @ self.codes[0], m), _largest(turned[:, self.half :] @ self.codes[1], m)
        best, values = _largest(v1[:, one] + v2[:, two], each)
        return np.take_along_axis(i1, one[best], axis=1) * self.words + np.take_along_axis(i2, two[best], axis=1), values

    def decode(self, units: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the rows of ``units`` pass, and of the ``least`` nearest ones in any case."""
        turned, every = units @ self.rotation, self.words**2
        least = min(least, every)
        rows, filters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, each = np.arange(len(units)), min(max(2 * FILTERS_EACH, least), every)
        while len(left):
            more, slice_rows = [left[:0]], max(1, 4_000_000 // max(self.words, 8 * each))
            for at in range(0, len(left), slice_rows):
                own = left[at : at + slice_rows]
                found, values = self._nearest(turned[own], each)
                whole = (values[:, -1] < self.alpha) | (each == every)
                passed = values[whole] >= self.alpha
                passed[:, :least] = True
                rows.append(np.repeat(own[whole], passed.sum(axis=1)))
                filters.append(found[whole][passed])
                more.append(own[~whole])
            left, each = np.concatenate(more), min(4 * each, every)
        return np.concatenate(rows), np.concatenate(filters)

    def sign_bits(self, units: np.ndarray) -> np.ndarray:
        """128 sign bits of random products as two signed words."""
        bits = (units @ self.rotation) @ self.signs > 0
        return np.packbits(bits, axis=1).view(">i8").astype(np.int64).reshape(-1, 2)


def _valid(vector: str):
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, filters_each: int = FILTERS_EACH) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector; links are pairs found with a cosine of at least ``threshold``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("valid", _valid("v"))
    keyed = rows.select("id", F.when(F.col("valid"), F.xxhash64("v")).alias("k1"), F.when(F.col("valid"), F.xxhash64(F.lit(7), "v")).alias("k2"), "v")
    classes, _ = written(
        keyed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("dim", F.size("v")),
        "vectors",
    )
    shapes = classes.groupBy("dim").count().orderBy("dim").collect()  # as many rows as there are lengths of vectors
    words = {r["dim"]: words_for(r["count"], filters_each) for r in shapes}

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            v, rep, dims = batch.column("v"), batch.column("rep").to_numpy(), batch.column("dim").to_numpy()
            values, offsets = v.values.to_numpy(), v.offsets.to_numpy()
            for dim in np.unique(dims):
                dim = int(dim)
                code = codes.get(dim) or codes.setdefault(dim, ProductCode(dim, words[dim]))
                own = np.flatnonzero(dims == dim)
                x = values[offsets[own][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for at in range(0, len(own), 2000):
                    part = own[at : at + 2000]
                    which, found = code.decode(x[at : at + 2000], min(LEAST_FILTERS, filters_each))
                    signs = code.sign_bits(x[at : at + 2000])
                    ids = rep[part]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), dim, np.int32)), pa.array(found), pa.array(ids[which]), pa.array(signs[which, 0]), pa.array(signs[which, 1])], ["dim", "f", "rep", "s1", "s2"])

    listed = classes.select("dim", "rep", "v").mapInArrow(filters, "dim int, f long, rep long, s1 long, s2 long")
    listed, caps_path = written(listed, "caps")
    a, b = listed.alias("a"), listed.alias("b")
    apart = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
    near = (F.col("a.dim") == F.col("b.dim")) & (F.col("a.f") == F.col("b.f")) & (F.col("a.rep") < F.col("b.rep")) & (apart <= SIGN_BITS_APART)
    candidates = a.join(b, near).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()

    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)))
    one = classes.select(F.col("rep").alias("a"), scaled.alias("va"), F.col("copies").alias("ca"))
    two = classes.select(F.col("rep").alias("b"), scaled.alias("vb"), F.col("copies").alias("cb"))

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    linked, _ = written(
        candidates.join(one, "a").join(two, "b").where(dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb")) >= threshold).select("a", "b", "ca", "cb"),
        "links",
    )
    drop_written(spark, caps_path)
    degree = linked.select(F.col("a").alias("rep"), F.col("cb").alias("n")).union(linked.select(F.col("b"), F.col("ca"))).groupBy("rep").agg(F.sum("n").alias("others"))
    grouped, _ = components(linked.select("a", "b"))
    result = (
        classes.select("k1", "k2", "rep", "copies")
        .join(degree, "rep", "left")
        .join(grouped.withColumnRenamed("id", "rep"), "rep", "left")
        .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        keyed.drop("v")
        .join(result, ["k1", "k2"], "left")
        .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )
