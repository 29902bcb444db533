"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision; the cosine if both are of length one."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column | str) -> Column:
    """``v`` divided by its length, by ``TINY`` if that is larger."""
    length = F.greatest(norm(v), F.lit(TINY))
    # the length is computed once for the array and bound as a lambda variable
    return F.element_at(F.transform(F.array(length), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def nearest(v: Column | str, centroids: list[tuple[str, list[float]]]) -> Column:
    """Struct (score, idx) of the centroid with the largest inner product, the first one among equals.

    The centroids are literals of the plan, for a number of classes that fits there; no join, no shuffle.
    """
    table = F.array(*(F.struct(F.lit(-i).alias("back"), F.array(*map(F.lit, map(float, c))).alias("c")) for i, (_, c) in enumerate(centroids)))
    best = F.array_max(F.transform(table, lambda t: F.struct(dot(v, t["c"]).alias("score"), t["back"].alias("back"))))
    return F.struct(best["score"].alias("score"), (-best["back"]).alias("idx"))
