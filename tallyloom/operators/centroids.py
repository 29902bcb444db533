"""Grouped mean vectors and nearest-centroid classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import accept, passes
from ..functions.vectors import dot, l2_normalise

LIMIT_LITERALS = 4096


def vector_sums(df: DataFrame, class_col: str, vector_col: str, dim: int) -> DataFrame:
    """(class, n, sums) of vectors of ``dim`` components, without exploding them: one sum for each component in each task."""
    v = F.col(vector_col)
    sums = df.where(v.isNotNull()).groupBy(F.col(class_col).alias("class")).agg(F.count("*").alias("n"), *(F.sum(F.get(v, F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(dim)))
    return sums.select("class", "n", F.array(*(F.col(f"_s{i}") for i in range(dim))).alias("sums"))


def mean_vectors(df: DataFrame, class_col: str, vector_col: str, classes: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """(class, n, centroid): the mean of each class's vectors, brought to length one.

    Components are averaged with partial sums, so a class of any size is a few numbers in each task. With
    ``classes``, one of them without vectors gets ``dim`` zeros. Null vectors don't count.
    """
    parts = df.where(F.col(vector_col).isNotNull()).select(F.col(class_col).alias("class"), F.posexplode(vector_col).alias("i", "x"))
    means = parts.groupBy("class", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    vectors = means.groupBy("class").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    out = vectors.select("class", "n", l2_normalise(F.transform("v", lambda p: p["x"])).alias("centroid"))
    if classes is None:
        return out
    zero = F.array_repeat(F.lit(0.0), dim or 0)
    names = classes.select(F.col(classes.columns[0]).alias("class")).distinct()
    return names.join(out, "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("centroid", zero).alias("centroid"))


def mean_vector(df: DataFrame, vector_col: str) -> DataFrame:
    """One row (n, centroid): the mean of all vectors, brought to length one."""
    return mean_vectors(df.withColumn("_one", F.lit(1)), "_one", vector_col).drop("class")


def score_against(df: DataFrame, vector_col: str, centroid: list[float], out_col: str = "score") -> DataFrame:
    """Adds the inner product with one centroid, a literal of the plan."""
    return df.withColumn(out_col, dot(vector_col, F.array(*map(F.lit, map(float, centroid)))))


def gate(score: Column | str, threshold: float = 0.5) -> Column:
    """The one-class decision: at the threshold or above; NaN is out."""
    return passes(score, threshold)


def nearest_centroid(df: DataFrame, key_col: str, vector_col: str, centroids: DataFrame, threshold: float | None = None) -> DataFrame:
    """``df`` with ``nearest``, ``similarity`` and, with a threshold, ``accepted`` (null below it).

    ``centroids`` (class, centroid) are few; their number is checked before they are turned into one literal
    array, so that top-1 is a narrow expression. More of them are compared in blocks of ``LIMIT_LITERALS``, every row with
    every block, reduced by partial minima; rows of equal key stay apart. Ties go to the first class by name.
    """
    if centroids.limit(LIMIT_LITERALS + 1).count() <= LIMIT_LITERALS:
        rows = centroids.orderBy("class").select("class", "centroid").collect()
        table = F.array(*(F.struct(F.lit(-k).alias("back"), F.lit(r["class"]).alias("class"), F.array(*map(F.lit, r["centroid"])).alias("c")) for k, r in enumerate(rows)))
        best = F.array_max(F.transform(table, lambda t: F.struct(dot(vector_col, t["c"]).alias("s"), t["back"].alias("back"), t["class"].alias("class"))))
        out = df.withColumn("_best", best if rows else F.lit(None).cast("struct<s:double,back:int,class:string>"))
        out = out.withColumn("nearest", F.col("_best.class")).withColumn("similarity", F.col("_best.s")).drop("_best")
    else:
        # as few blocks as hold LIMIT_LITERALS classes each: every row meets every block once
        blocks = -(-centroids.count() // LIMIT_LITERALS)
        held = centroids.withColumn("_k", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")).groupBy("_k").agg(F.collect_list(F.struct("class", "centroid")).alias("_cs"))
        asked = df.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_uid")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        # the least of (-similarity, class): the most similar, then the first by name
        met = F.array_min(F.transform("_cs", lambda c: F.struct((-dot(F.col("_row")[vector_col], c["centroid"])).alias("s"), c["class"].alias("class"))))
        best = asked.join(held, "_k").select("_uid", "_row", met.alias("_b")).groupBy("_uid").agg(F.first("_row").alias("_row"), F.min("_b").alias("_b"))
        out = best.select("_row.*", F.col("_b.class").alias("nearest"), (-F.col("_b.s")).alias("similarity"))
    return out if threshold is None else out.withColumn("accepted", accept("similarity", "nearest", threshold))
