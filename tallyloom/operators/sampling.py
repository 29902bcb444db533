"""Deterministic samples and splits: order comes from a hash of the id, never from the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import not_in


#: Hash values in a bucket: of 20,001 buckets none holds more than a small share of any table or class.
BUCKET = 50


def arithmetic_hash(id_col: str, seed: int = 104729) -> Column:
    """A spread of ids that any SQL engine can repeat."""
    return F.pmod(F.col(id_col).cast("bigint") * 7919 + F.lit(seed), F.lit(1000003))


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 104729) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same ones in every run; a top-n with partial results in each task."""
    return df.orderBy(arithmetic_hash(id_col, seed), id_col).limit(n)


def frequent_classes(df: DataFrame, class_col: str, least: int) -> DataFrame:
    """(class, n) of classes with at least ``least`` rows; null is no class."""
    return df.where(F.col(class_col).isNotNull()).groupBy(F.col(class_col).alias("class")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def keep_frequent(df: DataFrame, class_col: str, least: int, drop: list[str] = ()) -> DataFrame:
    """Rows of classes with at least ``least`` rows, without those named in ``drop``."""
    rows = df.where(not_in(class_col, list(drop))) if drop else df
    return rows.join(frequent_classes(rows, class_col, least).select(F.col("class").alias(class_col)), class_col, "left_semi")


def stratified_split(df: DataFrame, class_col: str, id_col: str, fraction: float, least: int = 2, exclude: list[str] = (), seed: int = 104729) -> DataFrame:
    """Adds ``split``: ``test`` for round(fraction * n) rows of each class, ``exclude`` for excluded classes, else ``train``.

    Classes below ``least`` rows and rows without class are all ``train``. Where a class's rows lie in its order is
    found in two levels, by buckets of the hash and inside the bucket that the border falls into, so that a class of
    a third of all rows isn't sorted in one task.
    """
    rows = df.withColumn("_h", arithmetic_hash(id_col, seed)).withColumn("_bucket", F.floor(F.col("_h") / BUCKET).cast("int"))
    sizes = rows.groupBy(class_col, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(class_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 20,001 rows a class
    bounds = sizes.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(class_col))).drop("_n")
    bounds = bounds.select(F.col(class_col).alias("_class"), F.col("_bucket").alias("_b"), "_before", "_all")
    placed = rows.join(bounds, F.col(class_col).eqNullSafe(F.col("_class")) & (F.col("_bucket") == F.col("_b")), "left")
    within = Window.partitionBy(class_col, "_bucket").orderBy("_h", id_col)
    rank = F.col("_before") + F.row_number().over(within)
    wanted = F.floor(F.col("_all") * F.lit(float(fraction)) + F.lit(0.5))
    test = F.col(class_col).isNotNull() & (F.col("_all") >= least) & (rank <= wanted)
    excluded = F.coalesce(F.col(class_col).isin(*exclude), F.lit(False)) if exclude else F.lit(False)
    return placed.withColumn("split", F.when(excluded, "exclude").when(test, "test").otherwise("train")).drop("_h", "_bucket", "_class", "_b", "_before", "_all")


def full_batches(df: DataFrame, id_col: str, size: int, seed: int = 104729) -> DataFrame:
    """``df`` with ``batch``: rows in the order of the hash, ``size`` in each batch; those that don't fill a last one are dropped.

    A row's place is found in two levels, by buckets of the hash and inside them, so nothing is sorted in one task.
    """
    rows = df.withColumn("_h", arithmetic_hash(id_col, seed)).withColumn("_bucket", F.floor(F.col("_h") / BUCKET).cast("int"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 20,001 rows
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_bucket").alias("_b"), (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    placed = rows.join(F.broadcast(before), F.col("_bucket") == F.col("_b"))
    batch = F.floor((F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", id_col)) - 1) / size)
    return placed.withColumn("batch", batch).where(F.col("batch") < F.floor(F.col("_all") / size)).drop("_h", "_bucket", "_b", "_before", "_all")


def batches(df: DataFrame, id_col: str, size: int, seed: int = 104729) -> DataFrame:
    """Adds ``batch``, filling batches of about ``size`` rows by hash, for mini-batch statistics.

    The hash has 1,000,003 values, so a table has no more batches than that; ``full_batches`` has no such bound.
    """
    n = max(1, df.count() // size)
    return df.withColumn("batch", F.pmod(arithmetic_hash(id_col, seed), F.lit(n)).cast("int"))
