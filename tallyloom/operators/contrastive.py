"""Contrastive losses of a batch of embeddings, evaluated as joins and grouped sums.

Pairs are formed inside a batch alone, whose size the caller fixes; batches are independent groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot

GUARD = 1e-8


def pair_similarities(df: DataFrame, id_col: str, vector_col: str, batch_col: str | None = None, with_self: bool = False) -> DataFrame:
    """(batch, a, b, similarity) of all ordered pairs inside each batch; without ``batch_col`` ``df`` is one batch, and as small as one."""
    batch = F.col(batch_col) if batch_col else F.lit(0)
    rows = df.select(batch.alias("batch"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    a, b = rows.select("batch", F.col("id").alias("a"), F.col("v").alias("va")), rows.select("batch", F.col("id").alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, "batch")
    pairs = pairs if with_self else pairs.where("a <> b")
    return pairs.select("batch", "a", "b", dot("va", "vb").alias("similarity"))


def _loss(df: DataFrame, id_col: str, vector_col: str, label_col: str, batch_col: str | None, temperature: float, positive) -> DataFrame:
    labels = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    pairs = pair_similarities(df, id_col, vector_col, batch_col, with_self=True)
    pairs = pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    pairs = pairs.withColumn("z", F.col("similarity") / temperature)
    # the stabilising maximum includes the pair of a row with itself
    tops = pairs.groupBy("batch", "a").agg(F.max("z").alias("top"))
    scaled = pairs.join(tops, ["batch", "a"]).withColumn("z", F.col("z") - F.col("top")).where("a <> b")
    is_pair: Column = positive(F.col("la"), F.col("lb"))
    one = scaled.groupBy("batch", "a").agg(F.sum(F.exp("z")).alias("denominator"), F.sum(F.when(is_pair, F.col("z")).otherwise(0.0)).alias("z_pos"), F.count_if(is_pair).alias("n_pos"))
    per_row = -(F.col("z_pos") - F.col("n_pos") * F.log(F.col("denominator") + GUARD)) / (F.col("n_pos") + GUARD)
    return one.where("n_pos > 0").agg(F.coalesce(F.avg(per_row), F.lit(0.0)).alias("loss"))


def supervised_contrastive_loss(df: DataFrame, id_col: str, vector_col: str, label_col: str, batch_col: str | None = None, temperature: float = 0.1) -> DataFrame:
    """One row (loss): rows of one label attract each other; rows without partner are left out; 0 without any."""
    return _loss(df, id_col, vector_col, label_col, batch_col, temperature, lambda a, b: a == b)


def one_class_contrastive_loss(df: DataFrame, id_col: str, vector_col: str, label_col: str, batch_col: str | None = None, temperature: float = 0.1) -> DataFrame:
    """One row (loss): only rows of label 1 attract each other."""
    return _loss(df, id_col, vector_col, label_col, batch_col, temperature, lambda a, b: (a == 1) & (b == 1))
