"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_written, written

_MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of u go to the least of u and its neighbours. Small star: smaller ones and u."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = both.where("b < a")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least).distinct()


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(id, component) of every id in ``edges`` (a, b long), component being its least id; and the tables behind it.

    Both stars keep components and shrink distances, so the rounds end when every id points at the
    least id of its component. Each round's edges are written to the shared folder.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(_MOST_ROUNDS):
        after, new_path = written(_star(_star(now, True), False), "edges")
        drop_written(spark, path)
        now, path = after, new_path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components haven't converged in {_MOST_ROUNDS} rounds")
    # converged: every id but the least of a component has one edge, to that least id
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots), [path]
