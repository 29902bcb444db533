"""Reference lookups: from (aff, desig) to a sorted list of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import predicted_number


def build_lookup(registry: DataFrame, aff: str = "aff_abbr", desig: str = "desig_num", number: str = "f_num", normalise: bool = False) -> DataFrame:
    """(aff, desig, fnums): distinct numbers in order.

    Rows without affiliation (null or empty), designation (null) or number are left out. Designations stay as
    they are written unless ``normalise`` takes their leading zeros away.
    """
    rows = registry.where(F.col(aff).isNotNull() & (F.col(aff) != "") & F.col(desig).isNotNull() & F.col(number).isNotNull())
    key = predicted_number(desig) if normalise else F.col(desig)
    return rows.select(F.col(aff).alias("aff"), key.alias("desig"), F.col(number).cast("bigint").alias("f")).distinct().groupBy("aff", "desig").agg(F.array_sort(F.collect_list("f")).alias("fnums"))


def lookup(df: DataFrame, table: DataFrame, aff: str = "affiliation", desig: str = "designation", out_col: str = "fnums", small_rows: int = 1_000_000) -> DataFrame:
    """Adds ``out_col``, the list of each row's key; empty for a miss and for empty or null keys.

    The table's keys are unique, so rows don't multiply. No hint is given: the adaptive planner broadcasts the table if its bytes, as
    measured when it has been made, are below the session's threshold, and joins by shuffle else; with ``small_rows`` 0 always.
    """
    side = table.select(F.col("aff").alias("_aff"), F.col("desig").alias("_desig"), F.col("fnums").alias("_fnums"))
    if not small_rows:
        side = side.hint("merge")
    keys = (F.nullif(F.col(aff), F.lit("")) == F.col("_aff")) & (F.nullif(F.col(desig), F.lit("")) == F.col("_desig"))
    return df.join(side, keys, "left").withColumn(out_col, F.coalesce("_fnums", F.array().cast("array<bigint>"))).drop("_aff", "_desig", "_fnums")


def lookup_one(table: DataFrame, aff: str, desig: str) -> list[int]:
    """The list of one key."""
    row = table.where((F.col("aff") == aff) & (F.col("desig") == desig)).select("fnums").head()
    return list(row["fnums"]) if row else []
