"""Scalar rules of result records: gates, number lists, normal forms for evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def passes(score: Column | str, threshold: float) -> Column:
    """``score >= threshold``, false for null and NaN, which Spark would put above every number."""
    score = F.col(score) if isinstance(score, str) else score
    return F.coalesce(~F.isnan(score) & (score >= threshold), F.lit(False))


def accept(score: Column | str, value: Column | str, threshold: float) -> Column:
    """``value`` where the score passes, else null."""
    return F.when(passes(score, threshold), F.col(value) if isinstance(value, str) else value)


def format_list(numbers: Column | str) -> Column:
    """Empty for none, the number for one, ``[1, 2]`` for several."""
    numbers = F.col(numbers) if isinstance(numbers, str) else numbers
    texts = F.transform(numbers, lambda n: n.cast("string"))
    return F.when(F.coalesce(F.size(numbers), F.lit(0)) <= 0, "").when(F.size(numbers) == 1, F.get(texts, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]")))


def format_multiple(numbers: Column | str) -> Column:
    """Empty for no number, ``False`` for one, ``True`` for several."""
    size = F.coalesce(F.size(numbers), F.lit(0))
    return F.when(size <= 0, "").when(size == 1, "False").otherwise("True")


def format_score(score: Column | str) -> Column:
    """Four decimals, half to even on the exact binary value; ``nan`` for NaN."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(F.isnan(score), "nan").otherwise(F.call_function("format_number", score, F.lit("0.0000")))


def format_bool(flag: Column | str) -> Column:
    return F.initcap(F.col(flag).cast("string") if isinstance(flag, str) else flag.cast("string"))


def true_number(number: Column | str) -> Column:
    """A labelled number for comparison: the part before the first dot, without leading zeros; null is empty."""
    return F.coalesce(F.ltrim(F.split_part(number, F.lit("."), F.lit(1)), F.lit("0")), F.lit(""))


def predicted_number(number: Column | str) -> Column:
    """A predicted number for comparison: without leading zeros; null is empty."""
    return F.coalesce(F.ltrim(number, F.lit("0")), F.lit(""))


def not_in(column: Column | str, values: list) -> Column:
    """True outside ``values``, for null too."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(~column.isin(*values), F.lit(True))
