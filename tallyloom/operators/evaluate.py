"""Evaluation of predictions in one pass, ROC curve and threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import predicted_number, true_number

#: Ranges of scores in which a curve's running sums are taken side by side.
BANDS = 200
RATIOS = {
    "aff_accuracy": ("aff_correct", "total"),
    "aff_non_none_accuracy": ("aff_non_none_correct", "aff_non_none_total"),
    "desig_accuracy": ("desig_correct", "total"),
    "desig_accuracy_given_has": ("desig_correct_given_has", "has_desig_total"),
    "desig_accuracy_given_none": ("desig_correct_given_none", "no_desig_total"),
    "joint_accuracy": ("joint_correct", "total"),
    "joint_non_none_accuracy": ("joint_non_none_correct", "aff_non_none_total"),
}


def judged(df: DataFrame, known: list[str] | None = None, true_aff: str = "true_aff", true_desig: str = "true_desig", pred_aff: str = "pred_aff", pred_desig: str = "pred_desig") -> DataFrame:
    """Adds normal forms and ``aff_match``, ``desig_match``; rows whose true affiliation isn't ``known`` go."""
    rows = df if known is None else df.where(F.col(true_aff).isin(*known))
    rows = rows.withColumn("_td", true_number(true_desig)).withColumn("_pd", predicted_number(pred_desig))
    return rows.withColumn("aff_match", F.coalesce(F.col(pred_aff) == F.col(true_aff), F.lit(False))).withColumn("desig_match", F.col("_td") == F.col("_pd"))


def metrics(judgements: DataFrame, pred_aff: str = "pred_aff") -> DataFrame:
    """One row: the total, ten counters and seven guarded ratios."""
    said = F.col(pred_aff).isNotNull()
    aff, desig, has = F.col("aff_match"), F.col("desig_match"), F.col("_td") != ""

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    counted = judgements.agg(
        F.count("*").alias("total"),
        count(aff, "aff_correct"),
        count(said, "aff_non_none_total"),
        count(said & aff, "aff_non_none_correct"),
        count(desig, "desig_correct"),
        count(has, "has_desig_total"),
        count(has & desig, "desig_correct_given_has"),
        count(~has, "no_desig_total"),
        count(~has & desig, "desig_correct_given_none"),
        count(aff & desig, "joint_correct"),
        count(said & aff & desig, "joint_non_none_correct"),
    )
    return counted.select("*", *(F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0)).alias(name) for name, (n, d) in RATIOS.items()))


def errors(judgements: DataFrame, text: str = "text", true_aff: str = "true_aff", pred_aff: str = "pred_aff") -> DataFrame:
    """Rows that aren't right in both parts, texts clipped to 80 characters."""
    return judgements.where(~(F.col("aff_match") & F.col("desig_match"))).select(
        F.substring(text, 1, 80).alias("text"), F.col(true_aff).alias("true_aff"), F.col(pred_aff).alias("pred_aff"), "aff_match", F.col("_td").alias("true_desig"), F.col("_pd").alias("pred_desig"), "desig_match"
    )


def error_breakdown(judgements: DataFrame) -> DataFrame:
    """One row: errors in the affiliation alone, the designation alone, and both."""
    aff, desig = F.col("aff_match"), F.col("desig_match")
    return judgements.agg(F.count_if(~aff & desig).alias("aff_only"), F.count_if(aff & ~desig).alias("desig_only"), F.count_if(~aff & ~desig).alias("both"))


def roc_curve(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) for each distinct score, predicting positive at it or above.

    Scores are counted first, so the running sums go over distinct scores. They are taken in two levels: inside ranges
    of scores, and over the few sums of ranges, so no task sees them all.
    """
    counts = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    # bands of equal counts, cut at approximate quantiles; one row of a few numbers
    cuts = df.agg(F.percentile_approx(F.col(score).cast("double"), [k / BANDS for k in range(1, BANDS)], 10 * BANDS).alias("c"))
    banded = counts.join(F.broadcast(cuts)).withColumn("band", F.coalesce(F.size(F.filter("c", lambda x: x < F.col("threshold"))), F.lit(0))).drop("c")
    sums = banded.groupBy("band").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    down = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BANDS rows at most
    over = sums.select("band", (F.sum("bp").over(down) - F.col("bp")).alias("p0"), (F.sum("bn").over(down) - F.col("bn")).alias("n0"), F.sum("bp").over(Window.partitionBy(F.lit(0))).alias("all_p"), F.sum("bn").over(Window.partitionBy(F.lit(0))).alias("all_n"))
    within = Window.partitionBy("band").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = banded.join(F.broadcast(over), "band").withColumn("tp", F.col("p0") + F.sum("p").over(within)).withColumn("fp", F.col("n0") + F.sum("n").over(within))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return curve.select("threshold", "tp", "fp", share("tp", "all_p").alias("tpr"), share("fp", "all_n").alias("fpr"), "p", "n", "all_p", "all_n")


def roc_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row (auc): the chance that a positive scores above a negative, ties counting half; null without both."""
    curve = roc_curve(df, score, positive)
    won = F.sum((F.col("all_n") - F.col("fp")) * F.col("p") + F.col("p") * F.col("n") * F.lit(0.5).cast("double"))
    both = F.max("all_p") * F.max("all_n")
    return curve.agg(F.when(both > 0, won / both).alias("auc"))


def youden_threshold(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row (threshold, j): where tpr - fpr is largest, the highest such score."""
    curve = roc_curve(df, score, positive).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = curve.agg(F.max(F.struct(F.round("j", 12).alias("r"), F.col("threshold").alias("t"), F.col("j").alias("j"))).alias("b"))
    return best.select(F.col("b.t").alias("threshold"), F.col("b.j").alias("j"))
