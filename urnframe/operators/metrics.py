"""Classification metrics as aggregates over prediction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urnframe.functions.columns import quantize
from urnframe.plans.joins import spread
from urnframe.plans.series import CHUNK_BITS, running

SCORE_SCALE = 10**12  # scores are compared at twelve decimals
SCORE_BITS = 24  # width of a chunk of scaled scores


def classification_metrics(
    predictions: DataFrame, by: Sequence[str], zero_division: float = 1.0
) -> DataFrame:
    """Accuracy, precision, recall and F1 per group; ``zero_division`` where undefined."""
    hit, said = F.col("label") == 1, F.col("prediction") == 1
    counts = predictions.groupBy(*by).agg(
        F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"),
        F.count_if(~hit & ~said).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def share(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, F.lit(float(zero_division))).otherwise(top / bottom)

    return counts.select(
        *by,
        "tp",
        "fp",
        "fn",
        "tn",
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _score_key() -> Column:
    return F.round(F.col("score") * SCORE_SCALE).cast("long")


def roc_auc(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank-sum AUC with ties averaged; 0.5 when only one class occurs.

    Equal scores are counted first; ranks are running counts over the distinct scores of a range, and
    the ranges' sums are carried on: no group is sorted as a whole, no carry is joined back to the scores.
    """
    by = list(by)
    counted = predictions.groupBy(*by, _score_key().alias("_k")).agg(
        F.count("*").alias("_n"), F.count_if(F.col("label") == 1).alias("_p")
    )
    parts = [*by, "_kc"]
    below = F.sum("_n").over(W.partitionBy(*parts).orderBy("_k").rowsBetween(W.unboundedPreceding, -1))
    ranged = spread(counted.withColumn("_kc", F.shiftright("_k", SCORE_BITS)), *parts).withColumn("_below", F.coalesce(below, F.lit(0)))
    per_range = ranged.groupBy(*parts).agg(
        F.sum(F.col("_p") * (F.col("_below") + (F.col("_n") + 1) / 2)).alias("_r"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n")
    )
    ranked = running(per_range, by, "_kc", {"_lower": ("sum", F.col("_n"))}, exclusive=True)
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("_r") + F.col("_p") * F.col("_lower")).alias("_r"),
        F.sum("_p").alias("_p"),
        F.sum(F.col("_n") - F.col("_p")).alias("_q"),
    )
    p, q = F.col("_p").cast("double"), F.col("_q").cast("double")
    auc = F.when((p == 0) | (q == 0), F.lit(0.5)).otherwise(
        (F.col("_r") - p * (p + 1) / 2) / (p * q)
    )
    return sums.select(*by, auc.alias("roc_auc"))


def trapezoid_auc(predictions: DataFrame, by: Sequence[str], tie: str = "draw_number") -> DataFrame:
    """AUC over rows in descending score order, equal scores ordered by ``tie``.

    Each negative adds the positives ahead of it: those with a higher score and those before it in its
    own score. They are counted in three steps that each leave fewer rows: inside a range of
    ``tie`` of one score, inside a range of scores, and over the ranges of scores. No carry is joined
    back to the rows.
    """
    by = list(by)
    rows = predictions.select(
        *by, F.col(tie).cast("long").alias("_t"), F.col("label").cast("int").alias("_y"), (-_score_key()).alias("_k")
    )
    negative = F.col("_y") == 0
    parts = [*by, "_k", "_tc"]
    ahead = F.sum("_y").over(W.partitionBy(*parts).orderBy("_t").rowsBetween(W.unboundedPreceding, -1))
    # Slim rows are packed well: partitions sized by bytes would hold too many of them.
    inner = spread(rows.withColumn("_tc", F.shiftright("_t", CHUNK_BITS)), *parts).withColumn("_ahead", F.coalesce(ahead, F.lit(0)))
    level = inner.groupBy(*parts).agg(
        F.sum("_y").alias("_p"), F.count_if(negative).alias("_q"), F.sum(F.when(negative, F.col("_ahead")).otherwise(0)).alias("_a")
    )
    parts = [*by, "_kc"]
    before = F.sum("_p").over(W.partitionBy(*parts).orderBy("_k", "_tc").rowsBetween(W.unboundedPreceding, -1))
    ranged = spread(level.withColumn("_kc", F.shiftright("_k", SCORE_BITS)), *parts).withColumn("_before", F.coalesce(before, F.lit(0)))
    per_range = ranged.groupBy(*parts).agg(
        F.sum("_p").alias("_p"), F.sum("_q").alias("_q"), F.sum(F.col("_a") + F.col("_q") * F.col("_before")).alias("_a")
    )
    ranked = running(per_range, by, "_kc", {"_higher": ("sum", F.col("_p"))}, exclusive=True)
    sums = ranked.groupBy(*by).agg(
        F.sum("_p").cast("double").alias("_p"),
        F.sum("_q").cast("double").alias("_q"),
        F.sum(F.col("_q") * F.col("_higher") + F.col("_a")).cast("double").alias("_a"),
    )
    single = (F.col("_p") == 0) | (F.col("_q") == 0)
    auc = F.when(single, F.lit(0.5)).otherwise(F.col("_a") / (F.col("_p") * F.col("_q")))
    return sums.select(*by, auc.alias("roc_auc"))


def long_metrics(wide: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return wide.select(*by, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        list(by), list(names), "metric_name", "value"
    )


def macro_average(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over numbers per metric, eight decimals."""
    return metrics.groupBy(*by, "metric_name").agg(F.round(F.avg("value"), 8).alias("value"))


def multilabel_metrics(predictions: DataFrame, by: Sequence[str], threshold: float = 0.5):
    """Scores cut at ``threshold``, undefined ratios 0, averaged over numbers."""
    cut = predictions.withColumn("prediction", (F.col("score") >= threshold).cast("int"))
    per_number = classification_metrics(cut, [*by, "number"], zero_division=0.0)
    names = ["accuracy", "precision", "recall", "f1"]
    return macro_average(long_metrics(per_number, [*by, "number"], names), by)


def quantized(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("value", quantize("value"))
