"""Predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(truth: DataFrame, predicted: DataFrame, by: str = "file_id", key: str = "rule_id") -> DataFrame:
    """(by, tp, fp, fn): set semantics on the key within each file."""
    t = truth.select(by, key).distinct().withColumn("_t", F.lit(1))
    p = predicted.select(by, key).distinct().withColumn("_p", F.lit(1))
    both = t.join(p, [by, key], "full_outer")
    return both.groupBy(by).agg(
        F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"),
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(100.0 * part / whole, 2))


def metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 in percent, 0 where there is nothing to divide by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", _percent(tp, tp + fp).alias("precision"), _percent(tp, tp + fn).alias("recall"), _percent(2 * tp, 2 * tp + fp + fn).alias("f1"))


def micro_average(counts: DataFrame) -> DataFrame:
    """One row over all files: sums, findings, missed, and the metrics of the sums."""
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return metrics(sums).withColumn("findings", F.col("tp") + F.col("fp")).withColumn("missed", F.col("fn"))


def fractions(counts: DataFrame) -> DataFrame:
    """Counts (tp, fp, fn, tn) with fractions; precision is 1 where nothing was predicted, recall then 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp))
    recall = F.when(tp + fn == 0, F.lit(0.0)).otherwise(tp / (tp + fn))
    df = counts.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    df = df.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))
    return df.withColumn("false_positive_rate", F.when(fp + tn == 0, F.lit(0.0)).otherwise(fp / (fp + tn)))


def agreed(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return truth.intersect(predicted)


def missed(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return truth.subtract(predicted)
