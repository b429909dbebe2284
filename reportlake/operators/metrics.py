"""Metrics of binary predictions, for each fold and over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_metrics(rows: DataFrame) -> DataFrame:
    """rows(category, fold, y, predicted) to accuracy, precision, recall and f1 of label 1; a division by zero gives 0."""
    hit = lambda a, b: F.count_if((F.col("y") == a) & (F.col("predicted") == b))
    sums = rows.groupBy("category", "fold").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), F.count_if(F.col("y") == F.col("predicted")).alias("right"), F.count(F.lit(1)).alias("n"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("category", "fold", share(F.col("right"), F.col("n")).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def mean_metrics(folds: DataFrame) -> DataFrame:
    return folds.groupBy("category").agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def token_lengths(rows: DataFrame, tokens: str) -> DataFrame:
    size = F.size(tokens)
    return rows.agg(F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_len"), F.coalesce(F.max(size), F.lit(0)).alias("max_len"), F.coalesce(F.min(size), F.lit(0)).alias("min_len"))
