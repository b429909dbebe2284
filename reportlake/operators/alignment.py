"""Alignment of reasons with decisions: polarity counts, agreement, disagreements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.functions.decisions import polarity
from reportlake.functions.polarity import reason_polarity


def judged(long: DataFrame) -> DataFrame:
    """long with the polarity of the reason, by the rules unless it has one, and of the decision."""
    rows = long if "reason_polarity" in long.columns else long.withColumn("reason_polarity", reason_polarity(F.col("reason")))
    return rows.withColumn("label_polarity", polarity(F.col("decision")))


def distribution(rows: DataFrame) -> DataFrame:
    p = F.col("reason_polarity")
    return rows.groupBy("category").agg(F.count_if(p == 1).alias("positive"), F.count_if(p == -1).alias("negative"), F.count_if(p == 0).alias("unclear"))


def agreement(rows: DataFrame) -> DataFrame:
    """Agreement on labelled rows; a category without any is left out."""
    same = F.col("reason_polarity") == F.col("label_polarity")
    return rows.where("label_polarity <> 0").groupBy("category").agg(F.count(F.lit(1)).alias("n_labeled"), F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"))


def overall(stats: DataFrame) -> DataFrame:
    """All categories together, and each, in percent; zero where there is nothing."""
    sums = stats.rollup("category").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_labeled", "agree", "disagree")])
    share = F.coalesce(F.try_divide(F.lit(100.0) * F.col("agree"), F.col("n_labeled")), F.lit(0.0))
    return sums.select(F.coalesce("category", F.lit("(all)")).alias("category"), "n_labeled", "agree", "disagree", share.alias("accuracy"))


def disagreements(rows: DataFrame) -> DataFrame:
    apart = rows.where("label_polarity <> 0 AND reason_polarity <> label_polarity")
    return apart.select("report_id", "category", F.coalesce("reason", F.lit("")).alias("explanation"), "reason_polarity", "label_polarity")
