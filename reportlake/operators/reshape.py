"""Wide and long forms of labels and reasons, unions and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.schema import CATEGORIES


def long_form(wide: DataFrame, carry: list[str]) -> DataFrame:
    """A row per report and category: carry, category, decision, reason. Columns are `L` and `L Reasons`."""
    has = lambda c: F.col(f"`{c}`") if c in wide.columns else F.lit(None)
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), has(c).cast("int").alias("decision"), has(f"{c} Reasons").cast("string").alias("reason")) for c in CATEGORIES])
    return wide.select(*carry, F.explode(pairs).alias("_p")).select(*carry, "_p.*")


def wide_form(long: DataFrame, carry: list[str], value: Column | None = None) -> DataFrame:
    """A row per report with a column per category, in the labels' order."""
    return long.groupBy(*carry).pivot("category", CATEGORIES).agg(F.first(F.col("decision") if value is None else value))


def wide_reasons(long: DataFrame) -> DataFrame:
    """A row per report: for each label its decision and, under `L Reasons`, its reason."""
    wide = long.groupBy("report_id").pivot("category", CATEGORIES).agg(F.first("decision").alias("d"), F.first("reason").alias("r"))
    return wide.select("report_id", *[F.col(f"`{c}_{x}`").alias(c + title) for c in CATEGORIES for x, title in (("d", ""), ("r", " Reasons"))])


def appended(before: DataFrame, new: DataFrame) -> DataFrame:
    """Results so far and new ones, by name; what one side lacks is null."""
    return before.unionByName(new, allowMissingColumns=True)


def with_report_text(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """rows(report_id, report) with report_text: the embedded report, else the stored one."""
    stored = reports.select("report_id", F.col("report").alias("_stored"))
    return rows.join(stored, "report_id", "left").withColumn("report_text", F.coalesce("report", "_stored")).drop("_stored")


def missing_texts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("report_text").isNull()).alias("n_missing"))


def private(rows: DataFrame) -> DataFrame:
    """Without the report's text, if there is one."""
    return rows.drop("report")


def any_value(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column whether it holds any value at all."""
    return rows.agg(*[(F.count(F.col(f"`{c}`")) > 0).alias(c) for c in columns])
