"""Which reports to work on: pending ones, slices, complete rows, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.operators.numbering import numbered


def completed_ids(results: DataFrame) -> DataFrame:
    return results.select("report_id").dropna().distinct()


def pending(reports: DataFrame, completed: DataFrame, quota: int, most: int | None = None) -> DataFrame:
    """The first reports in scan order that aren't completed, as many as the quota leaves, or `most` of them.

    Every completed id counts against the quota, also one that isn't among the reports. The limit is a top-k: each
    task keeps its first rows only.
    """
    done = completed_ids(completed)
    left = max(quota - done.count(), 0)
    left = left if most is None else min(left, most)
    return reports.join(done, "report_id", "left_anti").orderBy("pos").limit(left)


def clamped(reports: DataFrame, start: int, end: int) -> DataFrame:
    """Rows from start up to end by position, with both ends moved into the table."""
    return reports.where((F.col("pos") >= max(start, 0)) & (F.col("pos") < max(end, 0)))


def strict(reports: DataFrame, start: int, end: int) -> DataFrame:
    """As clamped(), but ends outside the table or out of order are errors."""
    n = reports.count()
    if start < 0 or end > n or start >= end:
        raise ValueError(f"no rows {start} to {end} in a table of {n}")
    return clamped(reports, start, end)


def complete(rows: DataFrame, labels: list[str]) -> DataFrame:
    return rows.dropna(subset=labels)


def stratified_folds(rows: DataFrame, label: str = "y", folds: int = 5) -> DataFrame:
    """rows(pos, label, ...) with `fold`: blocks in order within each class, without shuffling.

    Classes are numbered by first appearance and laid end to end; the position p of that order belongs to stripe p mod folds, and
    a class gives each fold, in turn, as many of its rows as it has positions in that stripe. Ranks within a class are numbered in
    parts, so no task holds a class; rows without a label are a class of their own; the counts a class needs of the others are a table of one row for each class.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    upto = lambda end, i: F.floor((F.col(end) - 1 - i + folds) / folds)
    sizes = sizes.withColumn("_end", F.col("_start") + F.col("_n"))
    total = F.lit(0)
    for i in range(folds):
        total = total + upto("_end", i) - upto("_start", i)
        sizes = sizes.withColumn(f"_c{i}", total)
    sizes = sizes.withColumnRenamed(label, "_label")
    ranked = numbered(rows, ["pos"], "_r", within=(label,))
    ranked = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    fold = sum((F.when(F.col(f"_c{i}") <= F.col("_r"), 1).otherwise(0) for i in range(folds)), F.lit(0))
    return ranked.select(*rows.columns, fold.cast("int").alias("fold"))


def positioned(rows: DataFrame, by: str) -> DataFrame:
    """rows with `pos`, a gapless scan order by an id, without one task that sorts the table."""
    return numbered(rows, [by], "pos")
