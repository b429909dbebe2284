"""Readers by file name: reports, raw results, explanations, grammars."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.operators.reshape import long_form
from reportlake.operators.selection import completed_ids, positioned
from reportlake.schema import CATEGORIES, ID_NAMES, RAW_RESULTS, conform, id_column
from reportlake.sources import xlsx
from reportlake.sources.sqlite import sqlite_table


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with JSON in its cells: cells may hold line breaks, and a double quote is written twice."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(str(path))


#: Readers by suffix; a database or workbook needs the name of a table.
READERS = {".parquet": parquet_table, ".csv": csv_table}
TABLED = {".db": sqlite_table, ".sqlite": sqlite_table, ".xlsx": xlsx.table}


def read_table(spark: SparkSession, path: str, table: str = "reports") -> DataFrame:
    """A table by its file's suffix; a folder without one holds Parquet."""
    suffix = Path(path).suffix.lower()
    if suffix in TABLED:
        return TABLED[suffix](spark, path, table)
    if not suffix and Path(path).is_dir():
        suffix = ".parquet"
    if suffix not in READERS:
        raise ValueError(f"unknown format {suffix} of {path}; known: {', '.join([*READERS, *TABLED])} and folders of Parquet")
    return READERS[suffix](spark, path)


def explanations(spark: SparkSession, path: str) -> DataFrame:
    """report_id, category, decision, reason, report (null where the table has none), from a long table or a wide one with a column for each label."""
    found = read_table(spark, path, "explanations")
    text = next((F.col(c) for c in ("report", "Report") if c in found.columns), F.lit(None))
    rows = found.withColumn("report", text.cast("string")).withColumnRenamed(id_column(found.columns), "report_id")
    if "category" not in rows.columns:
        rows = long_form(rows, ["report_id", "report"])
    return rows.select(F.col("report_id").cast("string").alias("report_id"), "category", F.col("decision").cast("int").alias("decision"), "reason", "report")


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """report_id and the five label columns of annotated reports, whatever the id column's name."""
    found = read_table(spark, path)
    return found.select(F.col(f"`{id_column(found.columns)}`").cast("string").alias("report_id"), *[F.col(f"`{c}`").cast("int").alias(c) for c in CATEGORIES])


def reports(spark: SparkSession, path: str, table: str = "reports") -> DataFrame:
    """report_id, report (text as strings), pos: scan order by id. The id may have an older name; the source is never changed."""
    found = read_table(spark, path, table)
    key = id_column(found.columns)
    text = "Report" if "Report" in found.columns else "report"
    rows = found.select(F.col(f"`{key}`").cast("string").alias("report_id"), F.col(text).cast("string").alias("report"), *(["pos"] if "pos" in found.columns else []))
    return rows.withColumn("pos", F.col("pos").cast("long")) if "pos" in found.columns else positioned(rows, "report_id")


def raw_results(spark: SparkSession, path: str | None) -> DataFrame:
    """Results so far with their three columns, missing ones null; nothing to read gives an empty table."""
    if path is None or not Path(path).exists():
        return spark.createDataFrame([], RAW_RESULTS)
    found = csv_table(spark, path)
    return conform(found, RAW_RESULTS, {n: "report_id" for n in ID_NAMES if n in found.columns})


def completed(spark: SparkSession, path: str | None) -> tuple[DataFrame, DataFrame]:
    """Results so far and their distinct ids."""
    rows = raw_results(spark, path)
    return rows, completed_ids(rows)


def grammar(path: str) -> str:
    """A grammar file's text; a missing or empty one is an error."""
    text = Path(path).read_text()
    if not text.strip():
        raise ValueError(f"{path} is empty")
    return text
