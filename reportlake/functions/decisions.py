"""Decisions from 1 (confident no) to 4 (confident yes): coercion, polarity, binary labels, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerced(v: Column) -> Column:
    """A JSON value as a decision: whole numbers and digit strings from 1 to 4, and true, which counts as 1; else null."""
    kind = F.schema_of_variant(v)
    text = F.regexp_extract(F.try_variant_get(v, "$", "string"), r"(?U)^\s*([0-9]+)\s*$", 1)
    number = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")).when(kind == "STRING", text.try_cast("bigint")).when((kind == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(1))
    return F.when(number.between(1, 4), number.cast("int"))


def polarity(decision: Column) -> Column:
    """-1 for 1 and 2, 1 for 3 and 4, 0 for anything else."""
    return F.when(decision.isin(1, 2), -1).when(decision.isin(3, 4), 1).otherwise(0)


def binary(decision: Column) -> Column:
    """0 for 1 and 2, 1 for 3 and 4, else null."""
    return F.when(decision.isin(1, 2), 0).when(decision.isin(3, 4), 1)


def confidence(probability: Column, epsilon: float = 0.1) -> Column:
    """The decision for a probability: below 0.5 - epsilon, below 0.5, below 0.5 + epsilon, and above."""
    return F.when(probability < 0.5 - epsilon, 1).when(probability < 0.5, 2).when(probability < 0.5 + epsilon, 3).otherwise(4)


def yes(probability: Column) -> Column:
    return F.when(probability > 0.5, F.lit("yes")).otherwise(F.lit("no"))


def consistent(four: list[Column], abnormality: Column) -> Column:
    """Whether a finding in any of four categories goes with abnormality, and none with none."""
    return (F.greatest(*four) >= 3) == (abnormality >= 3)


def signed(p: Column) -> Column:
    """A polarity as reports print it."""
    return F.when(p > 0, "+1").when(p < 0, "-1").otherwise(" 0")
