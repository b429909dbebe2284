"""Gapless row numbers in a global order, without sorting the table, or a class of its rows, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.text import let

#: Parts at least, rows of a part at the most, about, and sampled keys for each part.
PARTS, ROWS, SAMPLES = 64, 1_000_000, 64


def _at_or_below(splitters: Column, n: int, key: Column) -> Column:
    """How many of n sorted splitters are at or below the key, by halving steps."""
    at, step = F.lit(0), 1 << max(n.bit_length() - 1, 0)
    while step and n:
        at = let(at, lambda x, s=step: x + F.when((x + s <= n) & (F.element_at(splitters, F.least(x + s, F.lit(n))) <= key), s).otherwise(0))
        step >>= 1
    return at


def numbered(rows: DataFrame, by: list[str], name: str, within: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """rows with 0, 1, ... in the order of `by` (nulls first), over all rows or within the groups of `within`.

    There is a part for each million rows. Splitters from a sample of the first column cut its order into parts; rows are numbered inside their part, from
    an offset that the counts of the parts before give. Rows of one key share a part, so the first column should be
    an id or another column without very common values.
    """
    key = by[0]
    n = rows.count()
    parts = parts or max(PARTS, -(-n // ROWS))
    drawn = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < min(1.0, SAMPLES * parts / max(n, 1)) * (1 << 30)).select(key).where(F.col(key).isNotNull()).distinct()
    keys = sorted(r[0] for r in drawn.collect())
    splitters = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    kind = rows.schema[key].dataType
    at = _at_or_below(F.array(*[F.lit(s).cast(kind) for s in splitters]), len(splitters), F.col(key)) if splitters else F.lit(0)
    cut = rows.withColumn("_part", F.when(F.col(key).isNull(), -1).otherwise(at))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = cut.withColumn("_inside", F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*by)) - 1)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*within, "_part")]
    joined = inside.alias("r").join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"r.`{c}`") for c in rows.columns], (F.col("_offset") + F.col("_inside")).cast("long").alias(name))
