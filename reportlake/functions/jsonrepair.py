"""Repair of the JSON that language models drift into, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportlake.functions.text import let


def block(s: Column) -> Column:
    """From the first opening to the last closing brace; null where there is no such stretch."""
    first, last = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), "}") + 1
    return F.when((first > 0) & (F.instr(s, "}") > 0) & (last > first), F.substring(s, first, last - first + 1))


def _walk(s: Column) -> Column:
    """Braces from left to right: where the depth last returned to zero, and how often, until it falls below."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("ok"), F.lit(0).alias("returns"))

    def step(a: Column, piece: Column) -> Column:
        brace = F.substring(piece, 1, 1)
        depth = a["depth"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        back = (brace == "}") & (depth == 0)
        moved = F.struct((a["at"] + F.length(piece)).alias("at"), depth.alias("depth"), F.when(back, a["at"] + 1).otherwise(a["ok"]).alias("ok"), (a["returns"] + back.cast("int")).alias("returns"))
        return F.when(a["depth"] < 0, a).otherwise(moved)

    return F.aggregate(F.split(s, r"(?=[{}])"), start, step)


def balanced(s: Column) -> Column:
    """The prefix up to the last return to depth zero, all of it if there is none. Braces in strings count."""
    return let(_walk(s)["ok"], lambda ok: F.when(ok > 0, F.substring(s, F.lit(1), ok)).otherwise(s))


def returns(s: Column) -> Column:
    """How often the depth returns to zero: more than once means that a second value may follow the first."""
    return _walk(s)["returns"]


def without_trailing_commas(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U),(\s*[}\]])", "$1")


def printable(s: Column) -> Column:
    """ASCII without control characters but tab and line feed; everything else is deleted."""
    return F.regexp_replace(s, r"[^\t\n\x20-\x7E]", "")


def repaired(s: Column) -> Column:
    """All repairs in their order: block, balance, commas, escapes and doubled quotes, commas again, printable."""
    b = without_trailing_commas(let(F.coalesce(block(s), s), balanced))
    b = F.replace(F.replace(F.replace(b, F.lit("\\\\_"), F.lit("_")), F.lit("\\_"), F.lit("_")), F.lit("\\'"), F.lit("'"))
    b = F.regexp_replace(b, r'(?U)\.\s*""\s*([\]}])', '."$1')
    return printable(without_trailing_commas(b))
