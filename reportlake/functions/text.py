"""Text functions, Column to Column, with Unicode word and space classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized(c: Column) -> Column:
    """Lower case, marks to blanks, white space to single blanks, stripped; null gives an empty text."""
    marks = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(marks, r"(?U)\s+", " "))


def phrases(c: Column) -> Column:
    """The non-empty parts between semicolons; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda p: p != "")


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def contains_phrase(report: Column, phrase: Column) -> Column:
    """Whether the normalised phrase stands in the normalised report, anywhere; an empty one doesn't."""
    return (phrase != "") & F.contains(report, phrase)


def one_line(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\n"), F.lit(" ")))


def terms(c: Column) -> Column:
    """Lower-case ASCII words of three letters or more, as the bag of words counts them."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b([a-zA-Z]{3,})\b"), F.lit(1))


def sorted_tokens(c: Column) -> Column:
    # array_sort compares by an interpreted function, which takes most of the time of long texts
    return F.array_join(F.sort_array(F.split(c, " ")), " ")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision; null where one of them is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
