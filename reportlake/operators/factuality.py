"""Factuality: is a positive decision's reason traceable to its report.

Three stages, from cheap to dear, each for the instances that the one before left: the normalised phrase stands in
the normalised report; the token-sort ratio of both reaches a limit; the cosine of their vectors does. Only the
second and third run Python, and only on what is left for them: a Python function runs for every row of its stage,
so rows that need no answer reach it as nulls and cost nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from reportlake.functions.text import contains_phrase, cosine, is_blank, let, normalized, phrases, sorted_tokens
from reportlake.schema import NO_REASON_GIVEN

FUZZY, SEMANTIC = 70, 0.70
#: The ratio is 2 M / (a + b) with M at most the shorter length, so a rounded 70 needs lengths at least this alike.
LEAST_ALIKE = 0.53


def instances(long: DataFrame) -> DataFrame:
    """Positive decisions of long(report_id, category, decision, reason, report_text), with the normalised report and
    phrases, whether the reason is blank, and whether a phrase stands in the report (`direct`).

    A table that has `report_norm` already, made once a report before the categories were set apart, is spared the work.
    """

    def facts(report: Column) -> Column:
        found = F.filter(F.transform(phrases(F.col("reason")), normalized), lambda p: p != "")
        return let(found, lambda ph: F.struct(report.alias("report_norm"), ph.alias("phrases"), is_blank(F.col("reason")).alias("blank"), F.exists(ph, lambda p: contains_phrase(report, p)).alias("direct")))

    report = F.col("report_norm") if "report_norm" in long.columns else normalized(F.col("report_text"))
    rest = [F.col(f"`{c}`") for c in long.columns if c != "report_norm"]
    # a generator of one row: texts are normalised once, however often the stages look at them
    return long.where(F.col("decision").isin(3, 4)).select(*rest, F.inline(F.array(let(report, facts))))


def told_reason() -> Column:
    return F.when(F.col("blank"), NO_REASON_GIVEN).otherwise(F.col("reason"))


def substring_stage(rows: DataFrame) -> DataFrame:
    """instances with `matched` by the first stage alone; a blank reason is unmatched and named so."""
    return rows.select("report_id", "category", told_reason().alias("reason"), F.col("direct").alias("matched"))


def comparable(c: Column) -> Column:
    """A text as the ratio sees it: the second half of Latin-1 dropped, marks to blanks, tokens sorted."""
    return sorted_tokens(normalized(F.regexp_replace(c, "[\u0080-\u00ff]", "")))


@lru_cache(64)
def ratio(a: str, b: str) -> int:
    """Similarity of two prepared texts from 0 to 100. Kept for a while: the categories of a report often share a reason."""
    if not a or not b:
        return 0
    if a == b:
        return 100
    return int(round(100 * (2.0 * matched(a, b) / (len(a) + len(b)) if len(b) >= AUTOJUNK else SequenceMatcher(None, a, b).ratio())))


#: Characters of the second text from which difflib begins matches only at characters that make up one in a hundred of it, or less.
AUTOJUNK = 200


def matched(a: str, b: str) -> int:
    """How many characters SequenceMatcher(None, a, b) matches, for b of AUTOJUNK characters or more, in about linear time.

    difflib takes the longest common run of rare characters, the first in a and then in b, extends it by whatever equal characters
    stand beside it, and does the same in the rectangles before and after it; where no rare character is common, only equal beginnings
    match. Here all rectangles are searched together, for runs of the greatest length first: what stands before the first
    run of a length holds none of it, so a text is passed once for each length of run.
    """
    least = len(b) // 100 + 1
    rare = "".join(re.escape(c) for c, n in Counter(b).items() if n <= least)
    runs = [[m.span() for m in re.finditer(f"[{rare}]+", t)] if rare else [] for t in (a, b)]

    def places(k: int) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for s, e in runs[1]:
            for j in range(s, e - k + 1):
                found.setdefault(b[j : j + k], []).append(j)
        return found

    def common(k: int) -> bool:
        there = places(k)
        return any(a[i : i + k] in there for s, e in runs[0] for i in range(s, e - k + 1))

    low, high = 0, min(max((e - s for s, e in own), default=0) for own in runs)
    while low < high:  # the longest common run
        k = (low + high + 1) // 2
        low, high = (k, high) if common(k) else (low, k - 1)
    total, rest = 0, [(0, len(a), 0, len(b))]
    for k in range(low, 0, -1):
        there = places(k)
        starts = [i for s, e in runs[0] for i in range(s, e - k + 1) if a[i : i + k] in there]
        todo, rest = rest, []
        for a0, a1, b0, b1 in todo:
            at = bisect_left(starts, a0)
            while at < len(starts) and (i := starts[at]) + k <= a1:
                at += 1
                own = there[a[i : i + k]]
                x = bisect_left(own, b0)
                if i < a0 or x == len(own) or (j := own[x]) + k > b1:
                    continue
                before = _alike_before(a, b, i, j, min(i - a0, j - b0))
                after = _alike_from(a, b, i + k, j + k, min(a1 - i, b1 - j) - k)
                total += before + k + after
                if i - before > a0 and j - before > b0:
                    rest.append((a0, i - before, b0, j - before))
                a0, b0 = i + k + after, j + k + after
            if a0 < a1 and b0 < b1:
                rest.append((a0, a1, b0, b1))
    return total + sum(_alike_from(a, b, a0, b0, min(a1 - a0, b1 - b0)) for a0, a1, b0, b1 in rest)


def _alike_from(a: str, b: str, i: int, j: int, most: int) -> int:
    """Equal characters from a[i] and b[j] on, `most` of them at the most."""
    n, step = 0, 8
    while step and n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, 2 * step
        else:
            step //= 2
    return n


def _alike_before(a: str, b: str, i: int, j: int, most: int) -> int:
    n, step = 0, 8
    while step and n < most:
        step = min(step, most - n)
        if a[i - n - step : i - n] == b[j - n - step : j - n]:
            n, step = n + step, 2 * step
        else:
            step //= 2
    return n


@F.pandas_udf(ArrayType(IntegerType()))
def _ratios(phrases_: pd.Series, report: pd.Series) -> pd.Series:
    return pd.Series([[ratio(a, b) if alike(a, b) else 0 for a in x] if x is not None and b else None for x, b in zip(phrases_, report, strict=True)], dtype="object")


@lru_cache(64)
def alike(a: str, b: str) -> bool:
    """Whether the ratio of two texts may reach LEAST_ALIKE's bound: by their lengths, then by the characters they have in common."""
    short, long = sorted((len(a), len(b)))
    return LEAST_ALIKE * long <= short and (Counter(a) & Counter(b)).total() * 200 >= (FUZZY - 0.5) * (short + long)


def with_ratios(rows: DataFrame) -> DataFrame:
    """rows with `comparable_phrases` and their `ratios`, null where no phrase is long enough to pass.

    Dropping characters of two bytes takes each and at most a blank beside it, so a prepared report is at least `left`
    long. Phrases under the bound for that length never reach Python, nor do their reports.
    """
    extra = F.octet_length("report_norm") - F.length("report_norm")
    left = F.length("report_norm") - 2 * extra
    able = F.filter("phrases", lambda p: F.length(p) >= LEAST_ALIKE * left)
    open_ = ~F.col("direct") & ~F.col("blank") & (F.size(able) > 0)
    rows = rows.select("*", F.inline(F.array(F.struct(F.when(open_, able).alias("comparable_phrases"), F.when(open_, comparable(F.col("report_norm"))).alias("_b")))))
    return rows.withColumn("ratios", _ratios(F.transform("comparable_phrases", comparable), F.col("_b"))).drop("_b")


def fuzzy_stage(rows: DataFrame, least: int = FUZZY) -> DataFrame:
    """(report_id, category, phrase, ratio) of phrases of instances without a direct match that reach the ratio."""
    # the outer form: for the inner one, and for a filter before it, the planner would work out the ratios twice
    each = with_ratios(rows)
    each = each.select("report_id", "category", F.explode_outer(F.arrays_zip(F.col("comparable_phrases").alias("phrase"), F.col("ratios").alias("ratio"))).alias("x"))
    return each.select("report_id", "category", "x.phrase", "x.ratio").where(F.col("ratio") >= least)


def audited(long: DataFrame, encode: Callable[[Column], Column] | None = None) -> DataFrame:
    """report_id, category, reason, matched, stage (which one matched) of every positive decision, in one pass without a shuffle."""
    rows = with_ratios(instances(long))
    fuzzy = F.coalesce(F.exists("ratios", lambda r: r >= FUZZY), F.lit(False))
    rows = rows.select("report_id", "category", told_reason().alias("reason"), "direct", "phrases", "report_norm", fuzzy.alias("fuzzy"))
    stage = F.when(F.col("direct"), "substring").when(F.col("fuzzy"), "fuzzy")
    if encode is not None:
        left = ~F.col("direct") & ~F.col("fuzzy") & (F.size("phrases") > 0)
        # encoders pass over nulls, and encode equal texts of a batch once
        report = F.when(left, F.when(F.col("report_norm") == "", " ").otherwise(F.col("report_norm")))
        joined = F.when(left, F.array_join("phrases", "\n"))
        rows = rows.withColumn("rv", encode(report)).withColumn("pv", encode(joined, parts="\n"))
        near = F.coalesce(F.exists("pv", lambda v: cosine(v, F.col("rv")) >= SEMANTIC), F.lit(False))
        stage = stage.when(near, "semantic")
    rows = rows.withColumn("stage", stage)
    return rows.select("report_id", "category", "reason", F.col("stage").isNotNull().alias("matched"), "stage")


#: Phrases' vectors that are held against all reports at a time; they travel as a broadcast.
PHRASES = 10_000


def supported(phrases_: DataFrame, reports: DataFrame, least: float = SEMANTIC) -> DataFrame:
    """phrase_id, report_id, similarity of phrases(id, v) and reports(id, v) of different ids whose cosine, in double precision, is at least `least`.

    Phrases are a stated set of queries, held against every report by matrix products, a block of PHRASES after the other, so that what
    is broadcast is bounded. Null, empty, zero and non-finite vectors, and those of another length, support nothing.
    """
    sound = lambda df: df.where("id IS NOT NULL AND v IS NOT NULL").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    phrases_, reports = sound(phrases_).select("id", "v", F.size("v").alias("dim")), sound(reports).select("id", "v")
    kind, out = reports.schema["id"].dataType.simpleString(), None
    sizes = {r[0]: r[1] for r in phrases_.groupBy("dim").count().collect()}
    for dim, n in sorted(sizes.items()):
        blocks = -(-n // PHRASES)
        for k in range(blocks):
            some = phrases_.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)).select("id", "v").toArrow()
            given = reports.sparkSession.sparkContext.broadcast((some.column("id").to_pylist(), _unit_rows(some.column("v").combine_chunks(), dim)))
            one = reports.where(F.size("v") == dim).mapInArrow(_near(given, dim, least), f"phrase_id {kind}, report_id {kind}, similarity double")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else reports.select(F.col("id").alias("phrase_id"), F.col("id").alias("report_id"), F.lit(0.0).alias("similarity")).limit(0)


def _unit_rows(vectors, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near(given, dim: int, least: float):
    def run(batches):
        ids, wanted = given.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                own = part.column(0)
                found = _unit_rows(part.column(1), dim) @ wanted.T
                row, col = np.nonzero(found >= least)
                mine = own.take(pa.array(row))
                theirs = pa.array(ids, own.type).take(pa.array(col))
                apart = pc.not_equal(mine, theirs)
                yield pa.RecordBatch.from_arrays([theirs.filter(apart), mine.filter(apart), pa.array(found[row, col]).filter(apart)], ["phrase_id", "report_id", "similarity"])

    return run


def summary(audit: DataFrame) -> DataFrame:
    """Counts and the rate of matched instances in percent, 0 if there is none."""
    sums = audit.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"), F.count(F.lit(1)).alias("total_checked"))
    return sums.withColumn("match_rate", F.coalesce(F.try_divide(F.lit(100.0) * F.col("matched"), F.col("total_checked")), F.lit(0.0)))
