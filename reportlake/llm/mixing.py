"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact budget cuts.

Every document gets a hash-random key. Within its source, documents are ordered by that key; the key's range
is cut into equal parts (the leading hex digits), each part's words are summed first, a running sum over the
parts gives every part its offset, and a running sum inside a part gives every document its place. A source's
third of all rows is thus spread over as many tasks as there are parts, and no task holds a source. The budget
of a source buys whole epochs first and then the documents up to the exact cut.

The mix itself is drawn without moving a document: a source's cut is one key, so every row is held against the cut of
its source, a table of a row per source.

DataFrame operations only. The table of sources has a row per source and passes one window of its own.

Defined results: a null text has size 0. Null sources form one source, ordered last; an empty source name is a
source like any other. Sources weigh by their place in code-point order, weights repeating. A source without
words gets target 0. Rows without an id are keyed by their text. Equal keys are ordered by id, then by a hash of the text;
rows repeated whole are interchangeable in plan(), and mixed() takes them alike. The columns of the
input but id, text and source are ignored by plan(), and passed through by mixed(). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import WORD, n_words, stored

#: A target stops at so many times its source's words.
MOST_EPOCHS = 3
#: Hex digits of the key that name a part of its range: 16 ** 3 parts in each source.
PART_DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sizes(source, source_size) with target: shares of all words by weight, none above MOST_EPOCHS times its own.

    Sharing an excess again and again until no target is above its limit fills sources in the order of limit / weight:
    the first k stop at their limits and the others get one level a unit of weight. Running sums in that order give k.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("_i", F.row_number().over(by_name) - 1)
    w = w.withColumn("_w", F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("_i") % len(weights) + 1).cast("long"))
    w = w.withColumn("_limit", F.col("source_size") * MOST_EPOCHS)
    before = Window.orderBy(F.col("_limit") / F.col("_w"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    heavy = F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    w = w.withColumn("_level", left / heavy)
    w = w.withColumn("_stops", F.col("_limit") <= F.col("_level") * F.col("_w"))
    level = F.min(F.when(~F.col("_stops"), F.struct(F.col("_limit") / F.col("_w"), F.col("_i"), F.col("_level")))).over(everyone)["_level"]
    target = F.when(F.col("_stops"), F.col("_limit").cast("double")).otherwise(F.col("_w") * level)
    return w.select("source", "source_size", target.alias("target"))


def _key(seed: str, id_col: str, text_col: str) -> Column:
    known = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))))
    return F.md5(F.concat_ws(":", F.lit(seed), known))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", cut: str = "words", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole copies), part (words of one more), taken.

    cut "words": the document at the cut gives just the words that are left, so a source's words meet its rounded
    target. cut "documents": it is taken whole if at least half of its words are left, so the source ends within
    half a document of its target.
    """
    return _planned(docs, weights, seed, cut, id_col, text_col, source_col).drop("_key", "_h")


def _planned(docs: DataFrame, weights: tuple[int, ...], seed: str, cut: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """plan() with the order of rows in their source: _key, doc_id, _h."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _key(seed, id_col, text_col).alias("_key"), _text_hash(text_col).alias("_h"))
    rows = stored(rows.withColumn("_part", F.substring("_key", 1, PART_DIGITS)), "sizes")
    parts = rows.groupBy("source", "_part").agg(F.sum("size").alias("_words"))
    parts = stored(parts, "parts")
    goals = targets(parts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights)
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    parts = parts.alias("p").join(goals.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.source", "_part", "_offset", "source_size", "target")
    inside = Window.partitionBy("source", "_part").orderBy("_key", "doc_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = rows.alias("r").join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r._part") == F.col("p._part")))
    both = both.select("r.doc_id", "r.source", "r.size", "source_size", "target", (F.col("_before") + F.col("_offset")).alias("_before"), "r._key", "r._h")
    budget = F.floor(F.col("target") + 0.5)
    both = both.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("_before")
    piece = F.greatest(F.lit(0), F.least(F.col("size"), rest)) if cut == "words" else F.when((rest > 0) & (rest * 2 >= F.col("size")), F.col("size")).otherwise(0)
    both = both.withColumn("part", piece.cast("long"))
    return both.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).drop("_before")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' columns, whole documents, each repeated as often as the mix takes it. Documents
    without words cost nothing and stay once.

    The documents that a source takes once more than its whole epochs are those up to one key in the source's order, so
    documents are only held against their source's cut.
    """
    drawn = _planned(docs, weights, seed, "documents", id_col, text_col, source_col)
    # rows of one key have one id, or none and one text
    cuts = drawn.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("part") > 0, F.struct("_key", "_h"))).alias("cut"))
    # a row per source: broadcast while that is small, which the planner checks by the table's size
    cuts = stored(cuts.select(F.col("source").alias("_cut_source"), F.col("epochs").alias("_cut_epochs"), F.col("cut").alias("_cut")), "cuts")
    mine = F.struct(_key(seed, id_col, text_col).alias("_key"), _text_hash(text_col).alias("_h"))
    worded = F.coalesce(F.rlike(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(False))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col(f"`{source_col}`").alias("_source"), mine.alias("_mine"), worded.alias("_worded"))
    copies = F.when(F.col("_worded"), F.col("_cut_epochs") + F.coalesce(F.col("_mine") <= F.col("_cut"), F.lit(False)).cast("int")).otherwise(1)
    taken = rows.join(cuts, F.col("_source").eqNullSafe(F.col("_cut_source"))).withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")
