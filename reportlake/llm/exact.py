"""Exact deduplication by a 128-bit content hash with byte comparison inside its groups.

One aggregation keyed by (hash, text) does both steps: the hash decides where rows meet, and the equality of
the text, which compares bytes, keeps colliding texts apart. Spark combines on the map side, so a task sends
each of its distinct texts once however often it occurs, and no task ever holds a group of copies. Rows then
find their group by hash alone; only under a hash that several texts share does the text itself take part.

Defined results: a null text counts as empty, and all empty texts are one group. Rows with the same text and
the same id are one stable id: each of them is marked kept. A null id is never preferred to another; in a
group of null ids only, keep_id is null and no row is marked kept. Other columns, whatever their names, pass
through copies_dropped() untouched and are ignored by marked(). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import stored


def marked(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256. keep: which id of a group stays, min or max."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.unhex(F.md5(text.cast("binary"))).alias("_h"))
    best = {"min": F.min, "max": F.max}[keep]
    groups = rows.groupBy("_h", "_text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    facts = ["keep_id", "group_size", "text_sha256"]
    groups = groups.withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256))
    by_hash = stored(groups.select("_h", *facts).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), *(F.min(c).alias(c) for c in facts)), "groups")
    # a hash with one text: rows join on its 16 bytes; a group of any size is split by the skew join
    out = rows.select("doc_id", "_h").join(by_hash.where("_n = 1").drop("_n"), "_h").select("doc_id", *facts)
    crowded = by_hash.where("_n > 1").select("_h")
    if not crowded.isEmpty():
        # a hash that several texts share: their bytes decide
        out = out.unionByName(rows.join(crowded, "_h", "left_semi").join(groups, ["_h", "_text"]).select("doc_id", *facts))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def copies_dropped(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are: of each group of equal texts the row with the best id.

    Where rows with one text share that id too, they are repeats of one document and one of them stays.
    """
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    rank = F.col(f"row.`{id_col}`")
    rank = F.struct(rank.isNull().alias("none"), rank.alias("id")) if keep == "min" else F.struct(rank.isNotNull().alias("some"), rank.alias("id"))
    pick = {"min": F.min_by, "max": F.max_by}[keep]
    best = inner.groupBy(F.unhex(F.md5(text.cast("binary"))).alias("_h"), text.alias("_text")).agg(pick("row", rank).alias("row"))
    return best.select("row.*")
