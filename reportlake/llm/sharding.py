"""Sharding by sampled splitters, with near-equal bytes.

Records are ordered by (hash of the text, id), so equal texts lie side by side. A size-weighted sample of these
keys gives the quantile boundaries of many small ranges; a boundary moves to the start of its text's group unless the
group itself is larger than a range. Exact sizes of the ranges are summed; a range that came out overfull is subdivided by
boundaries from a denser sample of that range alone. The ranges of a large group go to one shard together; groups larger than a
shard are split, and, where whole groups would leave shards uneven, the largest group of the fullest shard is too, one after
the other. Large groups take the emptiest shards, neighbouring ranges fill what is left, and overfull shards hand ranges to
underfull ones until no move helps.

Only the sample and the sizes of the ranges reach the driver; a range holds about ROWS rows at the most, so both grow with a
millionth of the rows. The tasks of the sums and of the numbering hold one range each, so a group of copies of any size is
spread like other rows.

Defined results: a null text has no bytes, crc32 0 and size 1. A null id orders first. Rows repeated whole are
neighbours and interchangeable. Other columns are ignored. Shards may be empty when there are fewer ranges than shards;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import stored

#: Ranges for each shard at least, sampled keys for each range, and rows of a range, about, at the most.
RANGES, SAMPLES, ROWS = 64, 12, 1_000_000
#: A range of over this many times its due size is subdivided, at most so many times.
OVERFULL, ROUNDS = 2.0, 4
#: Shards may differ from their due size by this part before a group of equal texts that would fit in a shard is split.
UNEVEN = 0.02
LOWEST = -(2**63)


def _finder(hashes: np.ndarray, ids: np.ndarray):
    """Number of splitters at or below a key, for splitters sorted by (hash, id)."""

    def find(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        out = lo.copy()
        for v in np.unique(lo[lo < hi]):
            here = (lo == v) & (hi > v)
            out[here] = v + np.searchsorted(ids[v : hi[here][0]], d[here], "right")
        return out

    return find


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    hashes, ids = np.array([s[0] for s in splitters], np.int64), np.array([s[1] for s in splitters], np.int64)

    @F.pandas_udf("int")
    def range_of(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(_finder(hashes, ids)(h.to_numpy(), d.to_numpy()).astype(np.int32))

    return range_of("_hash", "_id")


def _quantiles(sample: list[tuple[int, int, float]], n: int) -> list[tuple[int, int]]:
    """n - 1 keys that part the sample into equal weights."""
    if not sample or n < 2:
        return []
    sample = sorted(sample)
    sums = np.cumsum([s[2] for s in sample])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, n) / n, "left")
    return sorted({sample[min(int(i), len(sample) - 1)][:2] for i in at})


def _snapped(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A hash with one cut has a group smaller than a range: the cut goes to its start. The group of a hash with
    more is parted where the cuts are, and set apart from its neighbours."""
    seen: dict[int, int] = {}
    for h, _ in cuts:
        seen[h] = seen.get(h, 0) + 1
    out = {(h, LOWEST) for h in seen} | {(h, d) for h, d in cuts if seen[h] > 1} | {(h + 1, LOWEST) for h in seen if seen[h] > 1 and h < 2**63 - 1}
    return sorted(out)


def _sample(rows: DataFrame, most: int, total: int) -> list[tuple[int, int, float]]:
    """About `most` keys, each drawn with a chance in proportion to its size by a hash of the key; larger rows weigh more than one draw."""
    chance = F.col("size") * F.lit(most / max(total, 1))
    draw = F.pmod(F.xxhash64("_hash", "_id", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    return [tuple(r) for r in rows.where(draw < chance).select("_hash", "_id", F.greatest(chance, F.lit(1.0))).collect()]


def _units(ranges: list[int], splitters: list[tuple[int, int]], split: set[int]) -> list[list[int]]:
    """Ranges that go to a shard together: the parts of a group of equal texts, unless its hash is in `split`."""
    parted = {h for h, d in splitters if d != LOWEST} - split
    out: list[list[int]] = []
    last = None
    for r in ranges:
        h = splitters[r - 1][0] if r else None
        if h in parted and h == last:
            out[-1].append(r)
        else:
            out.append([r])
        last = h
    return out


def _deal(units: list[list[int]], sizes: dict[int, int], shards: int) -> tuple[list[int], list[int]]:
    """Shard of each unit and load of each shard: large units to the emptiest shard, then neighbours together into the room that is
    left, then the moves that even out the shards."""
    size = [sum(sizes[r] for r in u) for u in units]
    due = sum(size) / shards
    home, load = [0] * len(units), [0] * shards
    large = [u for u in range(len(units)) if size[u] > due / 8]
    for u in sorted(large, key=lambda u: (-size[u], u)):
        home[u] = min(range(shards), key=load.__getitem__)
        load[home[u]] += size[u]
    at = 0
    for u in sorted(set(range(len(units))).difference(large)):
        while at < shards - 1 and load[at] + size[u] / 2 > due:
            at += 1
        home[u] = at
        load[at] += size[u]
    by_shard: list[set[int]] = [{u for u in range(len(units)) if home[u] == k} for k in range(shards)]
    for _ in range(8 * len(units)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fits = [u for u in by_shard[high] if 0 < size[u] < gap]
        if not fits:
            break
        u = min(fits, key=lambda u: (abs(gap - 2 * size[u]), u))
        home[u] = low
        by_shard[high].discard(u)
        by_shard[low].add(u)
        load[high] -= size[u]
        load[low] += size[u]
    return home, load


def _homes(ranges: list[int], splitters: list[tuple[int, int]], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Shard of each range. Groups of equal texts are whole but for those larger than a shard and those that keep shards uneven."""
    due, split = sum(sizes.values()) / shards, set()
    while True:
        units = _units(ranges, splitters, split)
        home, load = _deal(units, sizes, shards)
        whole = {u: sum(sizes[r] for r in units[u]) for u in range(len(units)) if len(units[u]) > 1}
        over = [u for u in whole if whole[u] > due]
        if not over and max(load) > (1 + UNEVEN) * due:
            fullest = [u for u in whole if home[u] == load.index(max(load))] or list(whole)
            over = [max(fullest, key=whole.__getitem__)] if fullest else []
        if not over:
            return {r: h for u, h in zip(units, home, strict=True) for r in u}
        split |= {splitters[units[u][0] - 1][0] for u in over}


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null under this law)."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_hash"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_id"))
    rows = stored(rows, "keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    n = min(max(shards * ranges, -(-count // ROWS)), max(count, 1))
    # where rows are few, every key is drawn and so each row can be its own range
    splitters = _snapped(_quantiles(_sample(rows, n * samples, total), n))
    due = total / n
    for left in range(ROUNDS, -1, -1):
        placed = rows.withColumn("_range", _range_of(splitters) if splitters else F.lit(0))
        # the moves below must know the very numbers that rows get
        found = {r[0]: (r[1], r[2]) for r in placed.groupBy("_range").agg(F.sum("size"), F.count(F.lit(1))).collect()}
        over = [r for r, (s, k) in found.items() if s > OVERFULL * due and k > 1]
        if not over or not left:
            break
        extra = _sample(placed.where(F.col("_range").isin(over)), sum(int(found[r][0] / due + 1) for r in over) * samples, sum(found[r][0] for r in over))
        find = _finder(np.array([s[0] for s in splitters], np.int64), np.array([s[1] for s in splitters], np.int64))
        of = find(np.array([x[0] for x in extra], np.int64), np.array([x[1] for x in extra], np.int64)) if extra else []
        new = set(splitters)
        for r in over:
            new |= set(_snapped(_quantiles([x for x, k in zip(extra, of, strict=True) if k == r], int(found[r][0] / due) + 1)))
        if len(new) == len(splitters):
            break
        splitters = sorted(new)
    sizes = {r: s for r, (s, _) in found.items()}
    home = _homes(sorted(found), splitters, sizes, shards) if found else {}
    start, filled = {}, [0] * shards
    for r in sorted(found):
        start[r] = filled[home[r]]
        filled[home[r]] += found[r][1]
    if not found:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    spots = rows.sparkSession.createDataFrame([(r, home[r], start[r]) for r in sorted(found)], "_range int, shard int, _start long")
    inside = Window.partitionBy("_range").orderBy("_hash", "_id")
    numbered = placed.withColumn("_place", F.row_number().over(inside)).join(F.broadcast(spots), "_range")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
