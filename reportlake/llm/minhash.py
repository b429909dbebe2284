"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct shingles of k words. Circulant MinHash takes two permutations: the first,
a 64-bit mixing of the shingle's hash, spreads the set over a circle of D slots; the second is one permutation
pi of the slots, and coordinate j of the signature is the least of pi over the slots after a circular shift by
j. Since the shifts of a slot are neighbours in pi, all coordinates of a shingle are one contiguous read.

Signatures are cut into bands; documents that agree on a band are candidates. Every link is confirmed on the full
sets of shingle hashes. No bucket is expanded into all its pairs: each member first meets the head of its bucket,
the most central one; the buckets of one head are one group. Members that aren't linked to their head then meet the
others of their group, in units of two blocks, where one matrix product gives the sizes
of all intersections and only spanning edges leave. Pairs that are skipped are in one component already, so
components lose no link. Documents with the same set are one node from the start, found by a 128-bit hash of the set.

What the bands miss: at a similarity of 0.8 a pair shares none of BANDS bands of ROWS coordinates with a chance
of (1 - 0.8 ** ROWS) ** BANDS = 3e-5.

Defined results: null and empty texts, and texts of white space, have the empty set and link with nothing; with
fewer than k words the whole sequence is the one shingle. Very long texts keep their full sets. Rows that share
an id are one node. A null id gets the component of its copies, and is never kept. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import LARGEST_MAP, bit_map, least_reachable, mix64, row_word_hashes, sorted_runs, stored
from reportlake.llm.components import components

BANDS, ROWS = 26, 5
COORDINATES = BANDS * ROWS
#: log2 of the number of slots on the circle.
CIRCLE = 20
#: Members and shingles in a block, about; a unit of work has two blocks at most.
BLOCK, WEIGHT = 512, 150_000
#: Documents whose sets are wanted, up to which a map of bits picks them out of the corpus; more are joined by id.
WANTED = 1 << (LARGEST_MAP - 2)


@lru_cache(1)
def _windows() -> np.ndarray:
    """Row s: the second permutation at slot s after each circular shift. A view; the memory is one permutation."""
    pi = np.random.default_rng(77).permutation(1 << CIRCLE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: COORDINATES - 1]]), COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates for a non-empty set of shingle hashes."""
    windows = _windows()
    slots = (shingles >> np.uint64(64 - CIRCLE)).astype(np.int64)
    least = windows[slots[:8192]].min(axis=0)
    for a in range(8192, len(slots), 8192):
        np.minimum(least, windows[slots[a : a + 8192]].min(axis=0), out=least)
    return least


@lru_cache(4)
def _places(k: int) -> np.ndarray:
    return np.random.default_rng(k).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int):
    """Yield the sorted distinct shingle hashes of each row of a string column."""
    place = _places(k)
    for i, j, words, bounds in row_word_hashes(column):
        with np.errstate(over="ignore"):
            n = max(len(words) - k + 1, 0)
            all_ = np.zeros(n, np.uint64)
            for x in range(k):
                all_ += words[x : n + x] * place[x]
            all_ = mix64(all_)
            for r in range(j - i):
                a, b = int(bounds[r]), int(bounds[r + 1])
                if b - a >= k:
                    yield np.unique(all_[a : b - k + 1])
                elif b > a:
                    yield mix64((words[a:b] * place[: b - a]).sum(keepdims=True) + np.uint64(b - a))
                else:
                    yield all_[:0]


def banded(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature, told apart by the band's number."""
    with np.errstate(over="ignore"):
        rows = signatures.astype(np.uint64).reshape(-1, BANDS, ROWS)
        return mix64((rows * _places(ROWS)).sum(2) + mix64(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def _signed(k: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sizes, prints, signs, lens = [], [], [], [0]
                for s in shingle_sets(part.column(1), k):
                    sizes.append(len(s))
                    prints.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        signs.append(signature(s))
                    lens.append(lens[-1] + BANDS * bool(len(s)))
                bands = pa.array(banded(np.stack(signs)).ravel() if signs else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(lens, pa.int32()), bands)], ["id", "n", "print", "bands"])

    return run


def _wanted_sets(bits, k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            some = ~ids.is_null().to_numpy(zero_copy_only=False)
            if bits is not None:
                some &= bits.value.holds(known)
            part = batch.take(pa.array(np.flatnonzero(some)))
            for a in range(0, part.num_rows, 200):
                some = part.slice(a, 200)
                sets = list(shingle_sets(some.column(1), k))
                lens = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "shingles"])

    return run


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and shingles of the documents with these ids, and of a few others.

    While the ids fit a map of bits, texts aren't moved; beyond, a map would let everything pass, and a join by id picks them.
    """
    ids = ids.distinct()
    n = ids.count()
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(ids, n)) if n <= WANTED else None
    docs = docs if n <= WANTED else docs.join(ids.hint("shuffle_merge"), "id", "left_semi").select("id", "text")
    return stored(docs.mapInArrow(_wanted_sets(bits, k), "id long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), those whose sets share at least percent of their union."""
    size = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"))
    likely = pairs.join(size("a"), "a").join(size("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    whole = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"t{x}"))
    both = likely.join(whole("b"), "b").join(whole("a"), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _shared(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of sets[:split] with sets[split:], or of all with all if split is 0."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(holders > 1) - 1
    owner, column = owner[holders[column] > 1], place[column[holders[column] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((split or len(sets), len(sets) - split), np.float64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, [a, a + 2048])
        table = np.zeros((len(sets), 2048), np.float32)
        table[owner[lo:hi], column[lo:hi] - a] = 1
        out += table[: split or None] @ table[split:].T
    return out


def _met(percent: int):
    """Rows sorted by (head, kind, i, j) in; links between members that are still apart out, as spanning edges.

    A unit of kind 0 holds two blocks of strays, one of kind 1 a block of strays and one of settled members.
    """

    def edges(table: pa.Table):
        table = table.sort_by([("settled", "ascending"), ("id", "ascending")])
        ids, settled = table.column("id").to_numpy(), table.column("settled").to_numpy()
        lists = table.column("shingles").combine_chunks()
        sets = np.split(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().cumsum()[:-1])
        split = int((settled == 0).sum()) if table.column("kind")[0].as_py() else 0
        if split == len(ids):
            return ids[:0], ids[:0]
        size = np.array([len(s) for s in sets], np.float64)
        shared = _shared(sets, split)
        linked = 100 * shared >= percent * (size[: split or None, None] + size[None, split:] - shared)
        if split:
            row = np.flatnonzero(linked.any(1))
            return ids[row], ids[split + linked[row].argmax(1)]
        np.fill_diagonal(linked, False)
        root = least_reachable(linked)
        row = np.flatnonzero(root != np.arange(len(ids)))
        return ids[row], ids[root[row]]

    def run(batches):
        for table in sorted_runs(batches, ["head", "kind", "i", "j"]):
            if table.num_rows > 1:
                a, b = edges(table)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _apart(met: DataFrame, links: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that are left between members of a head's group.

    Settled members are linked to the head, strays aren't. Strays meet strays and settled members in units of two
    blocks; settled members needn't meet each other, and a group without strays is done.
    """
    linked = links.select(F.col("a").alias("head"), F.col("b").alias("id"), F.lit(1).alias("linked"))
    rows = met.join(linked, ["head", "id"], "left").join(reps.select(F.col("rep").alias("id"), "n"), "id")
    rows = rows.select("head", "id", "n", F.when(F.col("head") == F.col("id"), 1).otherwise(F.coalesce("linked", F.lit(0))).alias("settled"))
    blocks = lambda who: F.ceil(F.greatest(F.sum(who) / BLOCK, F.sum(who * F.col("n")) / WEIGHT)).cast("int")
    stray = 1 - F.col("settled")
    parts = rows.groupBy("head").agg(F.sum(stray).alias("strays"), F.sum("settled").alias("rest"), blocks(stray).alias("gs"), blocks(F.col("settled")).alias("gt"))
    parts = parts.where("strays > 1 OR strays = 1 AND rest > 1").select("head", "gs", "gt")
    # as a table of its own, so that the rows of a head with a large group can be split in the join
    rows = rows.join(stored(parts, "parts"), "head")
    own = F.when(F.col("settled") == 0, F.col("gs")).otherwise(F.col("gt"))
    rows = rows.withColumn("o", F.pmod(F.xxhash64("id"), own).cast("int"))
    unit = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    strays = F.concat(F.transform(upto("gs"), lambda x: unit(0, F.least("o", x), F.greatest("o", x))), F.transform(upto("gt"), lambda x: unit(1, F.col("o"), x)))
    rest = F.transform(upto("gs"), lambda x: unit(1, x, F.col("o")))
    rows = rows.withColumn("u", F.explode(F.when(F.col("settled") == 0, strays).otherwise(rest))).select("head", "u.kind", "u.i", "u.j", "id", "settled")
    rows = rows.join(sets, "id").select("head", "kind", "i", "j", "id", "settled", "shingles")
    return rows.repartition("head", "kind", "i", "j").sortWithinPartitions("head", "kind", "i", "j").mapInArrow(_met(percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable), kept. Links: similarity of at least percent / 100."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(docs.mapInArrow(_signed(k), "id long, n long, print binary, bands array<long>"), "signatures")
    first = signed.where("print IS NOT NULL AND id IS NOT NULL").groupBy("print").agg(F.min(F.struct("id", "n", "bands")).alias("r"))
    reps = stored(first.select("print", F.col("r.id").alias("rep"), "r.n", "r.bands"), "sets_of_copies")

    buckets = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    crowds = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(buckets.join(crowds, "bucket"), "members")
    # the head of a bucket is its most central member: the one that meets most others over all its buckets
    central = members.groupBy("id").agg(F.sum("size").alias("met"))
    heads = members.join(central, "id").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("id")).alias("less"))).alias("m")).select("bucket", (-F.col("m.less")).alias("head"))
    # all that share a bucket are in the group of its head
    met = stored(members.select("bucket", "id").join(heads, "bucket").select("head", "id").distinct(), "met")
    sets = _sets(docs, met.select("id"), k)
    links = stored(_confirmed(met.where("head <> id").select(F.col("head").alias("a"), F.col("id").alias("b")), reps, sets, percent), "links")
    label = components(links.unionByName(_apart(met, links, reps, sets, percent)))

    home = reps.select("print", "rep").join(label, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("id", "n", "print").join(home, "print", "left")
    found = F.when(F.col("print").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(False)).alias("kept"))
