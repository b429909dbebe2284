"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes it when their cosine reaches a level. Directions come from product codes:
after a random rotation the space is cut into two halves, each with its own random code words, and every pair of code
words is a direction. Since a direction's cosine is the sum of two halves' products, all directions that a vector
exceeds are listed without trying every pair. Vectors that share a filter are candidates, and every link is
verified by its cosine in double precision.

The number of directions grows with the number of vectors, so a cap keeps about CAP_SIZE vectors of data without
clusters. The level is set so that a pair at the least cosine misses all common filters with a chance of about MISS,
measured on random pairs; it depends on the dimension and the number of directions alone.

Vectors with the same components are one node with a weight. A cap holds a cluster of any size: caps of more than two blocks are
cut into blocks of fixed size, whatever the data, and each pair of blocks is a unit of work of its own. Links are counted at the least filter
that both ends pass, and only counts and spanning edges leave a unit, never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors
of different dimensions don't link. Rows that share an id are one node with the id's links; each such row counts as a vector.
A null id links with nothing. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import least_reachable, sorted_runs, stored
from reportlake.llm.components import components

#: Vectors without clusters in a cap, about; codes, each with a rotation of its own, which even out how many filters a
#: vector passes; chance that a pair at the limit is missed.
CAP_SIZE, CODES, MISS = 64, 16, 0.002
#: Vectors in a block of a large cap, about (a hash deals them): a unit of work has two blocks at most.
BLOCK = 1024
#: Large caps up to which their table, of 12 bytes a row, is broadcast; beyond, rows are shuffled to it.
LARGE = 500_000


class Codes:
    """Product codes for one dimension: rotations, code words of both halves, and the level."""

    def __init__(self, dim: int, n: int, cosine: float, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.half = dim, max(1, (dim + 1) // 2)
        pairs = self._pairs(rng, 1500, cosine)
        # in few dimensions the neighbourhood of a vector holds more vectors than a cap should: fewer directions, larger caps
        for fewer in (1, 4, 16, 64, 256, 1024):
            for due in (12, 16, 20, 24, 30, 36, 44, 54, 66, 80, 100, 130):
                self.words = int(min(4096, max(4, np.ceil(np.sqrt(n * due / (CODES * CAP_SIZE)) / fewer))))
                missed = self._missed(rng, pairs, due)
                if missed <= MISS:
                    return
            if self.words == 4:
                break
        raise ValueError(f"pairs at cosine {cosine} in {dim} dimensions are missed with a chance of {missed:.4f}, more than {MISS}")

    def _missed(self, rng, pairs: tuple[np.ndarray, np.ndarray], due: int) -> float:
        """Draws codes at which a vector exceeds `due` directions; the share of pairs that have no common filter."""
        self.rotations = [np.linalg.qr(rng.standard_normal((2 * self.half, 2 * self.half)))[0] for _ in range(CODES)]
        self.codes = [[_unit(rng.standard_normal((self.words, self.half))) for _ in range(2)] for _ in range(CODES)]
        self.level = self._level(pairs[0][:300], due)
        own, other = self.filters(pairs[0]), self.filters(pairs[1])
        return float(np.mean([not np.intersect1d(a, b, assume_unique=True).size for a, b in zip(own, other, strict=True)]))

    def _pairs(self, rng, n: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        x = _unit(rng.standard_normal((n, self.dim)))
        if self.dim == 1:
            return x, x
        y = rng.standard_normal((n, self.dim))
        y = _unit(y - (x * y).sum(1, keepdims=True) * x)
        return x, cosine * x + np.sqrt(1 - cosine**2) * y

    def _halves(self, x: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
        wide = np.zeros((len(x), 2 * self.half))
        wide[:, : self.dim] = x
        wide = wide @ self.rotations[code]
        return wide[:, : self.half] @ self.codes[code][0].T, wide[:, self.half :] @ self.codes[code][1].T

    def _level(self, x: np.ndarray, due: int) -> float:
        """The level at which a vector exceeds `due` directions on average."""
        best = []
        for code in range(CODES):
            one, two = self._halves(x, code)
            # the largest products of each half hold the largest sums
            one, two = np.sort(one, 1)[:, ::-1][:, :400], np.sort(two, 1)[:, ::-1][:, :400]
            for a, b in zip(one, two, strict=True):
                sums = (a[:, None] + b[None, :]).ravel()
                best.append(np.partition(sums, -min(len(sums), 8 * due))[-min(len(sums), 8 * due) :])
        best = np.sort(np.concatenate(best))[::-1]
        return float(best[min(len(best) - 1, due * len(x))])

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted filters that each unit vector exceeds."""
        rows, found = [], []
        for a in range(0, len(x), 512):
            for code in range(CODES):
                one, two = self._halves(x[a : a + 512], code)
                r, i = np.nonzero(one >= (self.level - two.max(1))[:, None])
                for b in range(0, len(r), 20_000):
                    k, j = np.nonzero(two[r[b : b + 20_000]] >= (self.level - one[r[b : b + 20_000], i[b : b + 20_000]])[:, None])
                    rows.append(a + r[b + k])
                    found.append((code * self.words + i[b + k].astype(np.int64)) * self.words + j)
        rows, found = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, found))
        order = np.lexsort((found, rows))
        return np.split(found[order], np.searchsorted(rows[order], np.arange(1, len(x))))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _listed(codes: Codes):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                filters = codes.filters(_matrix(part.column(1), codes.dim))
                lens = np.concatenate([[0], np.cumsum([len(f) for f in filters])]).astype(np.int32)
                flat = np.concatenate(filters) if filters else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.ListArray.from_arrays(pa.array(lens), pa.array(flat.astype(np.int32)))], ["id", "v", "weight", "filters"])

    return run


def _unit_of_work(filter_: int, x: np.ndarray, block: np.ndarray, weight: np.ndarray, filters: list[np.ndarray], i: int, j: int, cosine: float):
    """Links of a unit: for each row the weight of partners that are counted here, and the row its spanning edge leads to."""
    n = len(x)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= block[:, None] != block[None, :]
    if not linked.any():
        return None
    root = least_reachable(linked)
    # pairs that share a smaller filter are counted there
    touched = np.flatnonzero(linked.any(1))
    owner = np.repeat(touched, [int(np.searchsorted(filters[r], filter_)) for r in touched])
    small = np.concatenate([filters[r][: np.searchsorted(filters[r], filter_)] for r in touched])
    kinds, at, held = np.unique(small, return_inverse=True, return_counts=True)
    for a in range(0, len(kinds), 2048):
        inside = (at >= a) & (at < a + 2048) & (held[at] > 1)
        if inside.any():
            table = np.zeros((n, min(2048, len(kinds) - a)), np.float32)
            table[owner[inside], at[inside] - a] = 1
            table = table[:, table.any(0)]
            linked &= table @ table.T < 0.5
    return linked @ weight, root


def _worked(dim: int, cosine: float):
    """Rows sorted by (filter, i, j) in, units of work out: id, links, root."""

    def unit(table: pa.Table):
        ids = table.column("id").to_numpy()
        filters = table.column("filters").combine_chunks()
        filters = np.split(filters.flatten().to_numpy(), filters.value_lengths().to_numpy().cumsum()[:-1])
        got = _unit_of_work(table.column("filter")[0].as_py(), _matrix(table.column("v").combine_chunks(), dim), table.column("block").to_numpy(), table.column("weight").to_numpy(), filters, table.column("i")[0].as_py(), table.column("j")[0].as_py(), cosine)
        if got is None:
            return None
        some = np.flatnonzero((got[0] > 0) | (got[1] != np.arange(len(ids))))
        return ids[some], got[0][some], ids[got[1][some]]

    def run(batches):
        out, n = [], 0
        for table in sorted_runs(batches, ["filter", "i", "j"]):
            got = unit(table) if table.num_rows > 1 else None
            if got is not None:
                out.append(got)
                n += len(got[0])
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out])) for c in range(3)], ["id", "links", "root"])
                out, n = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out])) for c in range(3)], ["id", "links", "root"])

    return run


def _dealt(listed: DataFrame) -> DataFrame:
    """Rows of listed(id, v, weight, filters) once for each unit of work that they take part in: filter, blocks i and j, and the row's own block."""
    each = listed.select(F.explode("filters").alias("filter"), "id", "weight", "v", "filters")
    # a cap's size in whole numbers of blocks; its table is small against the rows, and its size is checked
    large = each.groupBy("filter").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 2 * BLOCK).select("filter", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    large = stored(large, "large")
    each = each.join(F.broadcast(large) if large.count() <= LARGE else large, "filter", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    each = each.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select("filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "weight", "v", "filters", "block")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least id reachable), kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    nodes = stored(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "nodes")
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.size("v")).count().collect()}
    counts, edges = None, None
    for dim, n in sorted(sizes.items()):
        codes = Codes(dim, n, cosine)
        kind = nodes.schema["v"].dataType.simpleString()
        listed = stored(nodes.where(F.size("v") == dim).select("id", "v", "weight").mapInArrow(_listed(codes), f"id long, v {kind}, weight long, filters array<int>"), f"filters_{dim}")
        each = _dealt(listed)
        each = each.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j", "id")
        found = stored(each.mapInArrow(_worked(dim, cosine), "id long, links long, root long"), f"links_{dim}")
        part, edge = found.groupBy("id").agg(F.sum("links").alias("links")), found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
        counts, edges = (part, edge) if counts is None else (counts.unionByName(part), edges.unionByName(edge))
    if counts is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    label = components(edges)
    node = nodes.join(counts, "id", "left").join(label, F.col("id") == F.col("node"), "left").select("v", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(node, "v", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
