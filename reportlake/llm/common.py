"""Shared plumbing: intermediate tables in the shared folder, and vectorised text helpers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: list[str] = []
_written: list[tuple[SparkSession, str]] = []
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, read from the session.

    Where it is unset, a local master gets a folder of its own under the system's temporary folder and
    any other master gets one under the warehouse, which a cluster shares.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="reportlake-"))
        atexit.register(shutil.rmtree, _own_dirs[0], ignore_errors=True)
    return f"file://{_own_dirs[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reportlake/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _note(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """As stored(), with the rows in buckets by a column, as many as shuffles have parts: rows of another frame come to them, they
    needn't move. The catalog holds the table under a name of its own until release()."""
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/reportlake/{folder}/{name}", f"reportlake_{name}_{folder}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).option("compression", "zstd").saveAsTable(table)
    _note(spark, path)
    _tables[path.rpartition("/")[0]] = table
    return spark.table(table)


def _note(spark: SparkSession, path: str) -> None:
    if not _written:
        # what callers didn't release goes when the application ends, before its session does
        atexit.unregister(_end)
        atexit.register(_end)
    _written.append((spark, path))


def _end() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        # a session that has stopped, or whose JVM is gone, can delete nothing more
        with contextlib.suppress(Exception):
            release(spark)


def delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the intermediate tables that stored() and bucketed() wrote, but for the first `keep`; their readers must be done."""
    while len(_written) > keep:
        delete(spark, _written.pop()[1].rpartition("/")[0])


def forget(spark: SparkSession, at: int) -> None:
    """Delete the one intermediate table that was written when mark() was `at`."""
    delete(spark, _written.pop(at)[1].rpartition("/")[0])


def mark() -> int:
    """How many intermediate tables exist now, for release(keep=...)."""
    return len(_written)


def crc_mod5(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo 5: 0 marks held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def n_words(text) -> "F.Column":
    """Number of words in a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- vectorised text helpers, for Arrow workers ----

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, end to end, and the n + 1 bounds of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(bounds):
        bounds = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, most: int):
    """Ranges (i, j) of rows of at most `most` bytes together, or one longer row alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_values = np.random.default_rng(20240901).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_values[_space] = 0
_base = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 4096), _base, np.uint64))])
    return _powers


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows in data, A-Z lower-cased, and the n + 1 bounds of the rows among them.

    A row's words never run into the next row's. The whole of data is held in arrays of 8 bytes a byte, so
    callers pass it in pieces; see row_word_hashes.
    """
    with np.errstate(over="ignore"):
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        solid = ~_space[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[heads] = solid[heads]
        at = np.flatnonzero(begins)
        first = np.searchsorted(at, bounds, "left")
        if not len(at):
            return np.zeros(0, np.uint64), first
        sizes = np.diff(np.append(at, len(data)))
        place = np.arange(at[0], len(data)) - np.repeat(at, sizes)
        part = _values[_lower[data[at[0] :]]] * _power(int(sizes.max()) + 1)[place]
        sums = np.add.reduceat(part, at - at[0])
        letters = np.add.reduceat(solid[at[0] :].astype(np.int64), at - at[0]).astype(np.uint64)
        return mix64(sums + letters * np.uint64(0xD6E8FEB86659FD93)), first


PIECE = 1 << 20


def row_word_hashes(column: pa.Array):
    """Yield (first row, last row + 1, word hashes, bounds) over a string column in blocks of about PIECE bytes.

    A row longer than that is hashed in pieces cut at white space, so memory follows its number of words.
    """
    data, bounds = utf8(column)
    for i, j in blocks(bounds, PIECE):
        part, own = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        if len(part) <= 2 * PIECE or j > i + 1:
            yield i, j, *word_hashes(part, own)
            continue
        found, a = [], 0
        while a < len(part):
            b = min(a + PIECE, len(part))
            while b < len(part) and not _space[part[b]]:
                gap = np.flatnonzero(_space[part[b : b + PIECE]])
                b = b + int(gap[0]) if len(gap) else min(b + PIECE, len(part))
            found.append(word_hashes(part[a:b], np.array([0, b - a]))[0])
            a = b
        hashes = np.concatenate(found)
        yield i, j, hashes, np.array([0, len(hashes)])


#: log2 of the bits of a map at the most: 8 MB. Bits for each value while there are fewer. Values that a map may list, at the most: 4 MB.
LARGEST_MAP, BITS_A_VALUE, LISTED = 26, 64, 1 << 19


class BitMap:
    """Which values are wanted, as bits under a hash: a value that is wanted is always on, others seldom, and never where the map lists its
    values too. It travels as a broadcast."""

    def __init__(self, size: int, bits: bytes, listed: np.ndarray | None = None):
        self.size, self.bits, self.listed = size, bits, listed

    def holds(self, values: np.ndarray) -> np.ndarray:
        cell = _cells(values, self.size)
        on = (np.frombuffer(self.bits, np.uint8)[cell >> 3] >> (cell & 7) & 1).astype(bool)
        if self.listed is not None and len(self.listed):
            some = np.flatnonzero(on)
            wanted = np.asarray(values).view(np.int64)[some]
            at = np.minimum(np.searchsorted(self.listed, wanted), len(self.listed) - 1)
            on[some] = self.listed[at] == wanted
        return on


def _cells(values: np.ndarray, size: int) -> np.ndarray:
    return (mix64(np.array(values).view(np.uint64)) >> np.uint64(64 - size)).astype(np.int64)


def _bits(values: np.ndarray, size: int) -> np.ndarray:
    on = np.zeros(1 << size, np.uint8)
    on[_cells(values, size)] = 1
    return np.packbits(on, bitorder="little")


def bit_map(values: DataFrame, n: int, listed: bool = False) -> BitMap:
    """The map of a column of n distinct longs. listed: up to LISTED values go along, so that the map is exact.

    Otherwise each task folds its values into words of 64 bits, so no more words than the map has reach the driver.
    """
    size = min(max(16, int(np.ceil(np.log2(max(n, 1) * BITS_A_VALUE)))), LARGEST_MAP)
    if listed and n <= LISTED:
        found = np.sort(values.distinct().toArrow().column(0).to_numpy())
        return BitMap(size, _bits(found, size).tobytes(), found)

    def run(batches):
        words = np.zeros(1 << (size - 6), np.int64)
        for batch in batches:
            words |= _bits(batch.column(0).to_numpy(zero_copy_only=False), size).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at])], ["at", "bits"])

    found = values.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return BitMap(size, out.tobytes())


def sorted_runs(batches, keys: list[str]):
    """Tables of the rows that agree on keys, for record batches sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        heads = np.flatnonzero(np.append(last is None or tuple(key[:, 0]) != last, (key[:, 1:] != key[:, :-1]).any(0)))
        last = tuple(key[:, -1])
        at = 0
        for h in heads:
            if h > at:
                held.append(batch.slice(at, h - at))
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held, at = [], int(h)
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def least_reachable(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the least row that each row reaches."""
    n = len(linked)
    root = np.arange(n)
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], n).min(1))
        least = least[least]
        if (least == root).all():
            return root
        root = least
