"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text is reduced once to STATISTICS, by numpy over the bytes of a block of documents: shares of
classes of bytes, repetition of words, of word sequences and of lines, and sizes. Nothing else enters a score. The
trees are fitted on the driver to a bounded sample of labelled rows (TRAINING rows at most, about, drawn by a hash of the
id), flattened into node arrays, and scored by walking all trees at once for a batch of rows.

Defined results: null and empty texts have statistics of zero and get a score like any other. Rows that repeat are
scored alike. A document with several labels counts once for each; a null label counts for nothing. With no labels, or
one kind only, the score is their rate (0.5 without any). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm import trees
from reportlake.llm.common import PIECE, blocks, mix64, row_word_hashes, stored, utf8

#: Labelled rows that the trees see at most, about.
TRAINING = 20_000

#: Classes of bytes whose shares of a text are statistics; a byte is in one class.
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "quote", "bang", "bar", "symbol", "bracket", "slash", "other", "control")
STATISTICS = (*CLASSES, "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "distinct_pairs", "distinct_fives", "log_lines", "line_bytes", "distinct_lines", "upper_letters", "spread")


def _class_of() -> np.ndarray:
    of = np.full(256, CLASSES.index("other"), np.int64)
    of[:32] = of[127] = CLASSES.index("control")
    for name, bytes_ in (("symbol", b"#$%&*+=@^_~`"), ("stop", b".,;:?-"), ("quote", b"'\""), ("bang", b"!"), ("bar", b"|"), ("bracket", b"<>[](){}"), ("slash", b"/\\"), ("blank", b" \t"), ("newline", b"\n\r")):
        of[list(bytes_)] = CLASSES.index(name)
    of[97:123], of[65:91], of[48:58] = CLASSES.index("lower"), CLASSES.index("upper"), CLASSES.index("digit")
    return of


_CLASS = _class_of()


def _runs(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often the commonest occurs."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    owner = (key[heads] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, np.diff(np.append(heads, len(key))))
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text of a string column."""
    data, bounds = utf8(column)
    n = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    counts = np.zeros((n, len(CLASSES)))
    lines, own_lines = np.zeros(n), np.zeros(n)
    for i, j in blocks(bounds, PIECE):
        rows = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
        for a in range(0, len(rows), 8 * PIECE):
            part = data[bounds[i] + a : min(bounds[i] + a + 8 * PIECE, bounds[j])]
            counts[i:j] += np.bincount(rows[a : a + len(part)] * len(CLASSES) + _CLASS[part], minlength=(j - i) * len(CLASSES)).reshape(j - i, -1)
    for r in range(n):
        if size[r]:
            found = [x for x in data[bounds[r] : bounds[r + 1]].tobytes().split(b"\n") if x.strip()]
            lines[r], own_lines[r] = len(found), len(set(found))
    words, distinct, top, pairs, fives = (np.zeros(n) for _ in range(5))
    n_pairs, n_fives = np.zeros(n), np.zeros(n)
    with np.errstate(over="ignore"):
        for i, j, hashes, first in row_word_hashes(column):
            k = j - i
            own = np.diff(first)
            row = np.repeat(np.arange(k), own)
            words[i:j] = own
            distinct[i:j], top[i:j] = _runs(row, hashes, k)
            for width, into, total in ((2, pairs, n_pairs), (5, fives, n_fives)):
                m = max(len(hashes) - width + 1, 0)
                key = np.zeros(m, np.uint64)
                for x in range(width):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[x : m + x]
                inside = row[:m] == row[width - 1 :] if m else np.zeros(0, bool)
                into[i:j] = _runs(row[:m][inside], mix64(key[inside]), k)[0]
                total[i:j] = np.maximum(own - width + 1, 0)
    share = lambda x, y: x / np.maximum(y, 1)
    solid = size - counts[:, CLASSES.index("blank")] - counts[:, CLASSES.index("newline")]
    upper, lower = counts[:, CLASSES.index("upper")], counts[:, CLASSES.index("lower")]
    found = [share(counts, size[:, None]), *(x[:, None] for x in (np.log1p(size), np.log1p(words), share(solid, words), share(distinct, words), share(top, words), share(pairs, n_pairs), share(fives, n_fives), np.log1p(lines), share(size, lines), share(own_lines, lines), share(upper, upper + lower), share(distinct, np.sqrt(words))))]
    return np.concatenate(found, 1).astype(np.float32)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `statistics` array<float> of every whole text."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                x = statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["doc_id", "statistics"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, statistics array<float>")


def learned(facts: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = TRAINING) -> trees.Forest:
    """Trees for labels(doc_id, label_col) from facts(doc_id, statistics)."""
    labels = labels.where(F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("y"))
    n = labels.count()
    share = most / max(n, 1)
    drawn = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("training")), F.lit(1 << 30)) < share * (1 << 30))
    rows = facts.join(drawn, "doc_id").select("doc_id", "statistics", "y").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = rows.column("y").to_numpy().astype(float)
    x = np.array(rows.column("statistics").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(y), len(STATISTICS))
    return trees.fitted(x, y)


def scored(facts: DataFrame, forest: trees.Forest) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of facts(doc_id, statistics)."""
    sent = facts.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(x))], ["doc_id", "score"])

    return facts.select("doc_id", "statistics").mapInArrow(run, f"doc_id {facts.schema['doc_id'].dataType.simpleString()}, score double")


def rated(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """doc_id and score of every document, by trees fitted to labels(doc_id, label_col)."""
    facts = stored(described(docs), "statistics")
    return scored(facts, learned(facts, labels, label_col))
