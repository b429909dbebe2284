"""Bag-of-words terms: counts, n-grams, vocabulary, and linear attributions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.decisions import confidence
from reportlake.functions.text import terms


def kept_terms(c: Column, stop: list[str]) -> Column:
    """Terms without stop words, which go before n-grams are formed."""
    return F.filter(terms(c), lambda t: ~t.isin(*stop)) if stop else terms(c)


def ngrams(tokens: Column, longest: int) -> Column:
    """All runs of 1 to `longest` tokens, joined by blanks; a short text has fewer."""

    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))

    return F.concat(tokens, *[of(n) for n in range(2, longest + 1)]) if longest > 1 else tokens


def each_term(rows: DataFrame, keep: list[str], terms_: Column) -> DataFrame:
    """keep and `term`, a row for each term. The outer form: from the inner one the planner infers a filter that splits every text once more."""
    return rows.select(*keep, F.explode_outer(terms_).alias("term")).where("term IS NOT NULL")


def term_counts(docs: DataFrame, stop: list[str], longest: int = 1) -> DataFrame:
    """report_id, term, n."""
    tokens = docs.select("report_id", kept_terms(F.col("report"), stop).alias("t"))
    return each_term(tokens, ["report_id"], ngrams(F.col("t"), longest)).groupBy("report_id", "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(docs: DataFrame, stop: list[str], size: int, longest: int = 1) -> DataFrame:
    """The commonest terms of the corpus: term, n, idx (place in the alphabet). Ties go to the first in the alphabet."""
    tokens = docs.select(kept_terms(F.col("report"), stop).alias("t"))
    counts = each_term(tokens, [], ngrams(F.col("t"), longest)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return _commonest(counts, size)


def vocabulary_of(counts: DataFrame, size: int) -> DataFrame:
    """vocabulary() from the counts of each report, so that texts are split once for both."""
    return _commonest(counts.groupBy("term").agg(F.sum("n").alias("n")), size)


def _commonest(counts: DataFrame, size: int) -> DataFrame:
    top = counts.orderBy(F.desc("n"), "term").limit(size)
    return top.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)


#: Tokens that a task works on together; tokens of the corpus to a part of the n-grams, about.
TOKENS, PART = 1 << 20, 500_000


def frequent_ngrams(docs: DataFrame, stop: list[str], longest: int, least: int) -> DataFrame:
    """term, n of every n-gram of 1 to `longest` tokens that occurs `least` times or more in the corpus; exact.

    A frequent n-gram has frequent words only, so words are counted first and those that are frequent are numbered, commonest first. They
    travel as a broadcast. Each task then packs its pairs of numbers, and its runs of up to `longest` numbers (which begin with all
    shorter n-grams), each different one once with its count, sorted and compressed, into a block for each part. Pairs are dealt
    to parts by both their words and runs by their first three, so that a common word or pair isn't one part's work.
    """
    spark = docs.sparkSession
    tokens = docs.select(kept_terms(F.col("report"), stop).alias("t"))
    words = each_term(tokens, [], F.col("t")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if longest == 1:
        return words
    words = words.toArrow()
    words = words.take(pc.sort_indices(words, [("n", "descending"), ("term", "ascending")])).combine_chunks()
    given = spark.sparkContext.broadcast((words.column("term").combine_chunks(), words.column("n").to_numpy()))
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(pc.sum(words.column("n")).as_py() or 0) // PART))

    def single(batches):
        term, n = given.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                own = slice(k * len(term) // parts, (k + 1) * len(term) // parts)
                yield pa.RecordBatch.from_arrays([term[own], pa.array(n[own], pa.int64())], ["term", "n"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            flat = pc.index_in(pc.list_flatten(lists), value_set=given.value[0]).fill_null(-1).to_numpy(zero_copy_only=False)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            # numbers from 1; 0 stands for rare words and after each text
            s = np.zeros(len(flat) + len(lens), np.uint64)
            s[np.arange(len(flat)) + np.repeat(np.arange(len(lens)), lens)] = flat + 1
            held, size = [*held, s], size + len(s)
            if size >= TOKENS:
                yield from _packed(np.concatenate(held), longest, parts)
                held, size = [], 0
        if held:
            yield from _packed(np.concatenate(held), longest, parts)

    def total(table: pa.Table) -> pa.Table:
        found = []
        for length in {*table.column("length").to_pylist()}:
            own = table.filter(pc.equal(table.column("length"), length))
            found += _totals([x.as_py() for x in own.column("data")], length, least)
        term = given.value[0]
        named = [(pc.binary_join_element_wise(*[term.take(pa.array(c.astype(np.int64) - 1)) for c in columns], " "), pa.array(n, pa.int64())) for columns, n in found if len(n)]
        return pa.concat_tables([pa.table([pa.array([], pa.string()), pa.array([], pa.int64())], ["term", "n"]), *(pa.table(list(x), ["term", "n"]) for x in named)])

    blocks = tokens.mapInArrow(pack, "part int, length int, data binary")
    return spark.range(parts).mapInArrow(single, "term string, n long").unionByName(blocks.groupBy("part").applyInArrow(total, "term string, n long"))


def _runs(s: np.ndarray, length: int) -> list[np.ndarray]:
    """Numbers of the runs that begin at each place of s, two to a key; what follows a 0 is 0."""
    columns, open_ = [], np.ones(len(s), bool)
    for k in range(length):
        c = np.zeros(len(s), np.uint64)
        c[: max(len(s) - k, 0)] = s[k:]
        open_ &= c != 0
        columns.append(np.where(open_, c, np.uint64(0)))
    columns += [np.zeros(len(s), np.uint64)] * (length % 2)
    return [columns[k] << np.uint64(32) | columns[k + 1] for k in range(0, len(columns), 2)]


def _column(keys: list[np.ndarray], k: int) -> np.ndarray:
    return keys[k // 2] >> np.uint64(32) if k % 2 == 0 else keys[k // 2] & np.uint64(0xFFFFFFFF)


def _summed(keys: list[np.ndarray], n: np.ndarray, first: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Each different row of keys once, in order (that of `first` before theirs), with the sum of n."""
    order = np.lexsort([*reversed(keys), *reversed(first)])
    keys, n, first = [x[order] for x in keys], n[order], [x[order] for x in first]
    heads = np.ones(len(n), bool)
    if len(n):
        heads[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    at = np.flatnonzero(heads)
    return [x[at] for x in keys], np.add.reduceat(n, at) if len(at) else n, [x[at] for x in first]


def _packed(s: np.ndarray, longest: int, parts: int):
    """Blocks (part, length of runs, data) of a stream of numbers: pairs, and longer runs."""
    for length in sorted({2, longest}):
        keys = _runs(s, length)
        some = np.flatnonzero(_column(keys, min(length, 3) - 1))
        keys = [x[some] for x in keys]
        with np.errstate(over="ignore"):
            h = keys[0] * np.uint64(0x9E3779B97F4A7C15) + (_column(keys, 2) if length > 2 else np.uint64(0))
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        part = (h >> np.uint64(33)) % np.uint64(parts)
        keys, n, (part,) = _summed(keys, np.ones(len(some), np.int64), [part])
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
        ends = np.append(cuts[1:], len(part))
        data = [_block([x[a:b] for x in keys], n[a:b]) for a, b in zip(cuts, ends, strict=False)] if len(part) else []
        if data:
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(np.full(len(cuts), length, np.int32)), pa.array(data, pa.binary())], ["part", "length", "data"])


def _block(keys: list[np.ndarray], n: np.ndarray) -> bytes:
    """Rows as bytes: the first key as differences, all arrays by the place of the byte, so that alike bytes stand together."""
    arrays = [np.diff(keys[0], prepend=np.uint64(0)), *keys[1:], n.view(np.uint64)]
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays)
    return len(n).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _rows(block: bytes, count: int) -> list[np.ndarray]:
    rows = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd", 1).decompress(block[8:], 8 * rows * count, asbytes=True), np.uint8).reshape(count, 8, rows)
    arrays = [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in raw]
    return [np.cumsum(arrays[0], dtype=np.uint64), *arrays[1:]]


def _totals(blocks: list[bytes], length: int, least: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For each number of words that blocks of this length count: the columns of the n-grams that are frequent, and how often they occur."""
    arrays = [np.concatenate(x) for x in zip(*(_rows(b, (length + 1) // 2 + 1) for b in blocks), strict=True)]
    keys, n, _ = _summed(arrays[:-1], arrays[-1].view(np.int64), [])
    columns, out = [_column(keys, k) for k in range(length)], []
    for size in range(min(length, 3), length + 1):
        whole = np.flatnonzero(columns[size - 1])
        own, m = [c[whole] for c in columns[:size]], n[whole]
        if len(m):
            at = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in own], axis=0)))
            sums = np.add.reduceat(m, at)
            often = sums >= least
            out.append(([c[at[often]] for c in own], sums[often]))
    return out


#: Rows of a table of weights up to which it is broadcast.
WEIGHTS = 5_000_000


def attributions(counts: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    """report_id, category, term, idx, weight: count times coefficient of each term of weights(category, term, idx, coef).

    weights has at most `size` rows, one for each label and term of a vocabulary; up to WEIGHTS it is broadcast.
    """
    return counts.join(F.broadcast(weights) if size <= WEIGHTS else weights, "term").select("report_id", "category", "term", "idx", (F.col("n") * F.col("coef")).alias("weight"))


def linear_decisions(reports: DataFrame, attributed: DataFrame, intercepts: dict[str, float], epsilon: float = 0.1) -> DataFrame:
    """report_id, category, probability, decision of every report by linear models over terms: the logistic function of a label's
    intercept and the report's weights for it. A report without known terms is decided by the intercept."""
    labels = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(float(b)).alias("base")) for c, b in intercepts.items()])
    each = reports.select("report_id", F.explode(labels).alias("l")).select("report_id", "l.*")
    sums = attributed.groupBy("report_id", "category").agg(F.sum("weight").alias("logit"))
    scored = each.join(sums, ["report_id", "category"], "left")
    p = 1 / (1 + F.exp(-(F.col("base") + F.coalesce("logit", F.lit(0.0)))))
    return scored.select("report_id", "category", p.alias("probability")).withColumn("decision", confidence(F.col("probability"), epsilon))


def vectors(docs: DataFrame, stop: list[str], vocabulary: list[str], longest: int = 1) -> DataFrame:
    """report_id and `features`, a sparse vector of how often each term of a fixed vocabulary occurs; other terms are ignored."""
    from pyspark.ml.feature import CountVectorizerModel

    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    return model.transform(docs.select("report_id", F.coalesce(ngrams(kept_terms(F.col("report"), stop), longest), F.array().cast("array<string>")).alias("grams"))).drop("grams")


def top_terms(attributed: DataFrame, k: int = 30, nonzero: bool = False) -> DataFrame:
    """The k strongest by absolute weight for each report and category; ties keep the vocabulary's order."""
    rows = attributed.where("weight <> 0") if nonzero else attributed
    order = Window.partitionBy("report_id", "category").orderBy(F.desc(F.abs("weight")), "idx")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
