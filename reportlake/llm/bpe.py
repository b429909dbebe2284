"""BPE encoding and decoding over a distinct-word table.

A tokenizer whose pieces never cross ASCII white space encodes a text as its words, end to end; loading checks that.

1. Split. Blocks of documents are split into words. A block keeps its distinct words, dealt into GROUPS by a hash, and for each
   document the places of its words among them, commonest words first, in few bytes.
2. Table. The blocks' words meet by group. A group's distinct words are encoded once for the whole corpus, by the library itself, so
   normalisation, special strings and merges are the library's, and every block gets the ids of its words back.
3. Join by position. A block's documents and its words' ids meet again, and places become ids.
4. Decoding joins ids with the id-to-piece table, which is as large as the vocabulary and so travels as a broadcast.

Only distinct words of blocks and their ids are shuffled. Documents aren't: the places are a table bucketed by block,
so its rows stay where they are and the ids come to them. A word that every text holds is one entry of each block,
whatever its number of occurrences, and blocks are of about equal size, so no key is hot. One task holds the distinct words of
a group at a time, another a block's places with its words' ids.

Defined results: a null text counts as empty and has no ids; its decoded text is empty. Very long texts and
words are encoded whole; a text longer than a block is one of its own. Repeated rows give repeated rows. Columns named in
`carry` pass through whatever their names; others are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import PIECE, blocks, bucketed, row_word_hashes, stored, utf8

#: Characters of a block's documents, and groups that words are dealt into.
BLOCK, GROUPS = 16 << 20, 4096
#: Words of a document that are joined with their ids at a time.
CHUNK = 200_000
GAPS = " \t\n\x0b\x0c\r"
#: Texts on which loading checks that white space parts the pieces: letters, digits, marks, accents, symbols and lone combining characters.
PROBES = ["Hello", "don't", "d1l2", "a.b,c", "(x)", "Éte", "é", "́", "日本語", "👍🏽", "ΣΑΣ", "\x01", "ﬁx", "<", "|>", "1,000.50", " ", "x　y"]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def _loaded(path: str):
    """The tokenizer and its pieces by id. A tokenizer for which texts aren't their words end to end is an error."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    size = max(tok.get_vocab(with_added_tokens=True).values()) + 1
    pieces = [(tok.id_to_token(i) or "").encode() for i in range(size)]
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    words = [*PROBES, *special, *(f"a{s}b" for s in special)]
    apart = [tok.encode(w, add_special_tokens=False).ids for w in words]
    for gap in [*GAPS, "  ", "\n\t "]:
        ids = tok.encode(gap + gap.join(words) + gap, add_special_tokens=False).ids
        if ids != [i for a in apart for i in a] or tok.decode(ids, skip_special_tokens=False).encode() != b" ".join(pieces[i] for i in ids):
            raise ValueError(f"{path}: pieces cross white space or aren't decoded one by one")
    if any(c in s for s in special for c in GAPS):
        raise ValueError(f"{path}: a special string holds white space")
    return tok, pieces


def _words(text: str) -> list[str]:
    """Words between ASCII white space; str.split() would also cut at other white space, which the library itself handles."""
    for c in GAPS[1:]:
        text = text.replace(c, " ")
    return list(filter(None, text.split(" ")))


class _Index(dict):
    """Words to numbers in the order of their first use."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def packed(numbers: np.ndarray) -> np.ndarray:
    """Non-negative numbers in bytes of seven bits, low ones first; the last byte of a number is under 128."""
    numbers = numbers.astype(np.int64)
    sizes = np.ones(len(numbers), np.int64)
    for bits in range(7, 63, 7):
        more = numbers >> bits > 0
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        some = sizes > k
        out[(ends - sizes)[some] + k] = numbers[some] >> 7 * k & 127 | (sizes[some] > k + 1) * 128
    return out


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max()) + 1 if len(last) else 0):
        some = last - first >= k
        out[some] |= (data[first[some] + k].astype(np.int64) & 127) << 7 * k
    return out


class _Block:
    """Documents that share a table of distinct words."""

    columns = {"block": pa.int64(), "group": pa.int32(), "words": pa.large_string(), "groups": pa.binary(), "places": pa.binary()}

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.index, self.held = _Index(), []

    def add(self, carry: pa.Array, texts: list[str]) -> None:
        self.held.append((carry, [np.fromiter(map(self.index.__getitem__, _words(t)), np.int32) for t in texts]))
        self.size += sum(map(len, texts))

    def _batch(self, carry: pa.Array, **columns) -> pa.RecordBatch:
        n = len(carry)
        columns["block"] = pa.array([self.number] * n, pa.int64())
        return pa.RecordBatch.from_arrays([*(columns.get(c, pa.nulls(n, kind)) for c, kind in self.columns.items()), carry], [*self.columns, "carry"])

    def rows(self):
        """A row for each document: the places of its words among the block's, commonest first; a row with the group of each place; and a
        row for each group: its words in the order of their places."""
        count = np.bincount(np.concatenate([p for _, places in self.held for p in places]), minlength=len(self.index))
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for carry, texts in self.held:
            yield self._batch(carry, places=pa.array([packed(place[t]).tobytes() for t in texts], pa.binary()))
        if not self.index:
            return
        words, none = list(self.index), pa.nulls(1, self.held[0][0].type)
        some = (" ".join(words[a : a + 10_000]) for a in range(0, len(words), 10_000))
        hashes = np.concatenate([h for text in some for *_, h, _ in row_word_hashes(pa.array([text], pa.large_string()))])
        group = (hashes % np.uint64(GROUPS)).astype(np.int64)[order]
        yield self._batch(none, groups=pa.array([group.astype("<u2").tobytes()], pa.binary()))
        by_group = np.argsort(group, kind="stable")
        ends = np.flatnonzero(np.diff(group[by_group], append=-1)) + 1
        texts = [" ".join([words[i] for i in order[some]]) for some in np.split(by_group, ends[:-1])]
        none = pa.nulls(len(texts), none.type)
        yield self._batch(none, group=pa.array(group[by_group[ends - 1]], pa.int32()), words=pa.array(texts, pa.large_string()))


def _split(batches):
    block = _Block(TaskContext.get().partitionId() << 32)
    for batch in batches:
        texts = pc.fill_null(batch.column(0), "")
        for a, b in blocks(utf8(texts)[1], PIECE):
            block.add(batch.column(1).slice(a, b - a), texts.slice(a, b - a).to_pylist())
            if block.size > BLOCK:
                yield from block.rows()
                block = _Block(block.number + 1)
    if block.held:
        yield from block.rows()


def _encoded(path: str, width: str):
    """Rows sorted by group in: each distinct word of a group is encoded once; block, group, and the sizes and ids of its words out.

    A task holds the distinct words of one group at a time; rows stream by.
    """

    def run(batches):
        tok, _ = _loaded(path)
        known, group, each = {}, None, np.dtype(width).itemsize
        for batch in batches:
            of = batch.column(1).to_numpy()
            heads = np.flatnonzero(np.diff(of)) + 1
            for a, b in zip([0, *heads], [*heads, len(of)], strict=True):
                if a == b:
                    continue
                if of[a] != group:
                    known, group = {}, of[a]
                part = batch.slice(int(a), int(b - a))
                split = [w.split(" ") for w in part.column(2).to_pylist()]
                new = list(set().union(*split).difference(known))
                for x in range(0, len(new), 5000):
                    words = new[x : x + 5000]
                    known.update((w, np.array(e.ids, width).tobytes()) for w, e in zip(words, tok.encode_batch_fast(words, add_special_tokens=False), strict=True))
                found = [[known[w] for w in words] for words in split]
                sizes = [packed(np.array([len(x) // each for x in f])).tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.binary()), pa.array([b"".join(f) for f in found], pa.binary())], ["block", "group", "sizes", "ids"])

    return run


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] for each i of `at`, end to end."""
    n = size[at]
    ends = np.cumsum(n)
    return flat[np.repeat(start[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _joined(pieces, width: str, with_ids: bool, n_carried: int):
    """Of a block: places become ids by its words' ids, and ids become pieces by the id-to-piece table."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        flat, bounds = pieces.value
        words = words.sort_by("group")
        sizes = unpacked(np.frombuffer(b"".join(words.column("sizes").to_pylist()), np.uint8))
        ids = np.frombuffer(b"".join(words.column("ids").to_pylist()), width).astype(np.int64)
        (groups,) = docs.column("groups").drop_null().to_pylist() or [b""]
        order = np.argsort(np.frombuffer(groups, "<u2"), kind="stable")
        if len(order) != len(sizes):
            raise ValueError("words of a block are missing")
        size, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        size[order], start[order] = sizes, np.cumsum(sizes) - sizes
        docs = docs.filter(pc.is_valid(docs.column("places")))
        tokens, digests, decoded, arrays = [], [], [], []
        for blob in docs.column("places").to_pylist():
            places = unpacked(np.frombuffer(blob, np.uint8))
            as_ids, as_text, n, own, last = hashlib.sha256(), hashlib.sha256(), 0, [], b""
            for a in range(0, len(places), CHUNK):
                mine = _gathered(ids, start, size, places[a : a + CHUNK])
                raw = mine.astype("<u4")
                as_ids.update(raw.tobytes())
                n += len(raw)
                if with_ids:
                    own.append(raw.astype(np.int32))
                # each piece has a blank after it; the text's last one is left out
                text = last + _gathered(flat, bounds[:-1], np.diff(bounds), mine).tobytes()
                as_text.update(text[:-1])
                last = text[-1:]
            tokens.append(n)
            digests.append(as_ids.hexdigest())
            decoded.append(as_text.hexdigest())
            arrays += own
        carried = docs.column("carry").combine_chunks()
        cols = [carried.field(i) for i in range(n_carried)]
        cols += [pa.array(tokens, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        if with_ids:
            ends = pa.array(np.concatenate([[0], np.cumsum(tokens)]).astype(np.int32), pa.int32())
            cols.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32())))
        return pa.table(cols, names=[*(f"c{i}" for i in range(n_carried)), "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return run


def coded(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """carry, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids array<int> of every whole text."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    _, pieces = _loaded(path)
    width = "<u2" if len(pieces) <= 1 << 16 else "<u4"
    table = np.frombuffer(b"".join(p + b" " for p in pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    sent = spark.sparkContext.broadcast(table)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kinds = [fields[c] for c in carry]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    carried = f"struct<{','.join(f'c{i}:{k}' for i, k in enumerate(kinds))}>"
    split = docs.select(F.col(f"`{text_col}`").alias("text"), row.alias("carry")).mapInArrow(_split, f"block long, group int, words string, groups binary, places binary, carry {carried}")
    split = bucketed(split, "block", "split")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = split.where("group IS NOT NULL").select("block", "group", "words").repartition(parts, "group").sortWithinPartitions("group")
    ids = words.mapInArrow(_encoded(path, width), "block long, group int, sizes binary, ids binary")
    places = split.where("group IS NULL").select("block", "groups", "places", "carry")
    schema = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["ids array<int>"] if with_ids else [])])
    out = places.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_joined(sent, width, with_ids, len(carry)), schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})


def decode(tokens: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """tokens with `decoded`: each id joined to its piece, pieces joined by blanks in the ids' order; null ids give null.

    Rows are told apart by a key in a table, so rows may repeat. The id-to-piece table is as large as the vocabulary, so it is broadcast.
    """
    spark = tokens.sparkSession
    pieces = spark.createDataFrame([(i, p.decode()) for i, p in enumerate(_loaded(path or vocabulary_path())[1])], "_id int, _piece string")
    key = f"_{uuid.uuid4().hex}"
    rows = stored(tokens.withColumn(key, F.monotonically_increasing_id()), "tokens")
    each = rows.select(key, F.posexplode(F.col(f"`{ids_col}`")).alias("_at", "_id")).join(F.broadcast(pieces), "_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_piece"))), lambda x: x["_piece"]), " ")
    found = each.groupBy(key).agg(text.alias("_text"))
    decoded = F.when(F.col(f"`{ids_col}`").isNotNull(), F.coalesce("_text", F.lit("")))
    return rows.join(found, key, "left").withColumn("decoded", decoded).select(*[F.col(f"`{c}`") for c in tokens.columns], "decoded")
