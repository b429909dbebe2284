"""Personal data by patterns, and terms that disclose it by information-theoretic sanitisation.

The patterns give the protected entities: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. A
term near an entity discloses it as far as the two occur together more than by chance. Over the whole corpus,
the pointwise mutual information of entity c and term t, log(n(c,t) N / (n(c) n(t))), is held against what the entity
itself holds, log(N / n(c)). All four count distinct texts, so copies of a document cancel: N all texts, n(c) and n(t)
those with the entity or the term, n(c,t) those where the term stands among the WINDOW words to a side of a mention.
Terms that reach SHARE of the entity's information in SUPPORT different windows or documents or more are spans of kind `term` wherever they stand in any text.

Only mentions with their windows are joined and counted between tasks; the corpus itself is read three times: for
mentions, for the counts of the terms in question and for the places of the terms that disclose, the
last two found through a map of bits of bounded size. Up to half a million terms the map is exact; beyond, the joins after it are.

Defined results: a null text counts as empty. A match that fails its check is dropped and the search goes on
after it. Spans are in code points, ends exclusive; kinds may overlap. Rows that repeat give repeated rows. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import bit_map, row_word_hashes, stored, utf8

KINDS = ("email", "ip", "card", "phone", "term")
#: Words to each side of a mention; windows (in different documents or different words) a term must share with an entity; share of the entity's information it must reveal.
WINDOW, SUPPORT, SHARE = 6, 2, 0.9

# Parts of the contract's patterns, for a walk that tries each place once: an address ends where its domain does and starts
# where its local part can; an IP is four groups of a chain of digits and dots.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place in KINDS, start, end) of all base matches that hold, by kind and start."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and _LOCAL.match(text[a - 1]):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            found.append((0, a, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if "." in text:
        for m in _CHAIN.finditer(text):
            start, groups = m.start(), m.group().split(".")
            for g in range(0, len(groups) - 3, 4):
                four = groups[g : g + 4]
                size = sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    found.append((1, start, start + size))
                start += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_digit_or_sign = np.zeros(256, bool)
_digit_or_sign[list(b"0123456789@+")] = True


def _may_hold(column: pa.Array) -> np.ndarray:
    """Which rows have a character that every kind needs one of."""
    data, bounds = utf8(column)
    hits = np.flatnonzero(_digit_or_sign[data])
    return np.searchsorted(hits, bounds[1:]) > np.searchsorted(hits, bounds[:-1])


def _windows(text: str, spans: list[tuple[int, int, int]]):
    """For each mention: its entity, and the words around it with their places."""
    taken = sorted((a, b) for _, a, b in spans)
    for _, a, b in spans:
        entity = text[a:b].lower()
        before, cut, reach = [], a, 64
        while cut and len(before) < WINDOW:
            start = max(0, a - reach)
            words = [(m.start(), m.end()) for m in _WORD.finditer(text, start, a)]
            # a word cut off at the left edge is left for the next, longer reach
            before = words if not start else words[1:]
            cut, reach = start, reach * 2
        after = []
        for m in _WORD.finditer(text, b):
            after.append((m.start(), m.end()))
            if len(after) == WINDOW:
                break
        words = [w for w in before[-WINDOW:] + after if not any(s < w[1] and w[0] < e for s, e in taken)]
        yield entity, words


#: Marks that a term loses at both ends and may hold inside: of ASCII, of Latin-1, and the commonest others.
_EDGES = {chr(c) for c in (*range(33, 127), *range(0x2010, 0x2028), *range(0x2030, 0x203F), 0x3001, 0x3002)} | set("¡§«¶·»¿")
_EDGES = frozenset(c for c in _EDGES if not c.isalnum())


def _stripped(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _EDGES:
        a += 1
    while b > a and text[b - 1] in _EDGES:
        b -= 1
    return a, b


def _hash_text(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_MENTION = "struct<entity:long,window:long,term:long,start:int,stop:int>"
_FOUND = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_SEEN = pa.struct([("entity", pa.int64()), ("window", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _terms(column: pa.Array):
    """Word hashes as for terms: of words with the marks around them stripped. Yields as row_word_hashes does."""
    yield from row_word_hashes(_blanked(column))


def _mark_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a mark of _EDGES."""
    found = _ASCII_MARK[data]
    for lead in {c.encode()[:-1] for c in _EDGES if not c.isascii()}:
        last = np.zeros(256, bool)
        last[[c.encode()[-1] for c in _EDGES if c.encode()[:-1] == lead]] = True
        at = np.flatnonzero(data[: max(len(data) - len(lead), 0)] == lead[0])
        for x in range(1, len(lead)):
            at = at[data[at + x] == lead[x]]
        at = at[last[data[at + len(lead)]]]
        for x in range(len(lead) + 1):
            found[at + x] = True
    return found


def _blanked(column: pa.Array) -> pa.Array:
    """Marks at the ends of words become blanks, so that a term is the same with and without the comma after it."""
    data, bounds = utf8(column)
    out = data.copy()
    at = np.flatnonzero(_mark_bytes(data))
    if len(at):
        # runs of marks within a row; a run is inside a word if a byte of the word stands on both sides
        heads = np.append(True, (at[1:] != at[:-1] + 1) | (np.searchsorted(bounds, at[1:], "right") != np.searchsorted(bounds, at[:-1], "right")))
        first, last = at[heads], at[np.append(heads[1:], True)]
        row = np.searchsorted(bounds, first, "right") - 1
        left = (first > bounds[row]) & ~_BLANK[data[first - 1]]
        right = (last + 1 < bounds[row + 1]) & ~_BLANK[data[np.minimum(last + 1, len(data) - 1)]]
        out[at[~np.repeat(left & right, np.diff(np.append(np.flatnonzero(heads), len(at))))]] = 32
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))


_ASCII_MARK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_ASCII_MARK[[ord(c) for c in _EDGES if c.isascii()]] = True
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mentions(batches):
    for batch in batches:
        for x in range(0, batch.num_rows, 500):
            part = batch.slice(x, 500)
            holds = _may_hold(part.column(1))
            spans, seen, terms = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)], []
            for r in np.flatnonzero(holds):
                text = part.column(1)[int(r)].as_py() or ""
                spans[r] = base_spans(text)
                for entity, words in _windows(text, spans[r]):
                    window = _hash_text(" ".join(text[a:b] for a, b in words))
                    for a, b in words:
                        a, b = _stripped(text, a, b)
                        if a < b:
                            seen[r].append({"entity": _hash_text(entity), "window": window, "term": len(terms), "start": a, "stop": b})
                            terms.append(text[a:b])
            if terms:
                hashes = np.concatenate([h for *_, h, _ in _terms(pa.array(terms, pa.large_string()))]).view(np.int64)
                if len(hashes) != len(terms):
                    raise ValueError("a term is not one word")
                for s in seen:
                    for m in s:
                        m["term"] = int(hashes[m["term"]])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in s] for s in spans], pa.list_(_FOUND)), pa.array(seen, pa.list_(_SEEN)), pa.array(np.arange(part.num_rows) + x, pa.int64())], ["doc_id", "base", "seen", "_x"])


def _text_counts(bits):
    """(term, n) of texts with their weights, 1 over the number of their copies, so that each text counts once."""

    def run(batches):
        total: list[tuple] = []
        for batch in batches:
            weight = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, hashes, first in _terms(batch.column(0)):
                hit = np.flatnonzero(bits.value.holds(hashes))
                if len(hit):
                    row = np.searchsorted(first, hit, "right") - 1
                    order = np.lexsort((hashes[hit], row))
                    h, r = hashes[hit][order], row[order]
                    new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))
                    total.append((h[new], weight[i + r[new]]))
            if sum(len(h) for h, _ in total) > 1_000_000:
                yield _sums(total)
                total = []
        if total:
            yield _sums(total)

    return run


def _places(text: str) -> list[tuple[int, int]]:
    """Start and end of each term of a text, in the order of _terms."""
    places = (_stripped(text, *m.span()) for m in _WORD.finditer(text))
    return [(a, b) for a, b in places if a < b]


def _occurrences(bits):
    """(row, term, start, stop) of the terms on the map of bits in whole texts."""

    def run(batches):
        for batch in batches:
            for i, _, hashes, first in _terms(batch.column(1)):
                hit = np.flatnonzero(bits.value.holds(hashes))
                if not len(hit):
                    continue
                row = np.searchsorted(first, hit, "right") - 1
                ends = []
                for r in np.unique(row):
                    places = _places(batch.column(1)[int(i + r)].as_py())
                    if len(places) != first[r + 1] - first[r]:
                        raise ValueError("terms and their places differ")
                    ends += [places[k - first[r]] for k in hit[row == r]]
                ends = np.array(ends, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row)), pa.array(hashes[hit].view(np.int64)), pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["row", "term", "start", "stop"])

    return run


def _sums(found: list[tuple]) -> pa.RecordBatch:
    terms, weights = (np.concatenate(x) for x in zip(*found, strict=True))
    u, at = np.unique(terms, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(at, weights, len(u)))], ["term", "n"])


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text), base and terms of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # rows are told apart by the place their text holds in its table, so ids may repeat
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("row"), "text")
    seen = rows.mapInArrow(_mentions, f"row struct<doc_id:{kind},h:long>, base array<struct<kind:int,start:int,stop:int>>, seen array<{_MENTION}>, _x long")
    seen = stored(seen.select("row.doc_id", "row.h", "base", "seen"), "mentions")
    each = seen.where(F.size("seen") > 0).select("doc_id", "h", F.explode("seen").alias("m")).select("doc_id", "h", "m.*")
    copies = stored(seen.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "copies")
    windows = each.select("entity", "term", "h", "window").distinct().groupBy("entity", "term", "h").agg(F.count(F.lit(1)).alias("w"))
    windows = windows.join(copies, "h", "left")
    support = F.sum(F.col("w") * F.coalesce("m", F.lit(1)))
    pairs = windows.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("nct"), support.alias("support")).where(F.col("support") >= SUPPORT)
    pairs = stored(pairs, "pairs")
    terms, asked = None, pairs.agg(F.count_distinct("term")).first()[0]
    if asked:
        bits = docs.sparkSession.sparkContext.broadcast(bit_map(pairs.select("term"), asked, listed=True))
        weighted = rows.select("row.h", "text").join(copies, "h", "left").select("text", (1.0 / F.coalesce("m", F.lit(1))).alias("weight"))
        by_term = weighted.mapInArrow(_text_counts(bits), "term long, n double").groupBy("term").agg(F.round(F.sum("n")).alias("nt"))
        by_entity = each.select("entity", "h").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("nc"))
        n = seen.count() - (copies.agg(F.sum(F.col("m") - 1)).first()[0] or 0)
        both = pairs.join(by_term, "term").join(by_entity, "entity")
        shared = F.log(F.col("nct") * F.lit(float(n)) / (F.col("nc") * F.col("nt")))
        known = both.where((F.col("nc") < n) & (shared >= SHARE * F.log(F.lit(float(n)) / F.col("nc")))).select("term").distinct()
        known = stored(known, "known")
        bits = docs.sparkSession.sparkContext.broadcast(bit_map(known, known.count(), listed=True))
        hits = rows.mapInArrow(_occurrences(bits), f"row struct<doc_id:{kind},h:long>, term long, start int, stop int")
        hits = hits.join(known, "term", "left_semi").select("row.doc_id", "row.h", "start", "stop").distinct()
        terms = hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct(F.lit(KINDS.index("term")).alias("kind"), "start", "stop"))).alias("terms"))
    empty = F.array().cast("array<struct<kind:int,start:int,stop:int>>")
    if terms is None:
        return seen.select("doc_id", "h", "base", empty.alias("terms"))
    key = (F.col("s.h") == F.col("t.h")) & F.col("s.doc_id").eqNullSafe(F.col("t.doc_id"))
    return seen.select("doc_id", "h", "base").alias("s").join(terms.alias("t"), key, "left").select("s.doc_id", "s.h", "base", F.coalesce("terms", empty).alias("terms"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and terms: arrays of (kind, start, stop) of every document, each sorted by kind and start."""
    return _found(docs, id_col, text_col).drop("h")


def joined(spans):
    """Spans as text: kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text with every span generalised to its kind in brackets; spans that overlap are one
    stretch, named after the one that starts first, then the longer. Every row is cleaned by the spans of its own text, whether its id is null or stands on other texts too."""

    @F.pandas_udf("string")
    def cleaned(texts, base, terms):
        out = []
        for text, b, t in zip(texts, base, terms, strict=True):
            if text is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s in sorted([*b, *t], key=lambda s: (s["start"], -s["stop"])):
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                at = max(at, s["stop"])
            out.append("".join([*parts, text[at:]]))
        import pandas as pd

        return pd.Series(out, dtype="object")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    spans = _found(docs, id_col, text_col).where(F.size("base") + F.size("terms") > 0).dropDuplicates(["doc_id", "h"])
    key = (F.col("r.h") == F.col("s.h")) & F.col("r.doc_id").eqNullSafe(F.col("s.doc_id"))
    both = rows.alias("r").join(spans.alias("s"), key, "left").select("r.doc_id", "text", "base", "terms")
    # texts without spans pass Python by
    return both.select("doc_id", F.coalesce(cleaned(F.when(F.col("base").isNotNull(), F.col("text")), "base", "terms"), "text").alias("text"))
