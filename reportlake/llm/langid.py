"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts become streams of folded letters with one blank for whatever stands between words. Each task counts the
n-grams of order ORDER of all its labelled texts and sends one row for each distinct n-gram; an aggregation adds
them up over the whole corpus. From these counts the driver derives every lower order's continuation counts,
absolute discounts and back-off weights, and stores them in arrays sorted by the n-gram's 64-bit key (16 bits for
each character, so keys don't collide). A text's score under a language is its cross-entropy a character; the
lowest wins. Rejection is calibrated on all labelled texts: how far their cross-entropies spread around the mean of
their language, for their length. Where the rows are in two parts, each part has limits of its own and a text is
rejected if it is beyond both; a part without texts of a language takes the other's. The score is the best language's share of the likelihood over 50 characters at the most; that of a
rejected text is lowered to 1 - BLIND or less.

Every n-gram that was counted is in the models, also those seen once, so the models grow with the corpus's distinct
n-grams; the driver and each Python worker hold them whole.

Defined results: a text that is null or has no letter is `und` with score 0 and is rejected. With no labelled text
at all, every text is. Very long texts are scored whole. Equal cross-entropies go to the language first in code-point
order. Repeated rows give repeated rows. Other columns are ignored by identified(). An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import stored

ORDER = 4
#: A text is rejected beyond so many spreads from its language's mean, if that is also so far on the way from the mean to guessing
#: blindly among all symbols; and characters above which a text's length no longer matters.
SPREADS, BLIND, LONG = 12.0, 0.6, 400
BLANK, EDGE, ASTRAL = 32, 1, 0xFFFE
#: Characters of texts that are worked on together.
BLOCK = 1 << 18


@lru_cache(1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its symbol, and whether it is a letter."""
    symbol, letter = np.full(0x110000, BLANK, np.uint16), np.zeros(0x110000, bool)
    for cp in range(128, 0x33480):  # no letters lie above
        c = chr(cp)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            symbol[cp] = ord(low) if len(low) == 1 and ord(low) < 0xFFF0 else cp if cp < 0xFFF0 else ASTRAL
            letter[cp] = c.isalpha()
    symbol[97:123] = symbol[65:91] = np.arange(97, 123)
    letter[97:123] = letter[65:91] = True
    symbol[0] = EDGE
    return symbol, letter


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all n-grams of the texts, the text of each, and whether each text has a letter."""
    symbol, letter = _folding()
    edge = "\0" * (ORDER - 1)
    joined = edge + edge.join(t.replace("\0", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    lens = np.array([len(t) + len(edge) for t in texts], np.int64)
    lettered = np.add.reduceat(letter[points].astype(np.int64), np.cumsum(lens) - lens) > 0 if len(texts) else np.zeros(0, bool)
    s = symbol[points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != BLANK) | (s[:-1] != BLANK)
    keep[1:] &= (s[1:] != BLANK) | (s[:-1] != EDGE)
    s, of = s[keep].astype(np.uint64), np.repeat(np.arange(len(texts)), lens)[keep]
    key = s[: len(s) - ORDER + 1].copy()
    for x in range(1, ORDER):
        key = (key << np.uint64(16)) | s[x : len(s) - ORDER + 1 + x]
    real = s[ORDER - 1 :] != EDGE
    return key[real], of[ORDER - 1 :][real], lettered


def _pieces(texts: list[str]):
    """Ranges of texts of about BLOCK characters together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > BLOCK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _count(batches):
    """(lang, key, n) of a task's texts, and under key -1 the number of texts."""
    held: dict[str, list] = {}

    def fold(lang):
        keys, sums = (np.concatenate(x) for x in zip(*held[lang], strict=True))
        u, at = np.unique(keys, return_inverse=True)
        held[lang] = [(u, np.bincount(at, sums, len(u)).astype(np.int64))]

    def rows(lang):
        fold(lang)
        keys, sums = held[lang][0]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(sums)], ["lang", "key", "n"])

    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            by: dict[str, list[str]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                mine = held.setdefault(lang, [])
                mine.append((np.array([2**64 - 1], np.uint64), np.array([len(texts)], np.int64)))
                for i, j in _pieces(texts):
                    mine.append(np.unique(grams(texts[i:j])[0], return_counts=True))
                if sum(len(k) for k, _ in mine) > 2_000_000:
                    fold(lang)
                    if len(held[lang][0][0]) > 1_000_000:
                        yield rows(lang)
                        held[lang] = []
    for lang in held:
        if held[lang]:
            yield rows(lang)


class Model:
    """Kneser-Ney tables of one language: for each order the sorted keys with their discounted shares, and the
    sorted contexts with their back-off weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.grams, self.contexts = [], []
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        for n in range(ORDER, 0, -1):
            context = keys >> np.uint64(16)
            heads, first = np.unique(context, return_index=True)
            total = np.add.reduceat(counts, first)
            kinds = np.diff(np.append(first, len(keys)))
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            share = np.maximum(counts - discount, 0) / np.repeat(total, kinds)
            left = 1 - np.add.reduceat(share, first)
            self.grams.append((keys, share.astype(np.float32)))
            self.contexts.append((heads, np.maximum(left, 1e-6).astype(np.float32)))
            if n > 1:
                # of the next lower order, each n-gram counts the characters that it was seen after
                keys, counts = np.unique(keys & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True)
                counts = counts.astype(np.float64)
        self.symbols = len(self.grams[-1][0])

    def log_shares(self, keys: np.ndarray, symbols: int) -> np.ndarray:
        p = np.full(len(keys), 1.0 / (symbols + 1))
        for n in range(1, ORDER + 1):
            own = keys & np.uint64((1 << 16 * n) - 1)
            found, share = self.grams[ORDER - n]
            seen, left = self.contexts[ORDER - n]
            p = _at(found, share, own, 0.0) + _at(seen, left, own >> np.uint64(16), 1.0) * p
        return np.log(p)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


class Tables:
    """All languages' models side by side: for each order the sorted keys that any of them holds, once with the shares and once with the
    back-off weights of the languages that do. A key is looked up once for all languages."""

    def __init__(self, models: list[Model], symbols: int):
        self.n, self.symbols = len(models), symbols
        self.orders = [(_merged([m.grams[k] for m in models]), _merged([m.contexts[k] for m in models])) for k in range(ORDER)]

    def log_shares(self, keys: np.ndarray) -> np.ndarray:
        """A row for each key, a column for each language."""
        p = np.full((len(keys), self.n), 1.0 / (self.symbols + 1))
        for n in range(1, ORDER + 1):
            own = keys & np.uint64((1 << 16 * n) - 1)
            shares, left = self.orders[ORDER - n]
            p = _looked_up(shares, own, self.n, 0.0) + _looked_up(left, own >> np.uint64(16), self.n, 1.0) * p
        return np.log(p)


def _merged(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Sorted keys of all tables, where each key's entries begin, and the entries: table and value."""
    keys, values = (np.concatenate(x) for x in zip(*tables, strict=True))
    of = np.repeat(np.arange(len(tables), dtype=np.int16), [len(k) for k, _ in tables])
    order = np.argsort(keys, kind="stable")
    heads, first = np.unique(keys[order], return_index=True)
    return heads, np.append(first, len(keys)), of[order], values[order]


def _looked_up(table: tuple[np.ndarray, ...], wanted: np.ndarray, n: int, other: float) -> np.ndarray:
    keys, first, of, values = table
    out = np.full((len(wanted), n), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == wanted)
    at = at[hit]
    size = first[at + 1] - first[at]
    ends = np.cumsum(size)
    entry = np.repeat(first[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    out[np.repeat(hit, size), of[entry]] = values[entry]
    return out


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", apart: Column | None = None) -> dict:
    """Models and calibration, both from all labelled rows of docs; ids aren't read.

    apart: whether a row is of the second part, whose limits are `mean_apart` and `spread_apart`; none is by default.
    """
    second = F.lit(False) if apart is None else F.coalesce(apart, F.lit(False))
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), second.alias("apart"))
    counts = docs.select("lang", "text").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = stored(counts, "counts")
    facts = counts.groupBy("lang").agg(F.sum(F.when(F.col("key") == -1, F.col("n")).otherwise(0)).alias("texts"), F.sum(F.when(F.col("key") != -1, F.col("n")).otherwise(0)).alias("chars"))
    facts = {r.lang: (r.texts, r.chars) for r in facts.collect() if r.chars}
    if not facts:
        return {"langs": [], "models": [], "symbols": 0, "mean": [], "spread": [], "mean_apart": [], "spread_apart": []}
    langs, models = sorted(facts), []
    for lang in langs:
        kept = counts.where((F.col("lang") == lang) & (F.col("key") != -1)).select("key", "n").toArrow()
        models.append(Model(kept.column("key").to_numpy().view(np.uint64), kept.column("n").to_numpy()))
    model = {"langs": langs, "models": models, "symbols": max(m.symbols for m in models)}
    # the rejection isn't read yet
    nowhere = {"mean": [0.0] * len(langs), "spread": [1.0] * len(langs)}
    w, b = F.least("chars", F.lit(LONG)), F.col("bits")
    sums = _scored(docs, model | nowhere | {f"{k}_apart": v for k, v in nowhere.items()}, ["lang", "apart"]).where("lang = lang_pred")
    sums = sums.groupBy("lang", "apart").agg(F.avg(b).alias("mean"), F.avg(w).alias("w"), F.avg(w * b).alias("wb"), F.avg(w * b * b).alias("wbb"))
    # the mean of w (bits - mean)^2, from sums of one pass
    limits = {(r.lang, r.apart): (r.mean, max(max(r.wbb - 2 * r.mean * r.wb + r.mean**2 * r.w, 0) ** 0.5, 0.5)) for r in sums.collect()}
    for part, name in ((False, ""), (True, "_apart")):
        own = [limits.get((lang, part)) or limits.get((lang, not part), (0.0, 1.0)) for lang in langs]
        model["mean" + name], model["spread" + name] = [m for m, _ in own], [s for _, s in own]
    return model


def _scored(docs: DataFrame, model: dict, carry: list[str]) -> DataFrame:
    """carry, lang_pred, score, bits (nats a character of the best language), chars, rejected, for the column `text`."""
    tables = Tables(model["models"], model["symbols"]) if model["models"] else None
    sent = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "models"} | {"tables": tables})

    def run(batches):
        m = sent.value
        n_langs, mean, spread = len(m["langs"]), np.array([m["mean"], m["mean_apart"]]), np.array([m["spread"], m["spread_apart"]])
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = [t or "" for t in part.column(0).to_pylist()]
                sums, chars, letters = np.zeros((len(texts), n_langs)), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
                for i, j in _pieces(texts) if n_langs else ():
                    keys, of, letters[i:j] = grams(texts[i:j])
                    own, at = np.unique(keys, return_inverse=True)
                    chars[i:j] = np.bincount(of, minlength=j - i)
                    some = np.flatnonzero(chars[i:j])
                    begins = (np.cumsum(chars[i:j]) - chars[i:j])[some]
                    for x, shares in enumerate(np.ascontiguousarray(m["tables"].log_shares(own).T)):
                        if len(some):
                            sums[i + some, x] = np.add.reduceat(shares[at], begins)
                ok = letters & (chars > 0)
                cross = -sums / np.maximum(chars, 1)[:, None]
                if n_langs:
                    best = cross.argmin(1)
                    bits = cross[np.arange(len(texts)), best]
                    size = np.minimum(chars, LONG)
                    score = 1 / np.exp(np.minimum((bits[:, None] - cross) * np.minimum(chars, 50)[:, None], 0)).sum(1)
                    off = bits - mean[:, best]
                    way = (off / np.maximum(np.log(m["symbols"] + 1) - mean[:, best], 1e-9)).min(0)
                    reject = (off > SPREADS * spread[:, best] / np.sqrt(size)).all(0) & (way > BLIND)
                    # a rejected text is as sure as it is far from blind guessing
                    score = np.where(reject, score * np.clip(1 - way, 0, 1), score)
                else:
                    best, bits, score, reject = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)), ok
                names = [m["langs"][b] if k else "und" for b, k in zip(best, ok, strict=True)]
                cols = [part.column(x + 1) for x in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(bits), pa.array(chars), pa.array(reject | ~ok)], [*carry, "lang_pred", "score", "bits", "chars", "rejected"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "lang_pred string, score double, bits double, chars long, rejected boolean"])
    return docs.select("text", *[F.col(f"`{c}`") for c in carry]).mapInArrow(run, schema)


def identified(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), bits (nats a character), chars, rejected, for every whole text."""
    return _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, ["doc_id"])


def accepted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text the models don't reject."""
    whole = docs.select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return _scored(whole, model, ["row"]).where("NOT rejected").select("row.*")
