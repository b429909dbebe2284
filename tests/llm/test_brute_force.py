"""Models and estimates beside plain versions of their definitions: Kneser-Ney, boosted trees, document statistics, disclosing terms, recall of bands and caps."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportlake.llm import capfilters, common, langid, minhash, pii, quality, trees

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- language identification ----

def symbols(text):
    """Folded letters, a blank for what stands between, after three edges."""
    out = ["^"] * 3
    for c in text:
        s = c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() or unicodedata.category(c)[0] == "M" else " "
        if s != " " or out[-1] not in (" ", "^"):
            out.append(s)
    return out


class KneserNey:
    def __init__(self, texts):
        counts = Counter(tuple(s[i - 3 : i + 1]) for s in map(symbols, texts) for i in range(3, len(s)))
        self.orders = []
        for _ in range(4):
            once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total = Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
            share = {g: max(c - discount, 0) / total[g[:-1]] for g, c in counts.items()}
            kept = Counter()
            for g, s in share.items():
                kept[g[:-1]] += s
            self.orders.append((share, {h: max(1 - s, 1e-6) for h, s in kept.items()}))
            counts = Counter(g[1:] for g in counts)
        self.size = len(self.orders[-1][0])

    def entropy(self, text, size):
        s, bits = symbols(text), 0.0
        for i in range(3, len(s)):
            p = 1 / (size + 1)
            for n, (share, left) in zip((1, 2, 3, 4), reversed(self.orders), strict=True):
                g = tuple(s[i - n + 1 : i + 1])
                p = share.get(g, 0.0) + left.get(g[:-1], 1.0) * p
            bits -= math.log(p)
        return bits / (len(s) - 3)


def test_language_models_are_kneser_ney(spark):
    rng = random.Random(7)
    bank = {"a": ["Haus", "straße", "über", "grün", "und", "der", "Äpfel"], "b": ["house", "street", "over", "green", "and", "the", "İl"], "c": ["maison", "l'été", "où", "vert", "et", "la", "ǆ"]}
    rows = [(i, " ".join(rng.choices(bank["abc"[i % 3]], k=rng.randint(1, 30))) + rng.choice(["", ".", " 12 ", "!\n"]), "abc"[i % 3]) for i in range(150)]
    rows += [(200 + i, t, None) for i, t in enumerate(["house straße", "été", "x", "the the und", "über!! 12 over", "quelque chose", " \n verts", "ΑΒΓ", "á b́"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in langid.identified(docs, langid.learned(docs.where("lang IS NOT NULL"))).collect()}
    models = {k: KneserNey([t for _, t, lang in rows if lang == k]) for k in "abc"}
    size = max(m.size for m in models.values())
    for i, text, _ in rows:
        cross = {k: m.entropy(text, size) for k, m in models.items()}
        best = min(cross, key=lambda k: (cross[k], k))
        assert got[i].lang_pred == best and math.isclose(got[i].bits, cross[best], rel_tol=1e-4), text


def test_rejected_texts_score_low(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=40)), "a") for i in range(60)] + [(100 + i, " ".join(rng.choices(["ziel", "haus", "baum", "gras"], k=40)), "z") for i in range(60)]
    model = langid.learned(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, "".join(rng.choices("bcdfghjklmnpqrtvwx ", k=400))), (2, docs[3][1])], "doc_id long, text string")
    noise, known = sorted(langid.identified(odd, model).collect())
    assert noise.rejected and noise.score <= 0.4 and not known.rejected and known.score > 0.99


def test_rejection_is_calibrated_on_all_labelled_texts(spark):
    rng = random.Random(11)
    bank = {"a": ["haus", "baum", "gras", "ziel"], "b": ["house", "tree", "grass", "goal"]}
    rows = [(i, " ".join(rng.choices(bank["ab"[i % 2]] + ["".join(rng.choices("bcdfgjkqvwxyz", k=9))], k=rng.randint(3, 20))), "ab"[i % 2]) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(docs)
    scored = langid.identified(docs, model).toPandas().sort_values("doc_id")
    for k, lang in enumerate(model["langs"]):
        own = scored[(scored.doc_id % 2 == k) & (scored.lang_pred == lang)]
        assert math.isclose(model["mean"][k], own.bits.mean(), rel_tol=1e-9)
        off = (own.bits - own.bits.mean()) ** 2 * own.chars.clip(upper=langid.LONG)
        assert math.isclose(model["spread"][k], max(off.mean() ** 0.5, 0.5), rel_tol=1e-9) and off.mean() > 0.25


# ---- quality ----

def tree_of(x, g, h, rows, depth, cuts, least, ridge):
    """Best splits by trying every cut of every feature, first feature and cut on ties."""
    best = None
    if depth:
        for f in range(x.shape[1]):
            for c in cuts[f]:
                left, right = [r for r in rows if x[r, f] <= c], [r for r in rows if x[r, f] > c]
                if sum(h[left]) < least or sum(h[right]) < least:
                    continue
                gain = sum(g[left]) ** 2 / (sum(h[left]) + ridge) + sum(g[right]) ** 2 / (sum(h[right]) + ridge) - sum(g[rows]) ** 2 / (sum(h[rows]) + ridge)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, c, left, right
    if best is None:
        return {r: -sum(g[rows]) / (sum(h[rows]) + ridge) for r in rows}
    return tree_of(x, g, h, best[3], depth - 1, cuts, least, ridge) | tree_of(x, g, h, best[4], depth - 1, cuts, least, ridge)


@pytest.mark.parametrize("seed", range(3))
def test_trees_are_the_best_splits(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(120, 4)).astype(np.float32)
    x[:, 3] = rng.integers(0, 3, 120)
    # labels between 0 and 1, so that no two splits tie
    y = 0.8 * ((x[:, 0] > 0.2) ^ (x[:, 3] > 0) ^ (rng.random(120) < 0.1)) + 0.2 * rng.random(120)
    bins, rate = 8, 0.3
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))) for f in range(4)]
    raw = np.full(120, math.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-raw))
        leaf = tree_of(x, p - y, p * (1 - p), list(range(120)), 3, cuts, 2.0, 1.0)
        raw = raw + rate * np.array([leaf[r] for r in range(120)])
    got = trees.fitted(x, y, trees=4, depth=3, rate=rate, bins=bins, least=2.0).score(x)
    assert np.allclose(got, 1 / (1 + np.exp(-raw)), atol=1e-9)


def statistics_of(text):
    data = (text or "").encode()
    kind = {c: "control" for c in (*range(32), 127)} | {c: "other" for c in range(128, 256)}
    for name, some in (("symbol", "#$%&*+=@^_~`"), ("stop", ".,;:?-"), ("quote", "'\""), ("bang", "!"), ("bar", "|"), ("bracket", "<>[](){}"), ("slash", "/\\"), ("blank", " \t"), ("newline", "\n\r"), ("digit", "0123456789")):
        kind |= {ord(c): name for c in some}
    kind |= {c: "lower" for c in range(97, 123)} | {c: "upper" for c in range(65, 91)}
    n = Counter(kind[b] for b in data)
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")]
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda a, b: a / max(b, 1)
    runs = lambda k: [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    own = len(set(words))
    return [share(n[c], len(data)) for c in quality.CLASSES] + [
        math.log1p(len(data)), math.log1p(len(words)), share(len(data) - n["blank"] - n["newline"], len(words)), share(own, len(words)), share(max(Counter(words).values(), default=0), len(words)),
        share(len(set(runs(2))), len(runs(2))), share(len(set(runs(5))), len(runs(5))), math.log1p(len(lines)), share(len(data), len(lines)), share(len(set(lines)), len(lines)), share(n["upper"], n["upper"] + n["lower"]), share(own, math.sqrt(len(words))),
    ]


def test_statistics_are_their_definitions():
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "Ab", " ", "\n", ". ", "é", "1", "|", "a b c d e f ", "<x> ", "\t", "!"], k=rng.randint(0, 80))) for _ in range(400)] + ["", None, "\n\n", "x" * 3000, "日本 " * 500]
    assert np.allclose(quality.statistics(pa.array(texts, pa.string())), np.array([statistics_of(t) for t in texts]), rtol=1e-5)


# ---- personal data ----

EDGE = "".join(sorted(pii._EDGES))


def disclosed(texts):
    """Terms by the definition: distinct texts hold entities and terms, windows of six words to a side hold both."""
    distinct, copies = sorted(set(texts)), Counter(texts)
    fold = lambda w: w.translate({c: c + 32 for c in range(65, 91)})
    terms = {t: {fold(s) for w in WORDS.findall(t) if (s := w.strip(EDGE))} for t in distinct}
    has, both, seen = Counter(), Counter(), {}
    for t in distinct:
        spans = pii.base_spans(t)
        pairs = set()
        for e in {t[a:b].lower() for _, a, b in spans}:
            has[e] += 1
        for _, a, b in spans:
            before = [(m.start(), m.end()) for m in WORDS.finditer(t[:a])][-6:]
            after = [(m.start() + b, m.end() + b) for m in WORDS.finditer(t[b:])][:6]
            around = [w for w in before + after if not any(s < w[1] and w[0] < e for _, s, e in spans)]
            for x, y in around:
                if s := t[x:y].strip(EDGE):
                    pairs.add((t[a:b].lower(), fold(s)))
                    seen.setdefault((t[a:b].lower(), fold(s)), set()).add((t, tuple(t[p:q] for p, q in around)))
        for p in pairs:
            both[p] += 1
    holds, n = Counter(w for t in distinct for w in terms[t]), len(distinct)
    support = {p: sum(copies[t] for t, _ in s) for p, s in seen.items()}
    return {w for (e, w), nct in both.items() if support[e, w] >= pii.SUPPORT and has[e] < n and math.log(nct * n / (has[e] * holds[w])) >= pii.SHARE * math.log(n / has[e]) - 1e-9}


@pytest.mark.parametrize("seed", range(2))
def test_terms_are_those_that_disclose(spark, seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(25)]
    texts = []
    for _ in range(150):
        words = rng.choices(common, k=rng.randint(0, 14))
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(6)
            words[rng.randint(0, len(words)) :] = [rng.choice([f"Name{k},", f"name{k}", "(w3)"]), f"p{k}@x.org", *rng.choices(common, k=rng.randint(0, 3))]
        texts += [" ".join(words)] * rng.choice([1, 1, 1, 3])
    texts += [f"far away name{k}" for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {i: sorted((a, b) for _, a, b in map(tuple, t)) for i, t in pii.found(docs).select("doc_id", "terms").collect()}
    want = disclosed(texts)
    assert any(w.startswith("name") for w in want)
    for i, t in enumerate(texts):
        spots = []
        for m in WORDS.finditer(t):
            a, b = m.start(), m.end()
            while a < b and t[a] in EDGE:
                a += 1
            while b > a and t[b - 1] in EDGE:
                b -= 1
            if t[a:b].lower() in want:
                spots.append((a, b))
        assert got[i] == spots, t


def test_every_row_is_cleaned_by_its_own_text(spark):
    rows = [(1, "write to aa@b.org now"), (1, "the longest words come first, call bob@leak.com please"), (1, "write to aa@b.org now"), (None, "call bob@leak.com please"), (None, "ip 10.0.0.1"), (None, None), (2, "clean"), (3, "ab@b.co +1 555 010 9999 x")]
    # words that stand everywhere disclose nothing
    everywhere = [(100 + i, f"now write to the {i} and call in the words please, first come x ip") for i in range(300)]
    docs = spark.createDataFrame(rows + everywhere, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in pii.sanitised(docs).where("doc_id < 100 OR doc_id IS NULL").collect())
    assert len(got) == len(rows) and not any("@" in t or "10.0" in t or "555" in t for _, t in got)
    assert [t for i, t in got if i == 1] == sorted(["the longest words come first, call [EMAIL] please", "write to [EMAIL] now", "write to [EMAIL] now"])
    assert [t for i, t in got if i == -1] == ["", "call [EMAIL] please", "ip [IP]"] and (2, "clean") in got


# ---- recall of candidates ----

@pytest.mark.parametrize("size", [30, 100, 1500])
def test_bands_meet_at_the_limit(size):
    """Pairs at a similarity of 0.80 to 0.81: the share without a common band, against independent coordinates' 3e-5."""
    rng = np.random.default_rng(size)
    missed, n = 0, 3000 if size < 1000 else 600
    for _ in range(n):
        union = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
        own = (size - math.ceil(0.8 * size)) // 2
        a, b = (minhash.signature(s).reshape(minhash.BANDS, minhash.ROWS) for s in (union[: size - own], union[own:]))
        missed += not (a == b).all(1).any()
    assert missed <= 0.002 * n


def test_no_unit_of_work_holds_more_than_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "BLOCK", 200)
    listed = spark.range(5000).select("id", F.array(F.lit(1.0)).alias("v"), F.lit(1).cast("long").alias("weight"), F.when(F.col("id") % 3 == 0, F.array(F.lit(4), F.lit(9))).otherwise(F.array(F.lit(4))).alias("filters"))
    for most in (capfilters.LARGE, 0):
        monkeypatch.setattr(capfilters, "LARGE", most)
        units = capfilters._dealt(listed).groupBy("filter", "i", "j").agg(F.count(F.lit(1)).alias("n")).collect()
        assert max(u.n for u in units) < 2 * 200 * 1.3 and sum(u.filter == 4 for u in units) == 25 * 26 // 2


def test_codes_reach_their_recall_or_say_so(monkeypatch):
    for dim, n in ((1, 10**5), (2, 10**4), (3, 10**5), (64, 10**5)):
        capfilters.Codes(dim, n, 0.9)
    monkeypatch.setattr(capfilters, "MISS", -1.0)
    with pytest.raises(ValueError):
        capfilters.Codes(8, 100, 0.9)


def test_maps_hold_what_is_wanted(spark, monkeypatch):
    rng = np.random.default_rng(2)
    wanted, others = (rng.integers(-(2**63), 2**63 - 1, n) for n in (3000, 200_000))
    df = spark.createDataFrame([(int(x),) for x in [*wanted, *wanted[:50]]], "v long").repartition(5)
    exact, loose = common.bit_map(df, 3000, listed=True), common.bit_map(df, 3000)
    assert exact.holds(wanted).all() and loose.holds(wanted).all() and exact.holds(wanted.view(np.uint64)).all()
    assert not exact.holds(others).any() and 0 < loose.holds(others).sum() < len(others) / 40
    monkeypatch.setattr(common, "LISTED", 0)
    assert common.bit_map(df, 3000, listed=True).listed is None
    assert not common.bit_map(df.limit(0), 0).holds(others).any() and not common.bit_map(df.limit(0), 0, listed=True).holds(others).any()


def test_sets_of_many_candidates_come_by_a_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(40)] + [(None, "x")], "id long, text string")
    ids = spark.createDataFrame([(i,) for i in (1, 1, 5, 7)], "id long")
    by_map = {r.id: r.shingles for r in minhash._sets(docs, ids, 5).collect() if r.id in (1, 5, 7)}
    monkeypatch.setattr(minhash, "WANTED", 0)
    assert {r.id: r.shingles for r in minhash._sets(docs, ids, 5).collect()} == by_map and len(by_map) == 3
