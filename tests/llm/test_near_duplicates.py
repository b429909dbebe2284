"""Near-duplicates of documents and vectors, and components, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlake.llm import capfilters, components, minhash

DOCS = "doc_id long, text string"


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(2000, 2100)] + [(7, 7), (7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(4)
    got = dict(tuple(r) for r in components.components(df).collect())
    want = closure({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items() if n != c}
    assert components.components(df.limit(0)).count() == 0


def shingles(text, k):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in (text or "").translate(table).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    home = closure({i for i, _ in rows}, links)
    return sorted((i, len(s), home[i], home[i] == i) for i, s in sets)


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}É" if i % 7 == 0 else f"W{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randint(1, 150))
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 18))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", " \t"]).join(own)))
            n += 1
    hot = rng.choices(vocabulary, k=120)
    for i in range(120):
        own = list(hot)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, "the very same words stand here once more") for i in range(60)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "ONE"), (3005, "one two three"), (3006, "long " * 40_000), (3007, "z" * 3_000_000), (3008, "a b c d e")]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_documents(spark, k):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(6).withColumn("id", F.lit("x")).withColumn("n", F.lit(None).cast("int"))
    assert sorted(map(tuple, minhash.near_duplicates(df, k).collect())) == brute(rows, k)


def test_documents_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = corpus()[40:260]
    assert sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 4).collect())) == brute(rows, 4)


def test_odd_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z z z"), (2, None)]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 1, True), (None, 1, False), (None, None, False), (2, 2, True)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    both, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.concatenate([both, own[:200]]), np.concatenate([both, own[200:]])
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 800 / 1200) < 0.15


def vectors(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and i is not None]
    links, count = [], {}
    for x, (a, u) in enumerate(good):
        for b, v in good[:x]:
            if len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.9:
                links.append((a, b))
                count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    home = closure({i for i, _ in rows}, links)
    return sorted((i, count.get(i, 0), home[i], home[i] == i) for i, _ in rows)


def clusters(dim, seed=3):
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    rows, n = [], 0
    for size in (1, 1, 2, 3, 40, 150):
        centre = unit(rng.standard_normal(dim))
        for _ in range(size):
            rows.append((n, (3 * unit(centre + rng.standard_normal(dim) * 0.25 / np.sqrt(dim))).tolist()))
            n += 1
    rows += [(n + i, unit(rng.standard_normal(dim)).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    return rows


@pytest.mark.parametrize("dim", [2, 33, 64])
def test_vectors(spark, dim):
    rows = clusters(dim)
    odd = [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [], [1.0, 2.0, 3.0]]
    rows += [(2000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("links", F.lit(1)).withColumn("label", F.lit("x"))
    assert sorted(map(tuple, capfilters.near_duplicates(df).collect())) == vectors(rows)


def test_vectors_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "BLOCK", 8)
    rows = clusters(16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert sorted(map(tuple, capfilters.near_duplicates(df).collect())) == vectors(rows)


def test_recall_at_the_limit(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1500, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * y
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    found = capfilters.near_duplicates(df).where("n_links > 0").count()
    assert 0.99 * 3000 <= found <= 3000


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, capfilters.near_duplicates(none).collect()), key=repr) == [(1, 0, 1, True), (None, 0, None, False)]
    assert capfilters.near_duplicates(none.limit(0)).count() == 0
