"""Language identification, quality and personal data, against held-out accuracy and brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from reportlake.llm import langid, pii, quality, queries, trees

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op9_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


LANGS = "doc_id long, text string, lang string"


def test_odd_texts(spark):
    rng = random.Random(1)
    make = lambda words, n: " ".join(rng.choices(words, k=n))
    rows = [(i, make(["alpha", "beta", "gamma"], 30), "a") for i in range(60)] + [(100 + i, make(["zulu", "xray", "yankee"], 30), "z") for i in range(60)]
    rows += [(300, "Alpha! BETA", None), (301, None, "a"), (302, "", "a"), (303, "12 34 !?", "a"), (304, "zulu " * 50_000, None), (305, "日本語", None), (306, "\0alpha\0", None), (307, "alpha", None), (307, "alpha", None)]
    noise = "".join(rng.choices("bcdfghjklmnpqrstvw", k=300))
    rows.append((308, " ".join(noise[i : i + 6] for i in range(0, 300, 6)), None))
    docs = spark.createDataFrame(rows, LANGS).repartition(4).withColumn("row", F.lit(1))
    model = langid.learned(docs.where("doc_id < 200"))
    got = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    assert [got[i].lang_pred for i in (300, 301, 302, 303, 304, 306, 307)] == ["a", "und", "und", "und", "z", "a", "a"]
    assert got[305].lang_pred in ("a", "z") and got[303].score == 0.0
    assert not any(got[i].rejected for i in range(60)) and got[303].rejected and got[308].rejected
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(60)) | {300, 304, 307}
    none = langid.learned(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in langid.identified(docs, none).collect()} == {"und"}
    assert langid.identified(docs.limit(0), model).count() == 0


def test_rare_grams_stay_in_the_models_of_a_large_corpus(spark):
    rows = [(i, "banana cabana " * 3000, lang) for i in range(60) for lang in ("a", "b")] + [(900, "qxzj", "a"), (901, "jwqk", "b")]
    model = langid.learned(spark.createDataFrame(rows, LANGS).repartition(4))
    for lang, rare in enumerate(("qxzj", "jwqk")):
        keys, share = model["models"][lang].grams[0]
        own = langid.grams([rare])[0]
        assert np.isin(own, keys).all() and (share[np.isin(keys, own)] > 0).all()


def test_model_is_a_distribution():
    keys, _, _ = langid.grams(["abracadabra abba", "cab dab"])
    model = langid.Model(*np.unique(keys, return_counts=True))
    symbols = np.unique(keys & np.uint64(0xFFFF))
    for context in np.unique(keys >> np.uint64(16))[:20]:
        total = np.exp(model.log_shares((context << np.uint64(16)) | symbols, len(symbols))).sum()
        # blind guessing keeps one share for symbols never seen
        assert 0.9 < total <= 1 + 1e-6


def test_tables_are_the_models_side_by_side():
    texts = ["abracadabra abba", "cab dab zebra", "", "ein Haus"]
    models = [langid.Model(*np.unique(langid.grams([t])[0], return_counts=True)) for t in texts if t]
    keys = np.unique(langid.grams([*texts, "another zebra, abba!"])[0])
    side = langid.Tables(models, 20).log_shares(keys)
    assert np.allclose(side, np.stack([m.log_shares(keys, 20) for m in models], 1), rtol=1e-6)


def test_grams_of_texts_are_apart():
    together = langid.grams(["Ab c", "", "x"])
    assert [list(together[0][together[1] == i]) for i in range(3)] == [list(langid.grams([t])[0]) for t in ("Ab c", "", "x")]
    assert list(together[2]) == [True, False, True]


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op5_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good, bad = np.array([r.score for r in got if r.quality]), np.array([r.score for r in got if not r.quality])
    assert len(good) and len(bad) and (good[:, None] > bad).mean() > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_of_odd_texts(spark):
    rows = [(i, ("fine words stand here in a row " if i % 2 else "BAD!! ") * (3 + i % 5)) for i in range(80)] + [(100, None), (101, ""), (102, "é" * 50_000), (103, "x y " * 60_000), (104, "\n\n"), (105, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("statistics", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(5, None), (6, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.rated(docs, labels).collect()}
    assert len(got) == 86 and all(0 <= s <= 1 for s in got.values()) and min(got[i] for i in range(1, 80, 2)) > max(got[i] for i in range(0, 80, 2))
    assert {r.score for r in quality.rated(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.rated(docs.limit(0), labels).count() == 0


def test_statistics_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["a b a b a b", "One line\nOne line\n", "", "x" * 10, "a b c d e f a b c d e f"]
    together = quality.statistics(pa.array(texts))
    assert np.allclose(together, np.concatenate([quality.statistics(pa.array([t])) for t in texts]))
    at = quality.STATISTICS.index
    assert together[1][at("distinct_lines")] == 0.5 and np.isclose(together[0][at("distinct_words")], 1 / 3) and np.isclose(together[4][at("distinct_fives")], 6 / 8)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    p = trees.fitted(x[:1500], y[:1500]).score(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or max(map(int, m.group().split("."))) <= 255, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    for _ in range(30_000):
        text = "".join(rng.choices("a.1@2+- (é0", k=rng.randint(1, 40)))
        assert pii.listed(pii.base_spans(text)).split(",") == (base(text) or [""])
    long = "@" + "a" * 200_000 + " " + "1" * 100_000 + " +" + "(" * 100_000
    assert pii.base_spans(long) == []


def test_personal_data(spark):
    same = [f"{'The caller was Zorblatt and' if i % 2 else 'wrote Zorblatt,'} number {i} filler{i} bob@site{i % 3 * 0}.example.org said thing{i}." for i in range(8)]
    clean = [f"ordinary words number {i} stand here with the caller and said wrote filler" for i in range(300)]
    rows = [(i, t) for i, t in enumerate(same + clean)] + [(900, None), (901, ""), (902, "é 10.0.0.1 300.1.1.1 4111 1111 1111 1111 +1 (555) 010-9999"), (903, same[0]), (903, same[0]), (904, "é" * 60_000 + " a@b.co")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("seen", F.lit(1)).withColumn("base", F.lit(2))
    got = {r.doc_id: r for r in pii.found(docs).select("doc_id", pii.joined(F.col("base")).alias("b"), pii.joined(F.concat("base", "terms")).alias("s")).collect()}
    texts = dict(rows)
    for i, t in texts.items():
        assert got[i].b == ",".join(base(t))
        assert got[i].s.startswith(got[i].b)
    named = [texts[i][int(a) : int(b)] for i in range(8) for k, a, b in (x.split(":") for x in got[i].s.split(",")) if k == "term"]
    assert named.count("Zorblatt") == 8 and not {"the", "caller", "said", "wrote", "number"} & {n.lower() for n in named}
    assert all(got[i].s == "" for i in range(8, 308))
    clean_ = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Zorblatt" not in clean_[1] and "[EMAIL]" in clean_[1] and clean_[20] == texts[20] and clean_[900] == ""
    assert pii.found(docs.limit(0)).count() == 0


def terms_of(spark, rows):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = pii.found(docs).select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.*").collect()
    return sorted((r.doc_id, rows[r.doc_id][r.start : r.stop]) for r in got)


ORDINARY = [f"ordinary words number {i} stand here" for i in range(300)]


def test_terms_far_from_their_entity(spark):
    near = [f"one{i} Zorblatt, two{i} bob@x.org" for i in range(2)]
    got = terms_of(spark, [near[0] + " and" * 10 + " Zorblatt", near[1], "é, far away (ZORBLATT) stands alone", *ORDINARY])
    assert got == [(0, "Zorblatt"), (0, "Zorblatt"), (1, "Zorblatt"), (2, "ZORBLATT")]


def test_terms_of_copied_documents(spark):
    passage = "signed Zorblatt bob@x.org"
    copies = [f"head{i} a b c d e f g {passage} h i j k l m n tail{i}" for i in range(40)]
    whole = ["the desk of Quuxly amy@y.org"] * 5
    got = terms_of(spark, [*copies, *whole, *ORDINARY])
    assert {i for i, t in got if t == "Zorblatt"} == set(range(40)) and {i for i, t in got if t == "Quuxly"} == set(range(40, 45))
    assert not [i for i, _ in got if i >= 45]


def test_terms_with_marks_and_short_ones(spark):
    names = ["O'Brien", "Smith-Jones", "user_name", "AB-1234", "李明"]
    rows = [f"w{k}{i} “{n}”, x{k}{i} a{k}@x.org" for k, n in enumerate(names) for i in range(2)]
    rows += [f"v{i} Farley {'z' * 9000 if i else ' ' * 9000} last{i} far@x.org" for i in range(2)]
    assert terms_of(spark, rows + ORDINARY) == [(2 * k + i, n) for k, n in enumerate(names) for i in range(2)] + [(10, "Farley"), (11, "Farley")]


def test_terms_and_their_places_agree():
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["".join(rng.choices("ab',-“”«é李、 \n", k=rng.randint(0, 25))) for _ in range(3000)]
    for i, j, hashes, first in pii._terms(pa.array(texts)):
        for r in range(i, j):
            own = [texts[r][a:b] for a, b in pii._places(texts[r])]
            assert own == [w for w in (w.strip("',-“”«、") for w in re.split(r"[ \n]+", texts[r])) if w]
            assert list(hashes[first[r - i] : first[r - i + 1]]) == ([h for *_, x, _ in pii._terms(pa.array(own)) for h in x] if own else [])


def test_counts_of_spans(spark):
    for r in queries.op6_pii(spark, SF).collect():
        kinds = [s.split(":")[0] for s in r.spans.split(",")]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in PATTERNS)
        mine = ",".join(s for s in r.spans.split(",") if s and not s.startswith("term"))
        assert hashlib.sha256(mine.encode()).hexdigest() == r.base_sha256
