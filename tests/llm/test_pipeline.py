"""The pipeline's stages, one after the other, against brute force on a small corpus."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from reportlake.llm import bpe, langid, mixing
from reportlake.llm.common import crc_mod5

from .test_near_duplicates import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    rng = random.Random(8)
    words = {"a": [f"{x}an{y}" for x in "bcdfg" for y in "aeiou"], "b": [f"{x}üsch{y}" for x in "klmnp" for y in "trsz"]}
    rows = []
    for i in range(120):
        lang = "ab"[i % 2]
        rows.append([i, " ".join(rng.choices(words[lang], k=60)), lang, f"s{i % 4}"])
    rows += [[200 + i, rows[i][1], "a", "copies"] for i in range(0, 20)] + [[300 + i, rows[50][1], "a", "copies"] for i in range(30)]
    for i in range(20):
        near = rows[20 + i][1].split(" ")
        near[rng.randrange(60)] = "changed"
        rows.append([400 + i, " ".join(near), rows[20 + i][2], "near"])
    rows += [[500, None, None, None], [501, "", "a", "s1"], [502, "1234 !!", "a", "s1"]]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).repartition(5)


def test_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix", "encode"]
    docs = corpus(spark)
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], "unused")
        out.write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
        if name != "encode":
            assert out.columns == docs.columns
    start, accepted, distinct, single, mix, coded = ([r for r in s.collect()] for s in steps)
    assert {r.doc_id for r in start} - {r.doc_id for r in accepted} == {500, 501, 502}
    first = {}
    for r in accepted:
        first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in distinct) == sorted(first.values())
    kept = {i for i, _, _, k in brute([(r.doc_id, r.text) for r in distinct], 5) if k}
    assert sorted(r.doc_id for r in single) == sorted(kept)
    plan = {r.doc_id: r for r in mixing.plan(steps[3], cut="documents").collect()}
    assert sorted(r.doc_id for r in mix) == sorted(i for i, r in plan.items() for _ in range(r.epochs + (r.part > 0)))
    words, target = {}, {}
    for r in mix:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for r in plan.values():
        target[r.source] = r.target
    assert all(abs(words.get(s, 0) - t) <= 60 for s, t in target.items())
    want = {r.doc_id: hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in bpe._loaded(bpe.vocabulary_path())[0].encode(r.text, add_special_tokens=False).ids)).hexdigest() for r in mix}
    assert sorted((r.doc_id, r.ids_sha256) for r in coded) == sorted((r.doc_id, want[r.doc_id]) for r in mix)


def test_run(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 50 and set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}


def test_near_dedup_of_rows_without_ids(spark):
    words = [[f"w{k}x{i}" for i in range(60)] for k in range(4)]
    near = lambda k, i: " ".join([*words[k][:i], "changed", *words[k][i + 1 :]])
    rows = [(None, " ".join(words[0])), (None, " ".join(words[1])), (None, near(1, 0)), (7, near(2, 0)), (None, " ".join(words[2])), (9, " ".join(words[3])), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "a", f"s{n}", 0) for n, (i, t) in enumerate(rows)], DOCS).repartition(3)
    got = [(r.source, r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, "unused").collect()]
    assert len(got) == len(set(got)) and {s for s, _ in got} - {"s1", "s2"} == {"s0", "s3", "s5", "s6", "s7"} and len(got) == 6
    assert sorted(i for _, i in got if i is not None) == [7, 9]


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learned(docs.where(crc_mod5() != 0))
    assert langid.accepted(docs, model).count() >= 0.995 * docs.count()


def test_language_stage_learns_from_all_labelled_rows(spark, monkeypatch):
    rows = [(i, " ".join(f"{'abcdefgh'[i * k % 8]}{'aeiou'[(i + k) % 5]}st" for k in range(1, 3 + i % 9)), "xy"[i % 2], "s", 0) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    used = []
    monkeypatch.setattr(langid, "accepted", lambda docs, model: used.append(model) or docs)
    corpus_pipeline.language_id(spark, docs, "")
    taught = docs.where(crc_mod5() != 0)
    own = {r.lang: r.mean for r in langid.identified(taught, used[0]).join(taught.select("doc_id", "lang"), "doc_id").where("lang = lang_pred").groupBy("lang").agg(F.avg("bits").alias("mean")).collect()}
    assert all(abs(used[0]["mean"][k] - own[lang]) < 1e-9 for k, lang in enumerate(used[0]["langs"]))


def test_language_stage_leaves_no_labelled_row_out(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda words: " ".join(rng.choices(words, k=40))
    latin, cyrillic, greek = ["ziel", "haus", "baum", "gras"], ["дом", "лес", "река", "гора"], ["σπίτι", "δάσος", "νερό", "βουνό"]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 0][:30]
    rows = [(i, text(latin), "a", "s", 0) for i in range(60)] + [(i, text(cyrillic), "b", "s", 0) for i in held] + [(None, text(greek), "c", "s", 0) for _ in range(30)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert corpus_pipeline.language_id(spark, docs, "").count() == len(rows)
    assert corpus_pipeline.language_id(spark, docs.withColumn("doc_id", F.lit(None).cast("long")), "").count() == len(rows)

    # counts of all rows, and limits of both parts
    learned, accepted, used = langid.learned, langid.accepted, []
    monkeypatch.setattr(langid, "accepted", lambda docs, model: used.append(model) or accepted(docs, model))
    corpus_pipeline.language_id(spark, docs, "")
    (model,), whole = used, learned(docs)
    assert model["langs"] == ["a", "b", "c"]
    for one, other in zip(model["models"], whole["models"], strict=True):
        assert all((a == b).all() for x, y in zip(one.grams, other.grams, strict=True) for a, b in zip(x, y, strict=True))
    scored = langid.identified(docs.withColumn("doc_id", F.struct("doc_id", "lang")), model).where("doc_id.lang = lang_pred").select("doc_id.*", "bits").collect()
    for name, part in (("mean", False), ("mean_apart", True)):
        own = [r.bits for r in scored if r.lang == "a" and (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == part]
        assert own and math.isclose(model[name][0], sum(own) / len(own), rel_tol=1e-9)


def test_texts_beyond_one_part_only_stay(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma " * 20)], "doc_id long, text string")
    model = langid.learned(docs.withColumn("lang", F.lit("a")))
    near, far = {"mean": [-50.0], "spread": [0.5]}, {"mean_apart": model["mean"], "spread_apart": model["spread"]}
    assert langid.accepted(docs, model | near | far).count() == 1
    assert langid.accepted(docs, model | near | {f"{k}_apart": v for k, v in near.items()}).count() == 0
