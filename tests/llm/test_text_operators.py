"""Sharding, mixing, exact deduplication, chat formatting and BPE against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlake.llm import bpe, chat, common, exact, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    words = ["alpha", "Béta", "gamma's", "d1l2", "don't", "<|endoftext|>", "ﬁx", "日本語", "éte", "x y", "a\x1cb", "İstanbul", "👍🏽", "Σς"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), "en", f"s{i % 5}", 0) for i in range(150)]
    rows += [(200 + i, "same text again\n and again", "en", "hot", 0) for i in range(90)]
    rows += [(400, None, None, None, None), (401, "", "en", "", 0), (402, " \t\n", "en", "s1", 0), (403, "w " * 30_000, "de", "long", 0), (404, "y" * 9_000, "de", None, 0)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(spark, table, keep):
    rows = table.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = sorted((r.doc_id, (k := {"min": min, "max": max}[keep](groups[r.text or ""])), len(groups[r.text or ""]), r.doc_id == k, sha((r.text or "").encode())) for r in rows)
    assert sorted(tuple(r) for r in exact.marked(table, keep).collect()) == want
    stays = exact.copies_dropped(table.withColumn("_h", F.lit(1)).withColumn("row", F.lit("x")), keep)
    assert sorted(r.doc_id for r in stays.collect()) == sorted({w[1] for w in want})
    assert exact.marked(empty(spark)).count() == 0


def test_exact_tells_colliding_texts_apart(spark, table, monkeypatch):
    monkeypatch.setattr(exact.F, "md5", lambda c: F.substring(F.hex(c), 1, 2))
    got = exact.marked(table, "max").select("doc_id", "keep_id", "group_size").collect()
    monkeypatch.undo()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exact.marked(table, "max").select("doc_id", "keep_id", "group_size").collect()))


def test_shards(spark, table):
    got = sharding.sharded(table, 8).collect()
    rows = table.collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(empty(spark)).count() == 0


def test_shards_are_even_and_keep_small_groups(spark):
    rng = random.Random(2)
    rows = [(i, str(i // 2) * rng.randint(1, 900), None, None, 0) for i in range(3000)] + [(9000 + i, "hot " * 90, None, None, 0) for i in range(1500)]
    got = sharding.sharded(spark.createDataFrame(rows, DOCS), 16).collect()
    load = [0] * 16
    for r in got:
        load[r.shard] += r.size
    assert max(load) < 1.03 * sum(load) / 16 and min(load) > 0.97 * sum(load) / 16
    assert len({r.shard for r in got if r.doc_id >= 9000}) > 1
    first = {(r.doc_id, r.shard, r.slot) for r in got}
    assert first == {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(spark.createDataFrame(rows, DOCS).repartition(7), 16).collect()}


def brute_targets(sizes, weights):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, pot = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while pot > 1e-9 and free:
        share = pot / sum(w[s] for s in free)
        pot = 0.0
        for s in list(free):
            target[s] += share * w[s]
            if target[s] >= 3 * sizes[s]:
                pot += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
    return target


def test_mix(spark, table):
    got = mixing.plan(table).collect()
    sizes = {}
    for r in table.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = brute_targets(sizes, (1, 2, 3))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.plan(table.repartition(3)).collect()), key=repr)
    assert mixing.plan(empty(spark)).count() == 0


def test_mixed_documents(spark, table):
    out = mixing.mixed(table.withColumn("_key", F.lit(7)).withColumn("size", F.lit("x")))
    assert out.columns == [*table.columns, "_key", "size"]
    plan = mixing.plan(table, cut="documents")
    words = out.select(F.sum(common.n_words(F.col("text")))).first()[0]
    assert words == plan.agg(F.sum("taken")).first()[0]
    assert {r.part in (0, r.size) for r in plan.collect()} == {True}


def test_chat_round_trip(spark):
    odd = "a&amp;<|turn|>b[INST]&lt;</s> <|text|> é👍"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "system", None), (1, 3, "assistant", "z"), (2, None, None, "x"), (2, 0, "assistant", "q"), (2, 0, "assistant", "q"), (None, 5, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seen", F.lit(1))
    out = {r.conv_id: r for r in chat.formatted(df.select("*", chat.text_part(F.col("text")).alias("parts"))).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in out[1].back] == [("user", odd), ("assistant", odd), ("system", ""), ("assistant", "z")]
    assert out[1].loss == odd + "z" and out[2].loss == "qq" and out[None].loss == ""
    assert [tuple(t) for t in out[2].back] == [("", "x"), ("assistant", "q"), ("assistant", "q")]


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 56, 30, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 2), ("other", "no", None, None, None, None, None)]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.formatted(df).first()
    assert "<|text|>see <|image|><|audio|><|document|>no<|stop|>" in r.formatted
    assert [(a.turn, a.kind, a.uri, a.tokens) for a in r.attachments] == [(0, "image", "i.png", 4), (0, "audio", "a.wav", 38), (0, "document", "d.pdf", 512)]
    assert r.attachment_tokens == 554
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_parts_come_back_typed(spark):
    part = lambda kind, text: (kind, text, None, None, None, None, None)
    rows = [(1, 0, "user", [part("text", "a <|image|> [b]"), part("image", None), part("audio", "x"), part("text", "&lt;|audio|>"), part("video", "hi"), part(None, "there")]), (1, 1, "assistant", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    first, second = chat.formatted(df).select(chat.read_parts(F.col("formatted")).alias("t")).first().t
    assert [tuple(p) for p in first.parts] == [("text", "a <|image|> [b]"), ("image", None), ("audio", None), ("text", "&lt;|audio|>hithere")]
    assert (first.role, second.role, second.parts) == ("user", "assistant", [])


def test_shards_keep_groups_whole_up_to_a_shard(spark):
    rows = [(i, f"t{i} " * 40, None, None, 0) for i in range(1500)] + [(9000 + i, "hot " * 90, None, None, 0) for i in range(150)] + [(None, "own", None, None, 0), (None, "own", None, None, 0), (7, None, None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("_hash", F.lit(1)).withColumn("shard", F.lit(None).cast("int"))
    got = sharding.sharded(df, 4).collect()
    load = [0] * 4
    for r in got:
        load[r.shard] += r.size
    hot = sum(r.size for r in got if r.doc_id is not None and r.doc_id >= 9000)
    assert 0.5 * sum(load) / 4 < hot < sum(load) / 4
    assert len({r.shard for r in got if r.doc_id is not None and r.doc_id >= 9000}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert max(load) < 1.02 * sum(load) / 4 and len(got) == len(rows)


def test_whole_groups_are_split_only_where_shards_would_be_uneven():
    low = sharding.LOWEST
    # five groups of three fifths of a shard's size can't lie whole in three even shards
    splitters = [(10 * g, d) for g in range(1, 6) for d in (low, *range(5))]
    sizes = {0: 0} | {r: 100 for r in range(1, len(splitters) + 1)}
    home = sharding._homes(sorted(sizes), splitters, sizes, 3)
    load = [sum(sizes[r] for r in sizes if home[r] == k) for k in range(3)]
    assert max(load) <= 1.02 * sum(load) / 3
    whole = [len({home[r] for r in sizes if r and splitters[r - 1][0] == 10 * g}) == 1 for g in range(1, 6)]
    assert sum(whole) >= 3


def test_packed_numbers():
    rng = random.Random(1)
    numbers = [rng.randrange(1 << rng.choice([1, 7, 8, 14, 15, 21, 22, 40])) for _ in range(2000)] + [0, 127, 128, 16383, 16384]
    assert list(bpe.unpacked(bpe.packed(np.array(numbers)))) == numbers and len(bpe.packed(np.zeros(0, int))) == 0 == len(bpe.unpacked(np.zeros(0, np.uint8)))


def test_bpe_in_small_blocks(spark, table, monkeypatch):
    want = sorted(map(tuple, bpe.coded(table, carry=("doc_id", "lang")).collect()), key=repr)
    monkeypatch.setattr(bpe, "BLOCK", 200)
    renamed = table.withColumn("block", F.lit(1)).withColumn("words", F.lit("x")).withColumn("carry", F.col("lang"))
    got = bpe.coded(renamed, carry=("doc_id", "carry", "block"))
    assert got.columns[:3] == ["doc_id", "carry", "block"]
    assert sorted((r.doc_id, r.carry, *r[3:]) for r in got.collect() if r.carry is not None) == sorted((w for w in want if w[1] is not None))


def test_bpe_refuses_tokenizers_that_join_words():
    with pytest.raises(ValueError):
        bpe._loaded(bpe.vocabulary_path("byte_bpe_50k.json"))


def test_decoding_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [5, 6]), (1, [5, 6]), (2, []), (3, None), (None, [6])], "doc_id long, ids array<int>").withColumn("_at", F.lit(1))
    pieces = [p.decode() for p in bpe._loaded(bpe.vocabulary_path())[1]]
    got = sorted((r.doc_id, r.decoded) for r in bpe.decode(rows).where("doc_id IS NOT NULL").collect() if r.decoded is not None)
    two = f"{pieces[5]} {pieces[6]}"
    assert got == [(1, two), (1, two), (2, "")] and bpe.decode(rows).where("doc_id = 3 AND decoded IS NULL").count() == 1


def test_mix_of_rows_without_ids(spark):
    rows = [(None, f"w{i} " * 5, None, "a", 0) for i in range(200)] + [(i, "x y z", None, "b", 0) for i in range(20)] + [(None, "", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    out = mixing.mixed(df).collect()
    plan = mixing.plan(df, cut="documents").collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in plan) and sum(r.text == "" for r in out) == 1
    assert len({r.text for r in out if r.source == "a"}) == len({r.text for r in out if r.source == "a" and r.doc_id is None})


def test_bpe(spark, table):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for r in table.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(tok.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, bpe.coded(table).collect())) == sorted(want)
    ids = bpe.coded(table.where("doc_id < 20"), with_ids=True)
    for r in bpe.decode(ids).collect():
        assert sha(r.decoded.encode()) == r.decoded_sha256 and len(r.ids) == r.n_tokens
    assert bpe.coded(empty(spark)).count() == 0
